"""Shard placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table (an offset and a step from hashes of
its name). Shards take turns; on its turn a shard claims the first slot of its permutation that is
still free, until the table is full. All shards then own nearly the same number of slots, and
when a shard goes, few slots beside its own change hands. A row's key is hashed to a slot, and the
table, whose size is fixed, is broadcast: placement takes one look-up a row and no shuffle.

The key is the id; rows without one are placed by their text, and rows without both all share
a slot. Rows that repeat a key go to the same shard. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 4_099   # prime; about a hundred slots and more for each shard
SHARDS = tuple(f"shard-{k:02d}" for k in range(32))


def _number(text: str) -> int:
    """The first 15 hex digits of the md5 sum, as SQL can compute it too."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Slot to shard number. The work is that of the fixed table size and does not depend on the data."""
    if not shards or size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("need a prime size of at least the number of shards")
    at = [_number(f"{s}#offset") % size for s in shards]
    step = [_number(f"{s}#step") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``slot`` and ``shard`` as a table of ``size`` rows."""
    names = F.split(F.lit("\n".join(shards)), "\n")
    owners = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    return (spark.range(1).select(F.posexplode(owners).alias("slot", "k"))
            .select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("k").cast("int") + 1).alias("shard")))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % size


def place(docs: DataFrame, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, key: Column | None = None) -> DataFrame:
    """``docs`` with the columns ``slot`` and ``shard`` (replaced where they exist)."""
    key = key if key is not None else F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    docs = docs.drop("slot", "shard").withColumn("slot", slot_of(key, size))
    return docs.join(F.broadcast(lookup(docs.sparkSession, shards, size)), "slot")


def moved(spark: SparkSession, before: tuple[str, ...], after: tuple[str, ...], size: int = TABLE_SIZE) -> DataFrame:
    """Slots whose owner changes between two lists of shards."""
    a = lookup(spark, before, size).withColumnRenamed("shard", "was")
    return a.join(lookup(spark, after, size), "slot").where("was <> shard")


def write_shards(docs: DataFrame, path: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> None:
    """One folder for each shard. Rows are spread by slot first, so a shard's folder has several files and no task holds a whole shard."""
    place(docs, shards, size).repartition("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


# The same table and placement in SQL: one turn for each step of the recursion.
ORACLE = f"""
WITH RECURSIVE
s AS (SELECT k, ('0x' || substr(md5(name || '#offset'), 1, 15))::BIGINT % {TABLE_SIZE} AS o,
             ('0x' || substr(md5(name || '#step'), 1, 15))::BIGINT % {TABLE_SIZE - 1} + 1 AS st
      FROM (SELECT k::INT AS k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(k))),
perm AS MATERIALIZED (SELECT k, list((o + j * st) % {TABLE_SIZE} ORDER BY j) AS p FROM s, range({TABLE_SIZE}) r(j) GROUP BY k),
fill(turn, slot, taken) AS (
  SELECT 0, (SELECT p[1] FROM perm WHERE k = 0), list_resize([]::BOOLEAN[], {TABLE_SIZE}, false)
  UNION ALL
  SELECT turn + 1,
         list_filter(perm.p, lambda x: NOT t2[x + 1])[1], t2
  FROM (SELECT turn, list_concat(list_concat(taken[:slot], [true]), taken[slot + 2:]) AS t2 FROM fill WHERE turn < {TABLE_SIZE - 1}) f
  JOIN perm ON perm.k = (turn + 1) % {len(SHARDS)}),
owner AS (SELECT slot, 'shard-' || lpad((turn % {len(SHARDS)})::VARCHAR, 2, '0') AS shard FROM fill)
SELECT d.doc_id, d.slot, owner.shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents) d
JOIN owner USING (slot)
"""
