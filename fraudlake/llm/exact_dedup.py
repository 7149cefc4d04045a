"""Exact duplicates by a tree merge of sorted digest runs.

Every row becomes one record: the SHA-256 of its text, a second check (a 64-bit hash of other construction and the length), its id
and its row number. A run is what one input partition holds, in pieces of ``LEAF_ROWS`` rows; it is sorted by digest and holds each
text once, with the row that stays so far and the number of rows. Runs are also split by leading digest bits into ranges of
about ``RANGE_ROWS`` records, so that no task ever holds more than ``FAN`` pieces of that size.

Rounds of the tree: in round r the node that heads a block of ``FAN ** r`` runs receives the runs of the other blocks beside it and merges
them (stable sort of sorted runs, then one pass over neighbours). Records are merged only when digest *and* check agree, at every
level. After the last round one node in each range knows, for every text, the row that stays and how many there are. The answers for texts
with more than one row go down the same tree: every node passes on what its children asked for, so a text with any number of copies
reaches each run once, and no key ever gathers its copies.

Of equal texts the row with the smallest (or, on request, largest) id stays; among rows of one id, the first in row order. A null id sorts before all
others. A null text counts as an empty one; texts are equal when their bytes are. Very long texts never leave the first step. Other columns are
carried through by ``keep_one``; the verdict ignores them. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import id_back, id_key, no_text, parts_for
from fraudlake.session import cut

LEAF_ROWS = 20_000      # rows of a run
RANGE_ROWS = 100_000    # distinct texts of a range, about
FAN = 8                 # runs merged at a time
# one record of a run: digest, check and length as one key; id and row of the row that stays; rows with this text
KEY = "S48"
RECORD = np.dtype([("key", KEY), ("id", "i8"), ("row", "i8"), ("count", "i8")])
RUN_DDL = "bucket long, run long, records binary"


def merge(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """One sorted run of several: each text once, with the row that stays and the number of rows of all."""
    r = np.concatenate(runs)
    r = r[np.argsort(r["key"], kind="stable")]      # runs are sorted: the stable sort merges them
    same = r["key"][1:] == r["key"][:-1]
    if not same.any():
        return r
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
    part = r[tied]
    r[tied] = part[np.lexsort((part["row"], ~part["id"] if largest else part["id"], part["key"]))]
    at = np.flatnonzero(np.append(True, ~same))
    out = r[at]
    out["count"] = np.add.reduceat(r["count"], at)
    return out


def look_up(keys: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``keys`` are among the sorted ``answers``, and where."""
    at = np.minimum(np.searchsorted(answers["key"], keys), max(len(answers) - 1, 0))
    return (answers["key"][at] == keys if len(answers) else np.zeros(len(keys), bool)), at


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key, from the first four bytes of its digest."""
    lead = np.frombuffer(keys.tobytes(), ">u4").reshape(-1, 12)[:, 0].astype(np.int64)
    return lead * ranges >> 32


def run_table(bucket: list[int], run: list[int], records: list[np.ndarray]) -> pa.Table:
    return pa.table([pa.array(bucket, pa.int64()), pa.array(run, pa.int64()), pa.array([r.tobytes() for r in records], pa.binary())],
                    ["bucket", "run", "records"])


def unpack(t: pa.Table) -> np.ndarray:
    """All records of the runs in ``t``, run after run."""
    return np.frombuffer(b"".join(t.column("records").to_pylist()), RECORD)


def keys_of(t) -> np.ndarray:
    return np.array(t.column("key").to_pylist(), KEY)


def digest_rows(docs: DataFrame, leaf_rows: int = LEAF_ROWS, row: str | None = None) -> DataFrame:
    """One narrow row for each row of ``docs``, written once: number, input partition and piece, id, and the key of the text.

    ``row`` names a column that holds numbers made by ``monotonically_increasing_id`` before; else they are made here.
    """
    def digits(c):
        return F.lpad(F.hex(c), 16, "0")

    rows = docs.select(id_key().alias("id"), no_text().alias("t"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    return cut(rows.select("id", "row", F.shiftright("row", 33).alias("part"),
                           F.floor(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(leaf_rows)).alias("piece"),
                           F.unhex(F.concat(F.sha2("t", 256), digits(F.xxhash64("t")), digits(F.octet_length("t")))).alias("key")))


def survivors(rows: DataFrame, keep: str = "smallest", range_rows: int = RANGE_ROWS, fan: int = FAN) -> DataFrame:
    """Every row of ``digest_rows``: ``id``, ``row``, ``key``, ``keep_id``, ``keep_row``, ``group_size``."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    largest = keep == "largest"
    n, parts, pieces = rows.agg(F.count("*"), F.max("part"), F.max("piece")).first()
    ranges, width = parts_for(n, range_rows), (parts or 0) + 1
    rows = rows.select("id", "row", "key", (F.col("piece") * F.lit(width) + F.col("part")).alias("run"))

    def leaf(t: pa.Table) -> pa.Table:
        """The sorted run of some rows, one piece for each range."""
        r = np.zeros(t.num_rows, RECORD)
        r["key"], r["id"], r["row"], r["count"] = keys_of(t), t.column("id").to_numpy(), t.column("row").to_numpy(), 1
        r = merge([r], largest)
        ends = np.searchsorted(ranges_of(r["key"], ranges), np.arange(ranges + 1))
        got = [k for k in range(ranges) if ends[k] < ends[k + 1]]
        return run_table(got, [t.column("run")[0].as_py()] * len(got), [r[ends[k]:ends[k + 1]] for k in got])

    def join_runs(t: pa.Table) -> pa.Table:
        head = t.slice(0, 1)
        return run_table(head.column("bucket").to_pylist(), head.column("up").to_pylist(),
                         [merge([np.frombuffer(x, RECORD) for x in t.column("records").to_pylist()], largest)])

    def shared(t: pa.Table) -> pa.Table:
        """Of the last node of a range: only texts with several rows."""
        r = unpack(t)
        r = r[r["count"] > 1]
        return run_table(t.column("bucket").to_pylist(), t.column("run").to_pylist(), [r]) if len(r) else t.slice(0, 0)

    def pass_down(children: pa.Table, answers: pa.Table) -> pa.Table:
        """To every child the answers for the texts it holds."""
        known, out = unpack(answers), ([], [], [])
        for bucket, run, records in zip(*(children.column(c).to_pylist() for c in ("bucket", "run", "records"))):
            found, at = look_up(np.frombuffer(records, RECORD)["key"], known)
            if found.any():
                for o, v in zip(out, (bucket, run, known[at[found]])):
                    o.append(v)
        return run_table(*out)

    def verdict(t: pa.Table, answers: pa.Table) -> pa.Table:
        known = unpack(answers)
        known = known[np.argsort(known["key"], kind="stable")]      # ranges arrive in any order
        found, at = look_up(keys_of(t), known)
        cols = [t.column("id").to_numpy().copy(), t.column("row").to_numpy().copy(), np.ones(t.num_rows, np.int64)]
        for c, name in zip(cols, ("id", "row", "count")):
            c[found] = known[name][at[found]]
        return pa.table([t.column("id"), t.column("row"), t.column("key"), *map(pa.array, cols)], ["id", "row", "key", "keep_id", "keep_row", "group_size"])

    levels = [cut(rows.groupBy("run").applyInArrow(leaf, RUN_DDL))]
    runs = width * ((pieces or 0) + 1)
    while runs > 1:
        runs = -(-runs // fan)
        up = levels[-1].withColumn("up", F.floor(F.col("run") / F.lit(fan)))
        levels.append(cut(up.groupBy("bucket", "up").applyInArrow(join_runs, RUN_DDL)))
    answers = levels.pop().groupBy("bucket", "run").applyInArrow(shared, RUN_DDL)
    for level in reversed(levels):
        below = level.withColumn("up", F.floor(F.col("run") / F.lit(fan)))
        answers = below.groupBy("bucket", "up").cogroup(answers.groupBy("bucket", "run")).applyInArrow(pass_down, RUN_DDL)
    return (rows.groupBy("run").cogroup(answers.groupBy("run"))
            .applyInArrow(verdict, "id long, row long, key binary, keep_id long, keep_row long, group_size long"))


def groups(docs: DataFrame, keep: str = "smallest", leaf_rows: int = LEAF_ROWS, range_rows: int = RANGE_ROWS, fan: int = FAN) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    return (survivors(digest_rows(docs, leaf_rows), keep, range_rows, fan)
            .select(id_back("id").alias("doc_id"), id_back("keep_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                    F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256")))


def keep_one(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of every text. The numbered rows are written once, so that the verdict finds its row again."""
    # a struct holds the caller's columns, whatever their names
    numbered = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("at")))
    rows = digest_rows(numbered.select("doc.doc_id", "doc.text", "at"), row="at")
    stay = survivors(rows, keep).where("row = keep_row").select(F.col("row").alias("at"))
    return numbered.join(stay, "at", "left_semi").select("doc.*")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
