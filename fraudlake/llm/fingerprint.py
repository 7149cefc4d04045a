"""Document fingerprints: SimHash of weighted terms, and permuted block tables.

Terms are the pairs of neighbouring words of a text (one word: that word). A term votes with weight
1 + ln(count) for every set bit of its hash and against every other; the sign of the sum is the
bit of the fingerprint. Null, empty and blank texts have fingerprint zero.

The bits are cut into radius + 1 blocks; each block leads one permuted table, whose rows
agree on the block. Fingerprints within the radius agree on at least one block, so the
tables hold every such pair; a pair is counted in the first table that holds it. Blocks with too
many rows are cut by further blocks (``bk_dedup.block_keys``), and the rows of a block are compared in bounded steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.bk_dedup import ROWS_PER_TASK, block_keys
from fraudlake.llm.common import Codes, batch_of, id_back, id_key, no_text, pack_bits, parts_for, run_hashes, split_words
from fraudlake.session import cut

RADIUS = 3


def simhash(text: str | None, cache: Codes) -> int:
    """64-bit fingerprint of one text as a signed long."""
    words = split_words(text)
    if not words:
        return 0
    terms, count = np.unique(run_hashes(cache.of(words), min(2, len(words))), return_counts=True)
    weight = (1 + np.log(count)).astype(np.float32)
    bits = np.unpackbits(terms.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    return pack_bits(weight @ bits * 2 > weight.sum())


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - ((a ^ b) & (2**64 - 1)).bit_count() / 64


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """Own and edited fingerprints of every row, edited with the next row by id (the last with the first).

    Rows are dealt by ranges of the id and sorted; a task answers all but its last row. Its last and
    first rows go on as they are, and the few of all tasks are then put together by their order. Rows that repeat
    an id follow each other by a hash of their text.
    """
    rows = docs.select(id_key().alias("id"), no_text().alias("text")).withColumn("h", F.xxhash64("text"))
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("kind", pa.int32()), ("text", pa.string()), ("n_chars", pa.int64()),
                        ("edited_sha256", pa.string()), ("fp", pa.int64()), ("efp", pa.int64()), ("nfp", pa.int64())])
    ddl = "id long, h long, kind int, text string, n_chars long, edited_sha256 string, fp long, efp long, nfp long"

    def answer(i, h, text, fp, following, nfp, cache):
        e = edited(text, following)
        return i, h, 0, None, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), fp, fp if e == text else simhash(e, cache), nfp

    def run(batches):
        cache, last = Codes(), None
        for b in batches:
            out = []
            for i, h, text in zip(*(b.column(c).to_pylist() for c in ("id", "h", "text"))):
                fp = last[3] if last and last[2] == text else simhash(text, cache)
                if last is None:
                    out.append((i, h, 1, text, None, None, fp, None, None))     # head of the task
                else:
                    out.append(answer(*last, text, fp, cache))
                last = (i, h, text, fp)
            if out:
                yield batch_of(schema, *zip(*out))
        if last:
            yield batch_of(schema, *zip((last[0], last[1], 2, last[2], None, None, last[3], None, None)))   # waits for the next head

    done = cut(rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").mapInArrow(run, ddl))
    # two rows for each task that had rows: order them, then give every waiting row the head that follows
    ends = done.where("kind > 0")
    order = cut(ends.where("kind = 1").select("id", "h").withColumn("at", F.expr("row_number() OVER (ORDER BY id, h)")))
    n = order.count()
    if not n:
        return done.select(*[c for c in done.columns if c not in ("kind", "text")])
    heads = ends.where("kind = 1").join(order, ["id", "h"]).dropDuplicates(["at"]).select(
        F.when(F.col("at") == 1, F.lit(n)).otherwise(F.col("at") - 1).alias("at"), F.col("text").alias("_next"), F.col("fp").alias("_nfp"))
    waiting = ends.where("kind = 2").select("id", "h", "text", "fp").withColumn("at", F.expr("row_number() OVER (ORDER BY id, h)"))

    def finish(batches):
        cache = Codes()
        for b in batches:
            out = [answer(i, h, t, fp, nt, nfp, cache) for i, h, t, fp, nt, nfp in zip(*(b.column(c).to_pylist() for c in ("id", "h", "text", "fp", "_next", "_nfp")))]
            if out:
                yield batch_of(schema, *zip(*out))

    tail = waiting.join(heads, "at").select("id", "h", "text", "fp", "_next", "_nfp").mapInArrow(finish, ddl)
    return done.where("kind = 0").unionByName(tail).select(*[c for c in done.columns if c not in ("kind", "text")])


def near_counts(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each ``f0`` of ``fps(f0, n)`` (distinct, with row counts), ``n_near``: rows of other fingerprints within the radius."""
    keyed = block_keys(fps.select(F.col("n").alias("id"), "f0"), radius, order=True)
    sizes = keyed.groupBy("key").count().where("count > 1").select("key")
    keyed = cut(keyed.join(sizes, "key", "left_semi"))
    schema = pa.schema([("f0", pa.int64()), ("n_near", pa.int64())])

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, f, n = t.column("key").to_numpy(), t.column("f0").to_numpy().view(np.uint64), t.column("id").to_numpy()
        before = t.column("before").to_pylist()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        near = np.zeros(len(f), np.int64)
        for a, b in zip(starts, [*starts[1:], len(f)]):
            own = order[a:b]
            masks = np.array(before[own[0]], np.int64).view(np.uint64)
            for at in range(0, len(own), 1024):
                x = f[own[at:at + 1024], None] ^ f[own][None, :]
                hit = np.bitwise_count(x) <= radius
                for m in masks:
                    hit &= (x & m) != 0
                hit[np.arange(len(x)), at + np.arange(len(x))] = False
                near[own[at:at + 1024]] += hit @ n[own]
        far = np.flatnonzero(near)
        yield batch_of(schema, f[far].view(np.int64), near[far])

    parts = parts_for(keyed.count(), ROWS_PER_TASK)
    return keyed.repartition(parts, "key").mapInArrow(run, "f0 long, n_near long").groupBy("f0").agg(F.sum("n_near").alias("n_near"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, both fingerprints as hex, ``near_edited``, ``near_next`` and ``n_near``,
    the number of other rows within the radius."""
    rows = cut(with_next(docs))
    fps = cut(rows.groupBy(F.col("fp").alias("f0")).agg(F.count("*").alias("n")))
    near = fps.join(near_counts(fps, radius), "f0", "left").select(F.col("f0").alias("fp"), (F.col("n") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near"))

    def same(a, b):
        return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)

    def hexed(c):
        return F.lpad(F.lower(F.hex(c)), 16, "0")

    return rows.join(near, "fp").select(id_back("id").alias("doc_id"), "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"),
                                        hexed("efp").alias("edited_fingerprint"), same("fp", "efp").alias("near_edited"),
                                        same("fp", "nfp").alias("near_next"), "n_near")
