"""Variable-capacity best-fit packing of documents into training sequences.

A document longer than the largest permitted length is cut into pieces of that length; the last
piece keeps the rest. Pieces are dealt to shards of about ``SHARD_PIECES`` by a hash, and every
shard is packed on its own, largest piece first: a piece goes to the open bin it leaves the least
room in; when none has room, the bin opened is the size with the least cost for each token it is
likely to hold (cost of the bin over the smaller of its capacity and what is left to pack that fits
beside the piece). All permitted sizes are tried jointly: the shard is packed under that rule and
under each "largest size allowed" in turn, every bin is downsized to the smallest permitted length that
holds its contents, and the cheapest packing of the shard is kept.

A sequence of n tokens costs ``n + n * n / QUADRATIC + OVERHEAD``: linear layers, attention, fixed work.

A null text and a text without words have length zero and go to no bin: they come back with null
``bin_id``. Rows that repeat a document, with or without an id, are packed as often as they occur and spread over shards. Of bins with equal
room the one opened first takes the piece. A very long text is cut into pieces, its words are only counted. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import batch_of, id_back, id_key, no_text, parts_for
from fraudlake.session import cut

LENGTHS = (256, 512, 1024, 2048, 4096)
SHARD_PIECES = 20_000
OVERHEAD = 16.0
QUADRATIC = 8192.0


def cost(n: np.ndarray | int):
    return n + n * n / QUADRATIC + OVERHEAD


def pack(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset of each piece (in the given order, none larger than the largest length) and the final bin capacities."""
    order = np.argsort(-sizes, kind="stable")
    best = None
    for top in [None, *lengths]:
        if top is not None and top < sizes[order[0]]:
            continue
        got = _best_fit(sizes, order, lengths, top)
        if best is None or got[3] < best[3] - 1e-9:
            best = got
    return best[:3]


def _best_fit(sizes: np.ndarray, order: np.ndarray, lengths: tuple[int, ...], top: int | None):
    """One packing; ``top`` None opens the least-cost size, otherwise always ``top``."""
    caps = np.array(lengths, np.int64)
    total = int(sizes.sum())
    free: list[tuple[int, int]] = []     # (room, bin), sorted
    room: list[int] = []
    fill: list[int] = []
    where = np.empty(len(sizes), np.int64)
    offset = np.empty(len(sizes), np.int64)
    for i in order.tolist():
        s = int(sizes[i])
        at = bisect_left(free, (s, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            if top is None:
                able = caps[caps >= s]
                left = int(able[np.argmin(cost(able) / np.minimum(able, total))])
            else:
                left = top
            b = len(fill)
            fill.append(0)
            room.append(left)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        total -= s
        if left > s:
            insort(free, (left - s, b))
    final = caps[np.searchsorted(caps, np.array(fill))]
    return where, offset, final, float(cost(final).sum())


def word_count(col: str = "text") -> Column:
    """Words of a text: the length in tokens where no tokenizer is asked for."""
    return F.regexp_count(no_text(col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def piece_texts(docs: DataFrame, top: int = LENGTHS[-1]) -> DataFrame:
    """``id`` (see ``id_key``), ``text_key``, ``piece`` and ``text``, the words of the piece joined by a space, once for each id and text.

    The rows are dealt by the three key columns; a join on just these takes them as they lie, so that texts move once.
    """
    words = F.regexp_extract_all(no_text(), F.lit(r"([^\x20\x09-\x0D]+)"))
    rows = docs.select(id_key().alias("id"), F.xxhash64(no_text()).alias("text_key"), words.alias("w"))
    n = F.greatest(F.ceil(F.size("w") / top), F.lit(1)).cast("int")
    cut_up = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(F.col("w"), k * top + 1, F.lit(top)), " "))
    pieces = rows.select("id", "text_key", F.posexplode(cut_up).alias("piece", "text"))
    return pieces.groupBy("id", "text_key", "piece").agg(F.first("text").alias("text"))


def pack_documents(docs: DataFrame, length: Column | None = None, lengths: tuple[int, ...] = LENGTHS,
                   shard_pieces: int = SHARD_PIECES, keyed: bool = False) -> DataFrame:
    """One row for each piece: ``doc_id``, ``piece``, ``start`` and ``length`` in the document, ``bin_id``, ``bin_length``, ``offset``.

    ``length`` gives the tokens of a row (default: words). Bins of a shard are numbered from
    ``shard * 2**32``, so bin ids are unique in the result. With ``keyed`` the hash of the text comes along as ``text_key``.
    """
    lengths = tuple(sorted(set(lengths)))
    top = lengths[-1]
    # only ids, lengths and a hash that tells rows apart go on
    rows = docs.select(id_key().alias("id"), (length if length is not None else word_count()).alias("n"), F.xxhash64(no_text()).alias("h"))
    pieces = cut(rows.select("id", "n", "h", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top), F.lit(1)).cast("int") - 1)).alias("piece"))
                 .select("id", "h", "piece", (F.col("piece") * F.lit(top)).cast("long").alias("start"),
                         F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * F.lit(top)).alias("length")))
    shards = parts_for(pieces.where("length > 0").count(), shard_pieces)
    full = (pieces.where("length > 0")
            # the row number of the written table spreads copies without an id of their own
            .withColumn("shard", F.pmod(F.xxhash64("id", "h", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("long")))
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("bin_id", pa.int64()), ("bin_length", pa.int64()), ("offset", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        # the same bins whatever the order of arrival
        t = t.sort_by([("id", "ascending"), ("h", "ascending"), ("piece", "ascending")])
        where, offset, final = pack(t.column("length").to_numpy(), lengths)
        shard = t.column("shard")[0].as_py()
        return pa.Table.from_batches([batch_of(schema, *(t.column(c).combine_chunks() for c in ("id", "h", "piece", "start", "length")),
                                               where + shard * 2**32, final[where], offset)])

    ddl = "id long, h long, piece int, start long, length long, bin_id long, bin_length long, offset long"
    packed = full.groupBy("shard").applyInArrow(run, ddl)
    empty = pieces.where("length = 0").select("id", "h", "piece", "start", "length", F.lit(None).cast("long").alias("bin_id"),
                                              F.lit(None).cast("long").alias("bin_length"), F.lit(None).cast("long").alias("offset"))
    key = [F.col("h").alias("text_key")] if keyed else []
    return packed.unionByName(empty).select(id_back("id").alias("doc_id"), *key, "piece", "start", "length", "bin_id", "bin_length", "offset")
