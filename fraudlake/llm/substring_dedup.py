"""Substring dedup by seed and extend.

Words that lie in a repeat of at least ``WINDOW`` words, which also starts earlier (smaller id, or the same
document and an earlier word), are removed. Seeds are winnowed anchors: of the ``SEED_WORDS``-word runs in a
window the one with the smallest hash, so that equal windows have equal anchors. Consecutive windows with one anchor
form a stretch, the anchor extended both ways as far as its windows reach.

1. Every stretch sends its anchor, a hash of all its words, and its place. Where anchors meet, stretches
   of equal words are copies: all but the first are removed whole. An anchor with one kind of stretch is settled.
2. First stretches whose anchor has other extensions too are compared window by window, again by a hash of
   their words; all but the first of equal windows are removed.

The union of removed windows is the set of maximal repeats; words outside it are kept. Windows are judged on the input.
Hashes have 128 bits together, so different words never meet in practice.

Rows travel in packed blocks, dealt by hash. A task keeps only the first of equal stretches before it sends, so a passage
that thousands share arrives about once from every task. No group is ever expanded into pairs.

A document is an id, which may be null, and a hash of its text: rows that agree in both are copies of one document, and a
position removed in one is removed in all. Other rows that share an id, or have none, are documents of their own,
in the order of the hash. Null texts have no words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import GOLD, Codes, batch_of, id_back, id_key, mix, no_text, parts_for, run_hashes, split_words
from fraudlake.session import cut

WINDOW = 20
SEED_WORDS = 8
DOCS_PER_GROUP = 128
DOCS_PER_TASK = 4_000
BLOCKS = 4096
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
PLACE = (np.int64, np.int64, np.int32, np.int32)          # id, hash of the text, first window, windows
KEYED = (np.uint64, np.uint64, *PLACE)                    # two hashes, place
BLOCK_DDL = "b int, kind int, blob binary"
BLOCK = pa.schema([("b", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
OPEN, GONE, UNSURE = 0, 1, 2


def to_blob(cols) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in cols)


def from_blobs(blobs: list[bytes], kinds) -> list[np.ndarray]:
    """The columns of packed blocks, one after the other."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for p, k in zip(parts, kinds):
            p.append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def blocks(key: np.ndarray, kind: int, cols: list[np.ndarray]):
    """(key, kind, packed rows) for each value of ``key``; rows keep their order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
    for a, b in zip(starts, [*starts[1:], len(key)]):
        own = order[a:b]
        yield int(key[a]), kind, to_blob([c[own] for c in cols])


def sent(rows) -> pa.RecordBatch:
    rows = list(rows)
    return batch_of(BLOCK, *(zip(*rows) if rows else ([], [], [])))


def spread(place) -> np.ndarray:
    """A long for each document, which deals rows without an id by their text."""
    return place[0] ^ place[1]


class Powers:
    """Powers of the two bases and of their inverses modulo 2**64, grown as texts need them."""

    def __init__(self):
        self.n = 0

    def of(self, n: int):
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            self.up, self.down = [], []
            with np.errstate(over="ignore"):
                for base in BASES:
                    inv = np.uint64(pow(int(base), -1, 1 << 64))
                    self.up.append(np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.n, base)))))
                    self.down.append(np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.n, inv)))))
        return self.up, self.down


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers, which: int) -> np.ndarray:
    """A hash of the words start..end of each span; equal words give equal hashes wherever they stand."""
    up, down = powers.of(len(codes))
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(codes * up[which][:len(codes)], dtype=np.uint64)))
        return mix((total[end] - total[start]) * down[which][start] + (end - start).astype(np.uint64) * GOLD)


def stretches(codes: np.ndarray, powers: Powers, window: int, seed: int):
    """Anchor hash, hash of the stretch, first window, windows of every stretch of one document."""
    n_windows = len(codes) - window + 1
    grams = run_hashes(codes, seed)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - seed + 1).argmin(axis=1) + np.arange(n_windows)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [n_windows])))
    anchor = grams[at[first]]
    body = span_hashes(codes, first, first + count - 1 + window, powers, 0)
    # where the anchor stands in the stretch belongs to it
    return anchor, mix(body + (at[first] - first).astype(np.uint64)), first.astype(np.int32), count.astype(np.int32)


def firsts(x: np.ndarray, y: np.ndarray, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (x, y, place); whether a row begins a new x, a new (x, y). Repeated places count once, as the first."""
    order = np.lexsort((place[2], place[1], place[0], y, x))
    a, b = x[order], y[order]
    new_x = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
    new_xy = new_x | np.concatenate(([True], b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return order, new_x, new_xy


def same_place(order: np.ndarray, new_xy: np.ndarray, place) -> np.ndarray:
    """Rows at the place of the first row of their group (one document that came twice)."""
    head = np.maximum.accumulate(np.where(new_xy, np.arange(len(order)), 0))
    i, h, p = (c[order] for c in place[:3])
    return (i == i[head]) & (h == h[head]) & (p == p[head])


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept`` (kept words joined by a space) of every row."""
    n_docs = docs.count()
    tasks = parts_for(n_docs, DOCS_PER_TASK)
    n_blocks = max(BLOCKS, 16 * tasks)
    groups = _prime(parts_for(n_docs, DOCS_PER_GROUP))
    rows = docs.select(id_key().alias("id"), F.xxhash64(no_text()).alias("h"), "text")
    grouped = rows.withColumn("b", F.pmod(F.col("id").bitwiseXOR(F.col("h")), F.lit(groups)).cast("int"))

    def send(x, y, place):
        """Blocks by hash: the first of equal rows goes on, others are gone already."""
        order, _, new = firsts(x, y, place)
        stay = np.sort(order[new])
        gone = np.sort(order[~new & ~same_place(order, new, place)])
        out = list(blocks(mix(x[stay]) % np.uint64(n_blocks), OPEN, [x[stay], y[stay], *(p[stay] for p in place)]))
        return sent([*out, *blocks(mix(spread(place)[gone].view(np.uint64)) % np.uint64(n_blocks), GONE, [p[gone] for p in place])])

    def seeds(batches):
        cache, powers = Codes(), Powers()
        for b in batches:
            got = []
            for *doc, text in zip(b.column("id").to_pylist(), b.column("h").to_pylist(), b.column("text").to_pylist()):
                words = split_words(text)
                if len(words) >= window:
                    got.append((*map(np.int64, doc), *stretches(cache.of(words), powers, window, seed)))
            if got:
                place = (*(np.concatenate([np.full(len(g[2]), g[k]) for g in got]) for k in (0, 1)), *(np.concatenate([g[k] for g in got]) for k in (4, 5)))
                yield send(np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got]), place)

    def settle(unsure: bool):
        def run(batches):
            got = {OPEN: [], GONE: []}
            for b in batches:
                for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist()):
                    got[kind].append(blob)
            x, y, *place = from_blobs(got[OPEN], KEYED)
            order, new_x, new = firsts(x, y, place)
            away = order[~new & ~same_place(order, new, place)]
            gone = [np.concatenate((p, q[away])) for p, q in zip(from_blobs(got[GONE], PLACE), place)]
            out = list(blocks(spread(gone) % groups, GONE, gone))
            if unsure and len(order):
                kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_x))
                open_ = order[new & (kinds[np.cumsum(new_x) - 1] > 1)]
                out += blocks(spread(place)[open_] % groups, UNSURE, [p[open_] for p in place])
            if out:
                yield sent(out)
        return run

    def by_document(t: pa.Table) -> dict[tuple[int, int], list[np.ndarray]]:
        """Places of each document of a group."""
        i, h, first, n = from_blobs(t.column("blob").to_pylist(), PLACE)
        order = np.lexsort((h, i))
        i, h, first, n = i[order], h[order], first[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (h[1:] != h[:-1])))) if len(i) else []
        return {(int(i[a]), int(h[a])): [first[a:b], n[a:b]] for a, b in zip(starts, [*starts[1:], len(i)])}

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        """Windows of the unsure stretches of a group of documents."""
        places, cache, powers, got = by_document(right), Codes(), Powers(), []
        for i, h, text in zip(left.column("id").to_pylist(), left.column("h").to_pylist(), left.column("text").to_pylist()):
            if (i, h) in places:
                codes = cache.of(split_words(text))
                first, n = places[i, h]
                at = np.unique(np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())).astype(np.int64)
                at = at[at + window <= len(codes)]
                got.append((np.full(len(at), np.int64(i)), np.full(len(at), np.int64(h)), span_hashes(codes, at, at + window, powers, 0),
                            span_hashes(codes, at, at + window, powers, 1), at.astype(np.int32)))
        if not got:
            return pa.Table.from_batches([sent([])])
        place = (*(np.concatenate([g[k] for g in got]) for k in (0, 1, 4)), np.ones(sum(len(g[0]) for g in got), np.int32))
        return pa.Table.from_batches([send(np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got]), place)])

    final = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        places, out = by_document(right), []
        for i, h, text in zip(left.column("id").to_pylist(), left.column("h").to_pylist(), left.column("text").to_pylist()):
            words = split_words(text)
            if (i, h) in places and words:
                first, n = places[i, h]
                ends = np.minimum(first.astype(np.int64) + n + window - 1, len(words))
                step = np.bincount(np.minimum(first, len(words)), minlength=len(words) + 1) - np.bincount(ends, minlength=len(words) + 1)
                live = np.cumsum(step[:-1]) <= 0
                kept = b" ".join([w for w, k in zip(words, live.tolist()) if k])
                out.append((i, len(words), int(len(words) - live.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            else:
                kept = b" ".join(words)
                out.append((i, len(words), 0, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        return pa.Table.from_batches([batch_of(final, *(zip(*out) if out else [[]] * 5))])

    seeded = rows.mapInArrow(seeds, BLOCK_DDL)
    one = cut(seeded.repartition(tasks, "b").mapInArrow(settle(True), BLOCK_DDL))
    windows = grouped.groupBy("b").cogroup(one.where(F.col("kind") == UNSURE).groupBy("b")).applyInArrow(extend, BLOCK_DDL)
    two = cut(windows.repartition(tasks, "b").mapInArrow(settle(False), BLOCK_DDL))
    gone = one.where(F.col("kind") == GONE).unionByName(two)
    out = grouped.groupBy("b").cogroup(gone.groupBy("b")).applyInArrow(keep, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(id_back("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")


def _prime(n: int) -> int:
    """The smallest prime from ``n`` on."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM w, unnest(range(1, len(ws) - 18)) t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS k FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY 1)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
"""
