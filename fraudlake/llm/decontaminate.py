"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A document holds a benchmark item when one of its windows, as long as the item, has a weighted
similarity of ``THRESHOLD`` or more: the sum of the smaller shingle counts over the sum of the
larger ones, on five-word shingles (items of fewer words: their whole sequence). Every window that
can reach that is fingerprinted; a window with fewer shingles of the benchmark than the threshold
asks for cannot. The fingerprints are looked up in eight one-byte blocks: with 23 differing bits or
fewer, one byte differs by two bits or fewer, so the probes of all bytes within two bits
find every item in the radius. Candidates are then compared exactly.

Items go to every task in blocks of ``MAX_ITEMS``; a larger benchmark takes several passes, and no
pass holds more than one block. Words are compared with A-Z lower-cased. Null and empty texts
and items hold nothing. Rows that repeat a document are answered one by one; a document row
and an item give one row, that of the best window (the first of equals).
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fraudlake.llm.common import Codes, bit_counts, free_name, id_back, id_key, parts_for, run_hashes, words_lower

SHINGLE = 5
THRESHOLD = 0.8
BYTE_RADIUS = 2
RADIUS = 8 * (BYTE_RADIUS + 1) - 1
MAX_ITEMS = 2_000
# For each byte value, the byte values within BYTE_RADIUS bits of it.
NEAR_BYTES = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= BYTE_RADIUS


def fingerprint(h: np.ndarray) -> np.uint64:
    return np.packbits(bit_counts(h) * 2 > len(h), bitorder="little").view(np.uint64)[0]


class Group:
    """Items of one size (shingles) with the byte tables of their fingerprints."""

    def __init__(self, ids: list[int], hashes: list[np.ndarray]):
        self.ids, self.size = ids, len(hashes[0])
        self.fps = np.array([fingerprint(h) for h in hashes], np.uint64)
        self.counts = [Counter(h.tolist()) for h in hashes]
        own = self.fps.view(np.uint8).reshape(-1, 8)
        self.tables = [NEAR_BYTES[:, own[:, k]] for k in range(8)]

    def candidates(self, fps: np.ndarray):
        """(window, item) pairs within the radius."""
        for at in range(0, len(fps), 4096):
            part = fps[at:at + 4096]
            own = part.view(np.uint8).reshape(-1, 8)
            near = self.tables[0][own[:, 0]].copy()
            for k in range(1, 8):
                near |= self.tables[k][own[:, k]]
            w, i = np.nonzero(near)
            hit = np.bitwise_count(part[w] ^ self.fps[i]) <= RADIUS
            yield from zip((w[hit] + at).tolist(), i[hit].tolist())


class Matcher:
    def __init__(self, items: list[tuple[int, str | None]], shingle: int = SHINGLE, threshold: float = THRESHOLD):
        self.threshold, cache = threshold, Codes()
        by: dict[tuple[int, int], list] = defaultdict(list)
        for item, text in items:
            words = words_lower(text)
            if words:
                k = min(shingle, len(words))
                h = run_hashes(cache.of(words), k)
                by[k, len(h)].append((item, h))
        self.groups: dict[int, list[Group]] = defaultdict(list)
        seeds: dict[int, list[np.ndarray]] = defaultdict(list)
        for (k, _), rows in sorted(by.items()):
            self.groups[k].append(Group([r[0] for r in rows], [r[1] for r in rows]))
            seeds[k] += [r[1] for r in rows]
        self.seeds = {k: np.unique(np.concatenate(v)) for k, v in seeds.items()}

    def find(self, text: str | None, cache: Codes) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, windows at or over the threshold) of one text."""
        words = words_lower(text)
        if not words or not self.seeds:
            return []
        codes, out = cache.of(words), []
        for k, seeds in self.seeds.items():
            h = run_hashes(codes, k)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
            seeded = np.concatenate(([0], np.cumsum(seeds[at] == h)))
            if not seeded[-1]:
                continue
            votes = None
            for g in self.groups[k]:
                m = min(g.size, len(h))
                n = seeded[m:] - seeded[:-m]
                starts = np.flatnonzero(n >= self.threshold * g.size - 1e-9)
                if not len(starts):
                    continue
                if votes is None:
                    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    votes = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
                fps = np.packbits((votes[starts + m] - votes[starts]) * 2 > m, axis=1, bitorder="little").view(np.uint64).ravel()
                best: dict[int, list] = {}
                for w, i in g.candidates(fps):
                    s = int(starts[w])
                    there = Counter(h[s:s + m].tolist())
                    both = sum(min(c, there.get(x, 0)) for x, c in g.counts[i].items())
                    sim = both / (g.size + m - both)
                    if sim >= self.threshold - 1e-12:
                        b = best.setdefault(i, [-1.0, 0, 0])
                        b[2] += 1
                        if sim > b[0]:
                            b[0], b[1] = sim, s
                out += [(g.ids[i], sim, s, m + k - 1, n_win) for i, (sim, s, n_win) in best.items()]
        return out


def matchers(items: DataFrame, max_items: int = MAX_ITEMS):
    """One matcher for each block of items, made as it is asked for."""
    n = items.count()
    blocks = parts_for(n, max_items)
    rows = items.select(id_key("item_id").alias("item"), "text")
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # about max_items short texts
        yield Matcher(sorted(((r["item"], r["text"]) for r in part), key=lambda r: (r[0], r[1] or "")))


def matches(docs: DataFrame, items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``start_word``, ``n_words``, ``n_windows`` of every contaminated document."""
    out = None
    rows = docs.select(id_key().alias("id"), "text")
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()),
                        ("n_words", pa.int64()), ("n_windows", pa.int64())])
    for matcher in matchers(items, max_items):
        sent = docs.sparkSession.sparkContext.broadcast(matcher)  # at most max_items items

        def run(batches, sent=sent):
            cache = Codes()
            for b in batches:
                found = [(i, *m) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) for m in sent.value.find(t, cache)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        part = rows.mapInArrow(run, "id long, item long, similarity double, start_word long, n_words long, n_windows long")
        out = part if out is None else out.unionByName(part)
    return out.select(id_back("id").alias("doc_id"), id_back("item").alias("item_id"), "similarity", "start_word", "n_words", "n_windows")


def clean(docs: DataFrame, items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns; no shuffle."""
    mark = free_name(docs, "_n_items")
    for matcher in matchers(items, max_items):
        sent = docs.sparkSession.sparkContext.broadcast(matcher)
        out = StructType([*docs.schema.fields, StructField(mark, IntegerType())])

        def run(batches, sent=sent):
            cache = Codes()
            for b in batches:
                n = [len(sent.value.find(t, cache)) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], names=[*b.schema.names, mark])

        docs = docs.mapInArrow(run, out).where(F.col(mark) == 0).drop(mark)
    return docs
