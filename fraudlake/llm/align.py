"""Alignment of the tokens of two tokenizers, and how often token pairs meet in a corpus.

Both tokenizers cut the same bytes (a space and the text). Byte offsets where a token of A and a token of B both end
cut the tokens into groups. The texts of a block are laid behind one another, so that all their ends form two sorted lists, and
the lists are merged by merge-path partitioning: equally spaced diagonals of the merge grid are located by
binary search, which gives pieces of equal work whatever the lengths of texts. A piece merges its own stretch of
both lists and emits the ends that both have; the stitch adds an end shared across a boundary and turns the counts of pieces into
group numbers. Tokens that share a group are linked.

Counts of pairs go through three steps, none of which moves a row for each link: a block reports its distinct pairs with the number of its
documents that hold each; pairs are summed over blocks; every block gets the counts of its own pairs back and turns them into figures of
its documents. A block ends at ``BLOCK_TOKENS`` tokens (a longer text is a block of its own), so its size does not follow the
input. In a group all pairs of *distinct* ids are listed, with their numbers of occurrences as a weight; this is what a
count for each id pair asks for. Texts are tokenized in chunks cut before single spaces, where no token of either vocabulary can cross.

A null or empty text has no tokens, nor has one whose tokens give other bytes back (for instance with U+2581 in it): figures are
zero and the listing is empty. Rows that repeat an id or a text each count as a document. A null id comes back as null. Ties for the highest count all count.
A very long text is handled whole. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fraudlake.llm.common import id_back, id_key
from fraudlake.session import cut

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_TOKENS = 1_500_000
PIECE_WORK = 1 << 16        # steps of the merge in one piece
CHUNK_CHARS = 1 << 15       # texts are tokenized in chunks of about this size
PAIR_STEP = 1 << 22         # entries of pairs made at a time
LONG_RUN = 2_000            # characters without a cut from which on time may grow with the square in the fast encoder
# Fixed value: how a byte-level vocabulary splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary file. Its ids follow the order of its merges, which is all that the fast encoder needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = byte_alphabet()
        self.path, self.slow = path, None
        self.pieces = {i: bytes(map(back.__getitem__, s)) for s, i in model["vocab"].items() if all(c in back for c in s)}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"][m.replace(" ", "", 1)] for m in merges]
        self.fast = None
        if ids == sorted(ids):
            known = {b: i for i, b in self.pieces.items() if len(b) == 1} | {self.pieces[i]: i for i in ids}
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text. Texts with a very long run without a cut go to the encoder whose time stays linear there."""
        out, rest = [], []
        for text in texts:
            if self.fast and (len(text) < LONG_RUN or (max(map(len, text.split(" "))) < LONG_RUN and " " * LONG_RUN not in text)):
                out.append(self.fast.encode_ordinary(" " + text))
            else:
                rest.append(len(out))
                out.append(" " + text)
        if rest:
            if not self.slow:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark already runs one task for each core
                self.slow = Tokenizer.from_file(self.path)
                self.slow.encode_special_tokens = True
            for k, e in zip(rest, self.slow.encode_batch_fast([out[k] for k in rest], add_special_tokens=False)):
                out[k] = e.ids
        return out


class Vocabulary:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            t = ByteLevel(path)
            pieces = t.pieces
            self._ids = t.ids
        else:
            t = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = {i: bytes([int(t.id_to_piece(i)[3:5], 16)]) if t.is_byte(i) else t.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(t.vocab_size())}
            self._ids = lambda texts: t.encode(texts, num_threads=1)
        self.size = max(pieces) + 1
        self.bytes = [pieces.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.bytes])
        # chunks may be cut between a character and a space only if no token holds both
        self.splits = not any(re.search(r"\S ", b.decode("utf-8", "replace")) for b in self.bytes)

    def encode(self, texts: list[str], chunk: int = CHUNK_CHARS) -> list[np.ndarray]:
        """Ids of a space and each text."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            got = chunks_of(text, chunk) if self.splits else [text]
            parts += got
            owner += [k] * len(got)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, ids in zip(owner, self._ids(parts)):
            out[k].append(np.array(ids, np.int64))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def chunks_of(text: str, size: int) -> list[str]:
    """``text`` cut at single spaces (which are left out: tokenizers put one before each chunk) into parts of about ``size``."""
    out, start = [], 0
    while len(text) - start > size:
        m = SAFE_CUT.search(text, start + size)
        if not m:
            break
        out.append(text[start:m.start()])
        start = m.end()
    out.append(text[start:])
    return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once for each Python worker."""
    return Vocabulary(path)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where equally spaced diagonals cross the merge path: ``i`` ends of ``a`` and ``j`` ends of ``b`` come first.

    Of equal ends that of ``a`` comes first. All diagonals are searched at the same time.
    """
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        # a[mid] is taken before b[d - mid - 1] if it is not larger
        first = np.zeros(len(d), bool)
        first[open_] = a[mid[open_]] <= b[(d - mid - 1)[open_]]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """One piece: shared ends before each end of ``a`` and of ``b``, and their number in the piece."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = both[1:][both[1:] == both[:-1]]
    return np.searchsorted(shared, a), np.searchsorted(shared, b), len(shared)


def group_numbers(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray]:
    """Group of every token, from the strictly rising ends of both lists: how many shared ends come before its own."""
    at, bt = diagonals(a, b, work)
    ga, gb = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    before = 0
    for i, i2, j, j2 in zip(at[:-1], at[1:], bt[:-1], bt[1:]):
        x, y = a[i:i2], b[j:j2]
        if i and len(y) and a[i - 1] == y[0]:
            # the boundary parts the two halves of a shared end: it closes the group that the last piece left open
            gb[j] = before
            y, j, before = y[1:], j + 1, before + 1
        ka, kb, n = overlaps(x, y)
        ga[i:i2], gb[j:j2] = ka + before, kb + before
        before += n
    return ga, gb


@dataclass
class Block:
    """Aligned documents that lie behind one another."""

    ids: list = field(default_factory=list)
    a: list[np.ndarray] = field(default_factory=list)
    b: list[np.ndarray] = field(default_factory=list)
    tokens: int = 0

    def add(self, doc_id, a: np.ndarray, b: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.a.append(a)
        self.b.append(b)
        self.tokens += len(a) + len(b)


def spans(x: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(v) for v in x])))


def counted(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of occurrences, sorted; ``group`` is sorted already."""
    key, n = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, n


def weighted_pairs(ga, ida, na, gb, idb, nb, doc_of_group: np.ndarray, size_b: int):
    """Distinct (document, pair) with the number of links, from the distinct ids of each group."""
    width = np.bincount(gb, minlength=len(doc_of_group))[ga]         # partners of each id of A
    first = np.searchsorted(gb, ga)
    ends = np.cumsum(width)
    keys, weights = [], []
    start = 0
    while start < len(ga):
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIR_STEP)), start + 1)
        w = width[start:stop]
        left = np.repeat(np.arange(start, stop), w)
        right = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[start:stop], w)
        pair = (doc_of_group[ga[left]] << 32) | (ida[left] * size_b + idb[right])
        got, back = np.unique(pair, return_inverse=True)
        keys.append(got)
        weights.append(np.bincount(back, na[left] * nb[right], len(got)).astype(np.int64))
        start = stop
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, weight = np.concatenate(keys), np.concatenate(weights)
    if len(keys) > 1:
        key, back = np.unique(key, return_inverse=True)
        weight = np.bincount(back, weight, len(key)).astype(np.int64)
    return key >> 32, key & 0xFFFFFFFF, weight


def listing(ga, a, gb, b, tokens_a: np.ndarray, tokens_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray) -> list[bytes]:
    """For each document ``a1,a2|b1;a3|b2,b3``: ids of each group, groups in order."""
    n, group = len(a), np.concatenate((ga, gb))
    order = np.lexsort((np.repeat((0, 1), (n, len(b))), group))
    side, group = order >= n, group[order]
    # 0: first of a document, 1: next of the same side, 2: other side, 3: next group
    lead = np.ones(len(order), np.int64)
    lead[1:] = np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1))
    starts = doc_a + doc_b
    lead[starts[:-1][starts[:-1] < starts[1:]]] = 0
    words = np.where(side, tokens_b[lead, np.concatenate((a, b))[order] * side], tokens_a[lead, np.concatenate((a, b))[order] * ~side]).tolist()
    return [b"".join(words[i:j]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]


@lru_cache(maxsize=4)
def written_ids(size: int) -> np.ndarray:
    """Decimal ids behind nothing, a comma, a bar and a semicolon."""
    return np.array([[f"{lead}{i}".encode() for i in range(size)] for lead in ("", ",", "|", ";")], object)


def align(block: Block, size_a: int, size_b: int, lengths_a: np.ndarray, lengths_b: np.ndarray, work: int = PIECE_WORK):
    """``figures`` (n_a, n_b, n_groups, n_links and listing of each document) and its distinct pairs (document, pair, links)."""
    a, b, da, db = np.concatenate(block.a), np.concatenate(block.b), spans(block.a), spans(block.b)
    ga, gb = group_numbers(np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b]), work)
    docs, groups = len(block.ids), int(ga[-1]) + 1 if len(ga) else 0
    # every document ends where a group does
    doc_of_group = np.empty(groups, np.int64)
    doc_of_group[ga] = np.repeat(np.arange(docs), np.diff(da))
    in_group = np.bincount(ga, minlength=groups) * np.bincount(gb, minlength=groups)
    n_groups = np.bincount(doc_of_group, minlength=docs)
    n_links = np.bincount(doc_of_group, in_group, docs).astype(np.int64)
    lines = listing(ga, a, gb, b, written_ids(size_a), written_ids(size_b), da, db)
    pairs = weighted_pairs(*counted(ga, a, size_a), *counted(gb, b, size_b), doc_of_group, size_b)
    return (np.diff(da), np.diff(db), n_groups, n_links, lines), pairs


DDL = ("block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, links binary, "
       "pairs array<int>, docs array<int>")
SCHEMA = pa.schema([("block", pa.int64()), ("id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
                    ("at", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32()))])
FIGURES = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of documents (``pairs`` null: where its pairs stand among those of the block, and how many links each has) and one row
    for each block (``id`` and figures null) with its distinct pairs and the number of documents that hold them."""

    def rows_of(block: Block, number: int, va: Vocabulary, vb: Vocabulary) -> pa.RecordBatch:
        (n_a, n_b, n_groups, n_links, lines), (doc, pair, links) = align(block, va.size, vb.size, va.lengths, vb.lengths)
        known, at, held = np.unique(pair, return_inverse=True, return_counts=True)
        ends = np.searchsorted(doc, np.arange(len(block.ids) + 1)).tolist()
        at, links = at.astype(np.int32), links.astype(np.int32 if not len(links) or links.max() < 1 << 31 else np.int64)
        wide = links.dtype.itemsize
        cuts = list(zip(ends[:-1], ends[1:]))
        one = [None]
        cols = [[number] * (len(block.ids) + 1), block.ids + one, *([*x.tolist(), None] for x in (n_a, n_b, n_groups, n_links)),
                [sha256(x).hexdigest() if x else "" for x in lines] + one,
                [at[i:j].tobytes() for i, j in cuts] + one,
                [bytes([wide]) + links[i:j].tobytes() for i, j in cuts] + one,
                [None] * len(block.ids) + [known.astype(np.int32)], [None] * len(block.ids) + [held.astype(np.int32)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)

    def run(batches):
        va, vb = vocabulary(path_a), vocabulary(path_b)
        if va.size * vb.size >= 1 << 31:
            raise ValueError("pairs of ids do not fit the codes")
        number, block, none = TaskContext.get().partitionId() << 32, Block(), np.zeros(0, np.int64)
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            start = 0
            while start < len(texts):
                stop, chars = start, 0          # tokenize a bounded amount at a time
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= block_tokens):
                    chars += len(texts[stop])
                    stop += 1
                some = texts[start:stop]
                for i, text, a, b in zip(ids[start:stop], some, va.encode(some), vb.encode(some)):
                    data = b" " + text.encode()
                    if not text or va.decode(a) != data or vb.decode(b) != data:
                        a = b = none
                    if block.ids and block.tokens + len(a) + len(b) > block_tokens:
                        yield rows_of(block, number, va, vb)
                        number, block = number + 1, Block()
                    block.add(i, a, b)
                start = stop
        if block.ids:
            yield rows_of(block, number, va, vb)

    return docs.select(id_key().alias("id"), "text").mapInArrow(run, DDL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair`` (id of A times the size of B, plus id of B) and ``n``, the documents that hold it linked."""
    return (blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
            .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n")))


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    """``counts`` with ``best``: no pair with the same id of A has a higher count."""
    coded = counts.withColumn("a", F.floor(F.col("pair") / F.lit(size_b)))
    top = coded.groupBy("a").agg(F.max("n").alias("top"))
    return coded.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def figures(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each document: its figures, the links of the highest count and the sum of counts over its links."""
    asked = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("at", "pair"))
    # every block gets back, for its own pairs, the counts in the order of its list
    answers = asked.join(counts, "pair").select(F.col("block").alias("to"), F.col("at").alias("place"), "n", "best")

    def run(t: pa.Table, answer: pa.Table) -> pa.Table:
        n, best = np.zeros(answer.num_rows, np.int64), np.zeros(answer.num_rows, bool)
        at = answer.column("place").to_numpy()
        n[at], best[at] = answer.column("n").to_numpy(), answer.column("best").to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for where, links in zip(t.column("at").to_pylist(), t.column("links").to_pylist()):
            where, links = np.frombuffer(where, np.int32), np.frombuffer(links[1:], np.int32 if links[0] == 4 else np.int64).astype(np.int64)
            n_best.append(int(links[best[where]].sum()))
            total.append(int(links @ n[where]))
        cols = [t.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*cols, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), t.column("groups_sha256")],
                        ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = blocks.where("pairs is null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "links")
    return rows.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(run, FIGURES)


def paths(folder: str = FOLDER) -> tuple[str, str]:
    return f"{folder}/{FILE_A}", f"{folder}/{FILE_B}"


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each row of ``docs``: figures of its alignment and of its pairs in the whole corpus."""
    path_a, path_b = path_a or paths()[0], path_b or paths()[1]
    blocks = cut(aligned_blocks(docs, path_a, path_b, block_tokens))
    counts = cut(with_best(pair_counts(blocks), vocabulary(path_b).size))
    return figures(blocks, counts).select(id_back("id").alias("doc_id"), *[c.split()[0] for c in FIGURES.split(", ")[1:]])


def pair_table(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``a``, ``b``, ``n`` and ``best`` of every pair of ids linked somewhere: the translation table of the two vocabularies."""
    path_a, path_b = path_a or paths()[0], path_b or paths()[1]
    size = vocabulary(path_b).size
    got = with_best(pair_counts(cut(aligned_blocks(docs, path_a, path_b))), size)
    return got.select(F.floor(F.col("pair") / F.lit(size)).alias("a"), (F.col("pair") % F.lit(size)).cast("long").alias("b"), "n", "best")
