"""SimHash near-duplicates by BK-trees.

A fingerprint bit is set when more than half of a document's shingle hashes have it. Distinct
fingerprints are dealt to shards in which every pair within the radius meets; a shard holds one
BK-tree for each of its keys (children keyed by their integer distance to the parent), and a
search follows only the edges that can lead to a fingerprint within the radius. Each task sends
on a spanning forest of its links, and the components of all forests are the groups.

Shard keys: ``block_keys`` cuts the bits into radius + 1 blocks, so that a pair within the
radius agrees on one (exact); keys that hold more than ``MAX_TREE`` fingerprints are cut again by
the bits they leave free. ``minhash_keys`` takes the smallest shingle hash under several hash
functions, for radii too wide for blocks: texts of similarity s miss each other with probability
(1 - s) ** n_keys. A tree of more than ``MAX_TREE`` fingerprints is cut into pieces, and every
piece is searched by all of the others. Trees are sent to the tasks that search them by the
shuffle, so nothing is broadcast.

With a least similarity a pair within the radius is a candidate only. Candidate pairs make up groups, every text of a
group is dealt once more to it, now with its set of shingles, and a pair is linked when its sets are that similar (Jaccard).

A null text counts as empty; empty texts and texts without words share fingerprint zero and an empty set, and are copies of each other. A very
long text is read whole; its set has eight bytes for each distinct shingle. Ties for the row that stays go to the smaller text hash. An empty table
gives an empty result. Other columns are carried through by ``keep_one``, whatever their names and types.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import NULL_ID, bit_counts, batch_of, id_back, id_key, mix, no_text, pack_bits, parts_for, shingle_hashes, words_lower
from fraudlake.llm.graph import components
from fraudlake.session import cut, small

MAX_TREE = 20_000
ROWS_PER_TASK = 30_000
# Shingles of the sets that one task, or one piece of a key, compares.
SHINGLES_PER_TASK = 4_000_000


def text_key() -> Column:
    return F.xxhash64(no_text())


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, n_keys: int = 0, sets: bool = False) -> DataFrame:
    """``id``, ``text_key``, fingerprint words ``f0`` .. and, with ``n_keys``, the smallest shingle hashes ``keys`` of each row.

    Null and empty texts have fingerprint zero. A-Z is lower-cased, other letters stay. With ``sets`` a repeated shingle counts once.
    """
    w = bits // 64
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64())] + [(f"f{k}", pa.int64()) for k in range(w)] + [("keys", pa.list_(pa.int64()))])
    odd = mix(np.arange(1, n_keys + 1, dtype=np.uint64) * np.uint64(7919)) | np.uint64(1)

    def one(text: str | None):
        h = shingle_hashes(words_lower(text), words)
        h = np.unique(h) if sets else h
        with np.errstate(over="ignore"):
            wide = [h, *(mix(h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) for k in range(1, w))]
            fp = [pack_bits(bit_counts(x) * 2 > len(h)) if len(h) else 0 for x in wide]
            keys = [int((mix(h * o) if len(h) else np.zeros(1, np.uint64)).min().astype(np.int64)) for o in odd]
        return *fp, keys

    def run(batches):
        for b in batches:
            seen: dict = {}
            rows = []
            for text in b.column("text").to_pylist():
                if text not in seen:
                    seen[text] = one(text)
                rows.append(seen[text])
            yield batch_of(schema, b.column("id"), b.column("text_key"), *(zip(*rows) if rows else [[]] * (w + 1)))

    ddl = "id long, text_key long, " + "".join(f"f{k} long, " for k in range(w)) + "keys array<long>"
    return docs.select(id_key().alias("id"), text_key().alias("text_key"), "text").mapInArrow(run, ddl)


def sets_of(rows: DataFrame, words: int) -> DataFrame:
    """``id`` and ``shingles``, the set of shingle hashes, for each of ``rows(id, text)``."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            got = [np.unique(shingle_hashes(words_lower(t), words)).view(np.int64) for t in b.column("text").to_pylist()]
            yield batch_of(schema, b.column("id"), got)

    return rows.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``id``, the key of a text, and ``shingles``, once for each distinct text of ``docs``."""
    return sets_of(docs.groupBy(text_key().alias("id")).agg(F.first("text").alias("text")), words)


def dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over the rows of ``fps`` (n x words), one tree for each value of ``key``."""

    def __init__(self, fps: np.ndarray, key: np.ndarray):
        n = len(fps)
        self.fps, self.span = fps, fps.shape[1] * 64 + 1
        pend = np.argsort(key, kind="stable")
        grp = key[pend]
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        self.root = np.empty(n, np.int64)
        up, d = np.full(n, -1), np.zeros(n, np.int64)
        level = 0
        while len(pend):
            first = np.concatenate(([True], grp[1:] != grp[:-1]))
            node = pend[first][np.cumsum(first) - 1]
            heads = pend[first]
            parent[heads], edge[heads] = up[first], d[first]
            if level == 0:
                self.root[pend] = node
            rest = ~first
            pend, node = pend[rest], node[rest]
            d = dist(fps[pend], fps[node])
            grp = node * self.span + d
            order = np.argsort(grp, kind="stable")
            pend, grp, d, up = pend[order], grp[order], d[order], node[order]
            level += 1
        child = np.flatnonzero(parent >= 0)
        code = parent[child] * self.span + edge[child]
        order = np.argsort(code, kind="stable")
        self.child, self.code = child[order], code[order]

    def search(self, radius: int, query: np.ndarray, at_once: int = 1_000_000):
        """Pairs (query row, other row) within the radius, block by block. ``query`` are rows of the forest.

        A block has few enough queries that, were each to meet every node of the largest tree, ``at_once`` pairs are held.
        """
        block = max(1, at_once // max(int(np.bincount(self.root).max(initial=1)), 1))
        for at in range(0, len(query), block):
            q = query[at:at + block]
            node, found = self.root[q], []
            while len(q):
                d = dist(self.fps[q], self.fps[node])
                hit = (d <= radius) & (node != q)
                found.append(np.stack([q[hit], node[hit]]))
                lo = np.searchsorted(self.code, node * self.span + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.code, node * self.span + np.minimum(d + radius, self.span - 1), "right")
                n = hi - lo
                q = np.repeat(q, n)
                node = self.child[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(q))]
            yield np.concatenate(found, axis=1)


def settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row over the links (a, b), starting from ``labels``."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def block_masks(bits: int, radius: int) -> list[int]:
    """Contiguous blocks of nearly equal width, radius + 1 of them, as signed longs."""
    return split_mask((1 << bits) - 1, radius + 1)


def split_mask(free: int, n: int) -> list[int]:
    at = [i for i in range(64) if free >> i & 1]
    cut_ = [len(at) * k // n for k in range(n + 1)]
    return [sum(1 << i for i in at[a:b]) for a, b in zip(cut_, cut_[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_keys(reps: DataFrame, radius: int, max_tree: int = MAX_TREE, levels: int = 3, order: bool = False) -> DataFrame:
    """``reps(id, f0)`` once for each block of bits, with the shard ``key``; overfull keys are cut by further blocks.

    With ``order``, ``before`` has the blocks that come before the row's own: a pair that
    differs in all of them has not met under an earlier key.
    """
    def deal(df, used: int, free: int, before: list[int], tag: int):
        blocks = [(used | m, free & ~m, before + parts[:i]) for parts in [[p for p in split_mask(free, radius + 1) if p]] for i, m in enumerate(parts)]
        keys = F.array(*[F.struct(F.lit(tag + i).alias("block"), F.xxhash64(F.lit(tag + i), F.col("f0").bitwiseAND(signed(u))).alias("key"),
                                  F.array(*[F.lit(signed(x)) for x in prior]).cast("array<long>").alias("before"))
                         for i, (u, _, prior) in enumerate(blocks)])
        return df.select("id", "f0", F.explode(keys).alias("k")).select("id", "f0", "k.*"), {tag + i: x for i, x in enumerate(blocks)}

    todo, state = deal(reps, 0, (1 << 64) - 1, [], 0)
    out = None
    for _ in range(levels):
        todo = cut(todo)
        hot = cut(todo.groupBy("block", "key").count().where(F.col("count") > max_tree).select("block", "key"))
        if hot.isEmpty():
            break
        cold = todo.join(hot, ["block", "key"], "left_anti")
        out = cold if out is None else out.unionByName(cold)
        full, todo, nxt = cut(todo.join(hot, ["block", "key"], "left_semi")), None, {}
        for block, (used, free, before) in state.items():
            # rows of one overfull key only meet each other: its hash is part of the new key
            sub, more = deal(full.where(F.col("block") == block).select("id", "f0"), used, free, before, max(state) + 1 + len(nxt))
            nxt |= more
            todo = sub if todo is None else todo.unionByName(sub)
        state = nxt
    out = todo if out is None else out.unionByName(todo)
    return out.select("id", "f0", "key", *(["before"] if order else []))


def words_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "f" and c[1:].isdigit()]


def minhash_keys(reps: DataFrame) -> DataFrame:
    """``reps`` once for each of its smallest shingle hashes; ``before`` has the ones that come earlier."""
    fs = words_of(reps)
    return (reps.select("id", *fs, "keys", F.posexplode("keys").alias("_n", "_h"))
            .select("id", *fs, F.xxhash64("_n", "_h").alias("key"), F.slice("keys", F.lit(1), F.col("_n")).alias("before")))


def matrix(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list starts (one more entry at the end)."""
    size = np.concatenate([np.diff(c.offsets.to_numpy()) for c in col.chunks])
    return np.concatenate([c.flatten().to_numpy() for c in col.chunks]), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))


class Shard:
    """The rows of one task in the order of key and id, their BK-trees, and the pairs that meet here first."""

    def __init__(self, t: pa.Table, fs: list[str], order: np.ndarray):
        self.order, self.n = order, t.num_rows
        fps = np.stack([t.column(c).to_numpy() for c in fs], axis=1).view(np.uint64)[order]
        self.forest = Forest(fps, t.column("key").to_numpy()[order])
        flat, at = matrix(t.column("before"))
        size = np.diff(at)
        self.before = np.zeros((self.n, int(size.max(initial=0))), np.int64)
        self.n_before = size[order]
        for k in range(self.before.shape[1]):
            has = size > k
            self.before[has, k] = flat[at[:-1][has] + k]
        self.before = self.before[order]

    def pairs(self, radius: int):
        """Pairs of rows a < b within the radius that share no earlier key, block by block, by a."""
        for a, b in self.forest.search(radius, np.arange(self.n)):
            a, b = a[a < b], b[a < b]
            met = np.zeros(len(a), bool)
            for k in range(self.before.shape[1]):
                met |= (self.n_before[a] > k) & (self.before[a, k] == self.before[b, k])
            a, b = a[~met], b[~met]
            order = np.argsort(a, kind="stable")
            yield a[order], b[order]


def pieces_of(shards: DataFrame, weight: Column, max_weight: int, max_tree: int) -> DataFrame:
    """``shards`` with ``key`` cut into pieces where it is overfull; ``whole`` is the key itself. Rows alone in a key go."""
    size = shards.groupBy("key").agg(F.count("*").alias("count"), F.sum(weight).alias("weight")).where("count > 1")
    pieces = F.ceil(F.greatest(F.col("count") / max_tree, F.col("weight") / max_weight)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("pieces").cast("long")).cast("int")
    return (shards.join(size.select("key", pieces.alias("pieces")), "key")
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .withColumn("whole", F.col("key"))
            .withColumn("key", F.when(F.col("pieces") == 1, F.col("key"))
                        .otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))))
            .drop("pieces", "own", "other"))


def candidates(shards: DataFrame, radius: int, max_tree: int = MAX_TREE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``id`` and ``key`` of the rows of ``shards`` with another row of the key within the radius, not met under an earlier key."""
    fs = words_of(shards)
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64())])

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        ids, whole = t.column("id").to_numpy(), t.column("whole").to_numpy()
        order = np.lexsort((ids, t.column("key").to_numpy()))
        near = np.zeros(len(ids), bool)
        for a, b in Shard(t, fs, order).pairs(radius):
            near[order[a]] = near[order[b]] = True
        yield batch_of(schema, ids[near], whole[near])

    dealt = pieces_of(shards, F.lit(1), max_tree, max_tree)
    return dealt.repartition(parts_for(shards.count(), rows_per_task), "key").mapInArrow(run, "id long, key long").distinct()


def join_similar(labels: np.ndarray, shard: Shard, radius: int, least: float, flat: np.ndarray, at: np.ndarray) -> None:
    """Give rows whose sets are at least ``least`` similar one label. ``flat``, ``at``: numbers of the shingles of each row.

    A pair that earlier pairs have joined is not compared again, so a group of n copies takes about n comparisons.
    """
    size = np.diff(at)
    held = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    root = shard.forest.root
    for a, b in shard.pairs(radius):
        like = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[like], b[like]
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else []
        for lo, hi in zip(starts, [*starts[1:], len(a)]):
            q, other = a[lo], b[lo:hi]
            other = other[labels[other] != labels[q]]
            if not len(other):
                continue
            held[flat[at[q]:at[q + 1]]] = True
            n = size[other]
            ends = np.cumsum(n)
            hits = np.concatenate(([0], np.cumsum(held[flat[np.repeat(at[other] - (ends - n), n) + np.arange(n.sum())]])))
            both = hits[ends] - hits[ends - n]
            held[flat[at[q]:at[q + 1]]] = False
            either = size[q] + n - both
            other = other[both / np.maximum(either, 1) >= np.where(either == 0, 0, least)]
            if len(other):
                # a tree is a run of rows, and only its rows share labels
                first, last = root[q], np.searchsorted(root, root[q], "right")
                own = labels[first:last]
                old = np.unique(np.append(labels[other], labels[q]))
                own[np.isin(own, old)] = old[0]


def similar_links(shards: DataFrame, radius: int, least: float, max_tree: int = MAX_TREE, shingles_per_task: int = SHINGLES_PER_TASK) -> DataFrame:
    """A spanning forest (``u``, ``v``) of the pairs within the radius that share a key and whose ``shingles`` are ``least`` similar."""
    fs = words_of(shards)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        order = np.lexsort((t.column("id").to_numpy(), t.column("key").to_numpy()))
        t = t.take(pa.array(order))
        ids = t.column("id").to_numpy()
        flat, at = matrix(t.column("shingles"))
        flat = np.unique(flat, return_inverse=True)[1].astype(np.int64)
        labels = np.arange(len(ids))
        join_similar(labels, Shard(t, fs, np.arange(len(ids))), radius, least, flat, at)
        far = np.flatnonzero(labels != np.arange(len(ids)))
        yield batch_of(schema, ids[far], ids[labels[far]])

    n = shards.agg(F.sum(F.size("shingles"))).first()[0] or 0
    dealt = pieces_of(shards, F.size("shingles"), shingles_per_task, max_tree)
    return dealt.repartition(parts_for(n, shingles_per_task), "key").mapInArrow(run, "u long, v long")


def links(shards: DataFrame, radius: int, max_tree: int = MAX_TREE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A spanning forest (``u``, ``v``) of the pairs within the radius that share a key of ``shards``.

    A key with more rows than ``max_tree`` is cut into pieces by the hash of its ids; every pair
    of pieces becomes a key of its own, so no task holds more than two pieces of it.
    """
    fs = words_of(shards)
    n = shards.count()
    dealt = pieces_of(shards, F.lit(1), max_tree, max_tree)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        ids, key = t.column("id").to_numpy(), t.column("key").to_numpy()
        fps = np.stack([t.column(c).to_numpy() for c in fs], axis=1).view(np.uint64)
        order = np.lexsort((ids, key))
        ids, key, fps = ids[order], key[order], fps[order]
        # smallest id first within a key, so the smallest row of a set is its smallest id there
        forest, labels = Forest(fps, key), np.arange(len(ids))
        for a, b in forest.search(radius, np.arange(len(ids))):
            if len(a):
                labels = settle(labels, a, b)
        far = np.flatnonzero(labels != np.arange(len(ids)))
        yield batch_of(schema, ids[far], ids[labels[far]])

    return dealt.repartition(parts_for(n, rows_per_task), "key").mapInArrow(run, "u long, v long")


def labelled(docs: DataFrame, words: int, bits: int, radius: int, n_keys: int, least: float | None) -> tuple[DataFrame, DataFrame]:
    """``id``, ``text_key``, ``node`` and fingerprint words of every row, and ``node``, ``label`` of the nodes that are linked.

    A node is a fingerprint; with ``least`` it is a text. Ids take no part, so they may be null or repeat.
    """
    fs = [f"f{k}" for k in range(bits // 64)]
    if least is not None and not n_keys:
        raise ValueError("a least similarity needs min-hash shards")
    node = F.col("text_key") if least is not None else F.col("f0") if bits == 64 else F.xxhash64(*fs)
    read = docs.select("doc_id", "text")
    rows = cut(fingerprints(read, words, bits, n_keys, sets=least is not None).select("id", "text_key", node.alias("node"), *fs, "keys"))
    reps = cut(rows.groupBy(F.col("node").alias("id")).agg(F.min(F.struct(*fs, "keys")).alias("r")).select("id", "r.*"))
    shards = cut(minhash_keys(reps) if n_keys else block_keys(reps.select("id", "f0"), radius))
    if least is None:
        found = links(shards, radius)
    else:
        # rows within the radius make up candidate groups; a text's set goes to the one group it belongs to, whatever the number of its keys
        group = cut(components(cut(links(shards, radius))).select(F.col("node").alias("id"), F.col("label").alias("key")))
        one = rows.join(group.select(F.col("id").alias("node")), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
        texts = read.select(id_key().alias("id"), text_key().alias("node"), "text").join(small(cut(one)), ["id", "node"], "left_semi")
        # rows that repeat both id and text give the same set
        sets = sets_of(texts.select(F.col("node").alias("id"), "text"), words).dropDuplicates(["id"])
        met = reps.select("id", *fs).join(group, "id").withColumn("before", F.array().cast("array<long>"))
        found = similar_links(cut(met.join(sets, "id")), radius, least)
    return rows.drop("keys"), components(cut(found))


def near_groups(docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 3, n_keys: int = 0, least: float | None = None) -> DataFrame:
    """``doc_id``, the fingerprint as hex, and ``component_id``, the smallest id linked to it, for every row.

    A null id is reported only where no row of the group has an id.

    ``n_keys`` = 0 takes the exact block shards (64 bits only), otherwise that many min-hash shards. With ``least`` texts are
    linked when their sets of shingles are that similar, and the radius only has to find them.
    Rows that repeat an id are linked like other rows. Tables of any size, empty ones too, take the same path.
    """
    fs = [f"f{k}" for k in range(bits // 64)]
    rows, labels = labelled(docs, words, bits, radius, n_keys, least)
    nodes = cut(rows.groupBy("node").agg(F.min(id_back("id")).alias("low")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    bynode = nodes.join(nodes.groupBy("label").agg(F.min("low").alias("component")), "label").select("node", "component")
    hexed = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in reversed(fs)])
    return (rows.join(bynode, "node", "left")
            .select(id_back("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id")))


def keep_one(docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 3, n_keys: int = 0, least: float | None = None) -> DataFrame:
    """One row of ``docs`` for each group of near copies: the one with the smallest id, a null id last.

    Rows that repeat an id, or have none, go only when their own text is a near copy.
    """
    rows, labels = labelled(docs, words, bits, radius, n_keys, least)
    # a text is one node, a node may be several texts: rows are told apart by id and text
    rank = F.struct((F.col("id") == NULL_ID).alias("none"), "id", "text_key")
    parts = cut(rows.groupBy("node", "id", "text_key").agg(F.count("*").alias("n")))
    nodes = cut(parts.groupBy("node").agg(F.min(rank).alias("low")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    best = nodes.join(nodes.groupBy("label").agg(F.min("low").alias("best")), "label").select("node", "best")
    ranked = cut(parts.join(best, "node").select("id", "text_key", "n", ((F.col("best.id") == F.col("id")) & (F.col("best.text_key") == F.col("text_key"))).alias("stays")))
    gone = ranked.where(~F.col("stays")).select("id", "text_key")
    twice = cut(ranked.where(F.col("stays") & (F.col("n") > 1)).select("id", "text_key"))
    # a struct holds the caller's columns, whatever their names
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_key().alias("id"), text_key().alias("text_key"))
    key = ["id", "text_key"]
    kept = packed.join(gone, key, "left_anti")
    if not twice.isEmpty():
        # rows of one id and one text only: one of them, the smallest by its columns as text
        again = kept.join(twice, key, "left_semi").groupBy(*key).agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
        kept = kept.join(twice, key, "left_anti").select(*key, "doc").unionByName(again)
    return kept.select("doc.*")
