"""Toxicity: a logistic classifier regularised by counterfactuals.

Features are the distinct words of a text and their first three to five letters, hashed. Of these, the ones that
differ most between toxic and other labelled documents are kept. Labelled texts that name a group are also
read with the name swapped for another of its kind and without it (an unseen neutral word could
take on the weight of the name); the training loss adds
``BALANCE`` times the squared change of the score, so that a group's name alone moves no score.

The fit reads a bounded sample of labelled rows (``MAX_TRAIN``) and at most ``MAX_FEATURES`` weights;
partitions sum their gradients. Scoring reads every whole text and needs no shuffle. Null and empty texts
have no features and get the score of the bias. Without labels of both kinds every score is that of the bias, 0 without any.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import Codes, batch_of, id_back, id_key, minimise, parts_for, sample_below
from fraudlake.session import cut

MAX_TRAIN = 30_000      # labelled documents used for the fit
ROWS_PER_SUM = 4_000
MAX_FEATURES = 4_096
MIN_Z = 4.0             # standard errors by which a feature's shares must differ
BALANCE = 5.0
RIDGE = 2e-4
SPACE = 1 << 22
SEED = 41
# Names of groups; those of one line can be swapped for each other.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
)
_BREAKS = bytes(32 if (k < 128 and not chr(k).isalpha()) else k for k in range(256))


def group_words(groups=GROUPS) -> dict[bytes, bytes]:
    """Each name and the next one of its line."""
    return {a.encode(): g[(k + 1) % len(g)].encode() for g in groups for k, a in enumerate(g)}


def distinct_words(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split()) if text else set()


class Ids(dict):
    """Feature numbers of a word: the word and its first three, four and five bytes when it is longer."""

    def __init__(self):
        self.codes = Codes()

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        parts = [b"=" + word, *(b"^" + word[:k] for k in (3, 4, 5) if len(word) >= k)]
        out = self[word] = tuple((self.codes[p] >> 8) % SPACE for p in parts)
        self.codes.clear()
        return out


def numbers(words: set[bytes], ids: Ids) -> np.ndarray:
    return np.unique(np.array([k for w in words for k in ids[w]], np.int64))


@dataclass
class ToxicityModel:
    bias: float
    weight: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        """A function from text to score, with a cache of the words that matter."""
        ids, keep = Ids(), self.weight

        class Hits(dict):
            def __missing__(self, word):
                if len(self) > 500_000:
                    self.clear()
                out = self[word] = tuple(k for k in ids[word] if k in keep)
                return out

        hits = Hits()

        def score(text: str | None) -> float:
            found: set[int] = set()
            for w in distinct_words(text):
                if h := hits[w]:
                    found.update(h)
            z = self.bias + sum(keep[k] for k in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_train: int = MAX_TRAIN, balance: float = BALANCE,
        groups=GROUPS) -> ToxicityModel:
    """Train on ``labels(doc_id, target)`` of ids in ``docs``; labels other than 0 and 1 and null ids are not used."""
    labels = labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y"))
    usable = labels.where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    n = usable.count()
    sample = F.broadcast(usable.where(sample_below(n, max_train, "id", seed=SEED)))     # about max_train rows at most
    swap = group_words(groups)
    schema = pa.schema([("y", pa.int32()), ("x", pa.binary()), ("others", pa.list_(pa.binary()))])

    def make(batches):
        ids = Ids()
        for b in batches:
            out = []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                words = distinct_words(text)
                named = words & swap.keys()
                other = [(words - named) | {swap[w] for w in named}, words - named] if named else []
                out.append((y, numbers(words, ids).tobytes(), [numbers(o, ids).tobytes() for o in other]))
            yield batch_of(schema, *(zip(*out) if out else [[]] * 3))

    # only what is needed is read; an id may stand for many rows, so the bound holds for rows, told apart by their number
    found = docs.select(F.col("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("row")).join(sample, "id")
    rows = found.select("id", "row").count()
    train = cut(found.where(sample_below(rows, max_train, "id", "row", seed=SEED + 1)).select("text", "y").mapInArrow(make, "y int, x binary, others array<binary>"))
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel(float(np.log((n1 + 1e-6) / (n0 + 1e-6))) if n0 + n1 else -40.0)
    train = cut(train.repartition(parts_for(n0 + n1, ROWS_PER_SUM)))
    counts = pa.schema([("f", pa.int64()), ("n1", pa.int64()), ("n0", pa.int64()), ("named", pa.int64())])

    def tally(batches):
        seen = [np.zeros(SPACE, np.int32) for _ in range(3)]
        for b in batches:
            for y, x, others in zip(*(b.column(c).to_pylist() for c in ("y", "x", "others"))):
                x = np.frombuffer(x, np.int64)
                seen[0 if y else 1][x] += 1
                for o in others:    # what a swap changes is always kept
                    seen[2][np.setxor1d(x, np.frombuffer(o, np.int64))] += 1
        at = np.flatnonzero(seen[0] + seen[1] + seen[2])
        yield batch_of(counts, at, *(s[at].astype(np.int64) for s in seen))

    p = F.col("n1") / n1
    q = F.col("n0") / n0
    share = (F.col("n1") + F.col("n0")) / (n1 + n0)
    z = (p - q) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    kept = (train.mapInArrow(tally, "f long, n1 long, n0 long, named long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n1", "n0", "named")))
            .withColumn("z", F.abs(z)).where((F.col("z") >= MIN_Z) | (F.col("named") > 0))
            .orderBy((F.col("named") > 0).desc(), F.col("z").desc(), "f").limit(MAX_FEATURES).collect())
    columns = np.array(sorted(r["f"] for r in kept), np.int64)
    d = len(columns)
    narrow = pa.schema([("y", pa.int32()), ("x", pa.binary()), ("others", pa.list_(pa.binary()))])

    def select(blob: bytes) -> bytes:
        x = np.frombuffer(blob, np.int64)
        at = np.searchsorted(columns, x)
        return at[(at < d) & (columns[np.minimum(at, max(d - 1, 0))] == x)].astype(np.int32).tobytes() if d else b""

    def reduce_(batches):
        for b in batches:
            yield batch_of(narrow, b.column("y"), [select(x) for x in b.column("x").to_pylist()], [[select(o) for o in v] for v in b.column("others").to_pylist()])

    rows = cut(train.mapInArrow(reduce_, "y int, x binary, others array<binary>"))
    spark, total = docs.sparkSession, n0 + n1

    def run(v: np.ndarray):
        sent = spark.sparkContext.broadcast(v)      # at most MAX_FEATURES + 1 weights

        def each(batches):
            f, g = 0.0, np.zeros(d + 1)
            w = sent.value
            for b in batches:
                for y, x, others in zip(*(b.column(c).to_pylist() for c in ("y", "x", "others"))):
                    x = np.frombuffer(x, np.int32)
                    s = w[x].sum() + w[d]
                    f += np.logaddexp(0, s) - y * s
                    r = 1 / (1 + np.exp(-s)) - y
                    g[x] += r
                    g[d] += r
                    for o in others:
                        o = np.frombuffer(o, np.int32)
                        change = s - w[o].sum() - w[d]
                        f += balance * change * change
                        g[x] += 2 * balance * change
                        g[o] -= 2 * balance * change
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([f], g)).tobytes()], pa.binary())], ["s"])

        got = sum(np.frombuffer(r["s"]) for r in rows.mapInArrow(each, "s binary").collect())   # one row for each partial sum
        return got[0] / total + RIDGE * (v[:d] @ v[:d]) / 2, got[1:] / total + RIDGE * np.append(v[:d], 0.0)

    start = np.zeros(d + 1)
    start[d] = np.log(n1 / n0)
    best = minimise(run, start, rounds=30, tol=1e-4)
    return ToxicityModel(float(best[d]), dict(zip(columns.tolist(), best[:d].tolist())))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id`` and ``score`` of every row. Only ``text`` is an input."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        one = sent.value.scorer()
        for b in batches:
            yield batch_of(schema, b.column("id"), [one(t) for t in b.column("text").to_pylist()])

    return docs.select(id_key().alias("id"), "text").mapInArrow(run, "id long, score double").select(id_back("id").alias("doc_id"), "score")
