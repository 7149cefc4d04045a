"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text (character classes, word lengths, repetition, line shape) are standardised
and mapped to ``cos(Wx + b)``, which approximates a Gaussian kernel. Every partition of the
training rows sums its part of the normal equations; the sums are solved for ridge scores, which
an isotonic fit on rows kept apart turns into probabilities.

Training reads a bounded sample of labelled rows (``MAX_TRAIN``, by the hash of the id), so the
labels sent to all tasks and the sums sent back have a fixed bound. Scoring reads every whole
text and needs no shuffle. Without a usable label every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fraudlake.llm.common import batch_of, parts_for, sample_below
from fraudlake.session import cut

MAX_TRAIN = 40_000      # labelled documents used for the fit
ROWS_PER_SUM = 4_000    # training rows of one partial sum
N_FOURIER = 384
RIDGE = 1e-3
SEED = 17

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.arange(256) >= 128
_STOP = np.zeros(256, bool)
_STOP[[44, 46, 59, 58, 33, 63, 39, 34, 45, 40, 41]] = True
_ODD = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH | _STOP)
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH, _STOP, _ODD]).astype(np.float64)
N_STATS = 26


def statistics(text: str | None) -> np.ndarray:
    """26 numbers of one text, all zero for a null or empty one; none depends on the language's words."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = _CLASSES @ hist / len(raw)
    words = raw.split()
    out[:7] = share
    out[7] = np.log1p(len(raw))
    if not words:
        return out
    n = len(words)
    size = np.fromiter(map(len, words), np.float64, n)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = b"".join([w[-1:] for w in words])
    last = np.bincount(np.frombuffer(ends, np.uint8), minlength=256)
    first = np.bincount(np.frombuffer(b"".join([w[:1] for w in words]), np.uint8), minlength=256)
    same = sum(map(bytes.__eq__, words, words[1:]))
    line_words = n / max(len(lines), 1)
    out[8:] = (
        np.log1p(n), size.mean(), size.std(), np.log1p(size.max()), len(count) / n, max(count.values()) / n,
        pairs / max(n - 1, 1), same / n, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(line_words),
        last[_STOP].sum() / n, last[_ODD].sum() / n, first[_UPPER].sum() / n, first[_ODD].sum() / n,
        (last[33] + last[63]) / n, hist[124] / n, np.log1p(n) * (len(count) / n), (size == 1).sum() / n,
    )
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)

    @property
    def learnt(self) -> bool:
        return len(self.knots) > 0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rows sorted by ``x``: block centres and their non-decreasing means."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            p, q, r = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += q
            blocks[-1][2] += r
    xs = np.array([b[0] / b[2] for b in blocks])
    # one part of a row of either class is added to each block, so that none is quite certain
    return xs, np.maximum.accumulate(np.array([(b[1] + 0.02) / (b[2] + 0.04) for b in blocks]))


def _partial(df: DataFrame, run, n_rows: int) -> list[np.ndarray]:
    """``run(x, y, part)`` for each partition of the bounded training rows; its arrays come back to be added up."""
    def each(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(t.num_rows, N_STATS)
            out = run(x, t.column("y").to_numpy().astype(np.float64), t.column("part").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(out).tobytes()], pa.binary())], ["s"])

    rows = df.mapInArrow(each, "s binary").collect()
    return [np.frombuffer(r.s, np.float64) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_train: int = MAX_TRAIN) -> QualityModel:
    """Train on ``labels(doc_id, target)`` of ids in ``docs``. Labels other than 0 and 1 and null ids are not used."""
    labels = labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y"))
    usable = labels.where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    n = usable.count()
    # at most about max_train rows of two numbers: small enough for every task
    sample = F.broadcast(usable.where(sample_below(n, max_train, "id", seed=SEED)))
    stat_schema = pa.schema([("x", pa.binary()), ("y", pa.int32()), ("part", pa.int32())])

    def stats(batches):
        for b in batches:
            yield batch_of(stat_schema, [statistics(t).tobytes() for t in b.column("text").to_pylist()], b.column("y"), b.column("part"))

    # only what is needed is read; an id may stand for many rows, so the bound holds for rows, told apart by their number
    found = docs.select(F.col("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("row")).join(sample, "id")
    rows = found.select("id", "row").count()
    train = cut(found.where(sample_below(rows, max_train, "id", "row", seed=SEED + 1)).select("text", "y", F.pmod(F.xxhash64(F.lit(3), "id", "row"), F.lit(5)).cast("int").alias("part"))
                .mapInArrow(stats, "x binary, y int, part int"))
    n = train.count()
    none = QualityModel(*(np.zeros(0) for _ in range(7)))
    if not n:
        # nothing to learn from: every text scores 0.5, and ``learnt`` says so
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, 1)), np.zeros(1), np.zeros(2), none.knots, none.levels)
    train = train.repartition(parts_for(n, ROWS_PER_SUM))
    moments = sum(_partial(train, lambda x, y, p: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), n))
    mean = moments[1:N_STATS + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[N_STATS + 1:] / moments[0] - mean ** 2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / np.sqrt(N_STATS / 2), (N_STATS, N_FOURIER))
    model = QualityModel(mean, scale, w, rng.uniform(0, 2 * np.pi, N_FOURIER), np.zeros(N_FOURIER + 1), none.knots, none.levels)
    d = N_FOURIER + 1

    def normal(x, y, part):
        z = model.features(x[part > 0])
        return np.concatenate([(z.T @ z).ravel(), z.T @ y[part > 0], [len(z)]])

    sums = sum(_partial(train, normal, n))
    gram, right, rows = sums[:d * d].reshape(d, d), sums[d * d:-1], sums[-1]
    model.beta = np.linalg.solve(gram + RIDGE * max(rows, 1) / 100 * np.eye(d) + 1e-6 * np.eye(d), right)

    # rows kept apart, on a grid of ridge scores: position, label sum, rows
    def graded(x, y, part):
        x, y = x[part == 0], y[part == 0]
        at = np.clip(np.round((model.raw(x) + 1) * 1000), 0, 3000).astype(int) if len(x) else np.zeros(0, int)
        return np.concatenate([np.bincount(at, minlength=3001), np.bincount(at, weights=y, minlength=3001)]).astype(np.float64)

    grades = sum(_partial(train, graded, n))
    count, ones = grades[:3001], grades[3001:]
    at = np.flatnonzero(count)
    if len(at):
        model.knots, model.levels = isotonic(at / 1000 - 1, ones[at] / count[at], count[at])
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of every row. Only ``text`` is an input; columns that clash are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    docs = docs.drop(name)
    out = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, N_STATS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(sent.value.score(x), 0, 1), pa.float64())],
                                             names=[*b.schema.names, name])

    return docs.mapInArrow(run, out)
