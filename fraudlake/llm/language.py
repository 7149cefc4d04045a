"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is one separator; runs of one to four characters are hashed to
``DIM`` features. A feature weighs ``(1 + ln(count)) * idf`` and every text is scaled to length one; document
frequencies come from all learnable documents. The weights are fitted by follow-the-regularised-leader with
elastic-net penalties (most stay zero): shards of a bounded sample run one pass each from the same state, their changes are
averaged on the executors, and the next pass starts from the average. The driver receives one state, whatever the number of
shards. A temperature, fitted on sample rows kept apart, calibrates the probabilities.

A text that is null or has no letter is ``und`` with score 0, and so is every text when nothing can be
learnt. Only the text is an input of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import GOLD, batch_of, id_back, id_key, parts_for, sample_below
from fraudlake.session import cut

DIM = 1 << 15           # also fits the two bytes a feature takes in the stored sample
ORDERS = (1, 2, 3, 4)
MAX_TRAIN = 8_000       # documents used for the fit
ROWS_PER_SHARD = 1_000
SLICE = 1 << 12         # features of one slice of the state
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
SEED = 5
NONE = "und"

_ASCII = np.array([chr(k).isalpha() for k in range(128)])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of one text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.where(c < 128, _ASCII[np.minimum(c, 127)], (c >= 0xC0) & ((c < 0x2000) | (c >= 0x2C00)))
    c = np.where(letter, c, 32).astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))
    total = np.zeros(DIM, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for n in ORDERS:
            if len(c) < n:
                break
            h = h[:len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1:] + np.uint64(n)
            total += np.bincount(((h * GOLD) >> np.uint64(49)).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    w: np.ndarray           # (DIM + 1) x languages, the last row is the bias
    temperature: float = 1.0

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = weigh(at, count, self.idf)
        return x @ self.w[at] + self.w[DIM]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return NONE, 0.0
        z = self.logits(*features(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())     # the first of equals
        return self.langs[k], float(p[k] / p.sum())


def weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs; every task sends one row for each feature it met."""
    schema = pa.schema([("f", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total, rows = np.zeros(DIM, np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                total[features(text)[0]] += 1
                rows += 1
        at = np.flatnonzero(total)
        yield batch_of(schema, np.concatenate((at, [DIM])).astype(np.int32), np.concatenate((total[at], [rows])))

    got = docs.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()   # DIM + 1 rows at most
    out = np.zeros(DIM + 1, np.int64)
    for r in got:
        out[r["f"]] = r["n"]
    return out[:DIM], int(out[DIM])


class Leader:
    """State of follow-the-regularised-leader: z and n for every feature and language."""

    def __init__(self, state: np.ndarray):
        self.z, self.n = state[0].copy(), state[1].copy()

    @staticmethod
    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, DIM), np.append(x, 1.0)
        z, n = self.z[at], self.n[at]
        w = self.weights(z, n)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p[None, :]
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, learn: Column, max_train: int = MAX_TRAIN) -> LanguageModel:
    """Train on the rows of ``docs(doc_id, text, lang)`` where ``learn`` holds and ``lang`` is not null."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    by_lang = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # one row a language
    langs = sorted(by_lang)
    if not langs:
        return LanguageModel([], np.zeros(DIM), np.zeros((DIM + 1, 0)))
    df, rows = document_frequencies(usable)
    idf = np.log((1 + rows) / (1 + df)) + 1
    schema = pa.schema([("y", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])

    def make(batches):
        for b in batches:
            out = []
            for text, lang, part in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "part"))):
                at, n = features(text)
                out.append((langs.index(lang), part, at.astype(np.uint16).tobytes(), n.astype(np.uint32).tobytes()))
            yield batch_of(schema, *(zip(*out) if out else [[]] * 4))

    # the row number takes part, so that copies and rows without an id are sampled and spread like all others
    at_row = F.monotonically_increasing_id()
    numbered = usable.select("doc_id", "text", "lang", at_row.alias("row"))
    sample = cut(numbered.where(sample_below(rows, max_train, "doc_id", "row", seed=SEED))
                 .select("text", "lang", F.pmod(F.xxhash64(F.lit(6), "doc_id", "row"), F.lit(6)).cast("int").alias("part"))
                 .mapInArrow(make, "y int, part int, at binary, n binary"))
    sample = cut(sample.repartition(parts_for(sample.count(), ROWS_PER_SHARD)))
    spark = docs.sparkSession
    shape = (2, DIM + 1, len(langs))
    state = np.zeros(shape)

    def examples(batches):
        for b in batches:
            for y, part, at, n in zip(*(b.column(c).to_pylist() for c in ("y", "part", "at", "n"))):
                yield y, part, np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(n, np.uint32).astype(np.float64)

    # what a shard changed, slice by slice of the feature space; slices are averaged on the executors
    change = pa.schema([("slice", pa.int32()), ("rows", pa.int64()), ("at", pa.binary()), ("by", pa.binary())])
    for _ in range(PASSES):
        now = spark.sparkContext.broadcast(state)   # as many numbers as the model has

        def one_pass(batches, now=now):
            leader, seen = Leader(now.value), 0
            for y, part, at, n in examples(batches):
                if part:
                    leader.learn(at, weigh(at, n, idf), y)
                    seen += 1
            if not seen:
                return
            moved = np.stack([leader.z, leader.n]) - now.value
            touched = np.flatnonzero(moved.any(axis=(0, 2)))
            groups = [g for g in np.split(touched, np.searchsorted(touched, np.arange(SLICE, DIM + 1, SLICE))) if len(g)]
            yield batch_of(change, [int(g[0]) // SLICE for g in groups], [seen] * len(groups), [g.astype(np.int32).tobytes() for g in groups],
                           [moved[:, g].tobytes() for g in groups])

        def average(t: pa.Table) -> pa.Table:
            total = np.zeros((2, SLICE, len(langs)))
            base = t.column("slice")[0].as_py() * SLICE
            for k, at, by in zip(*(t.column(c).to_pylist() for c in ("rows", "at", "by"))):
                at = np.frombuffer(at, np.int32) - base
                total[:, at] += np.frombuffer(by).reshape(2, len(at), len(langs)) * k
            return pa.table([t.column("slice")[:1], pa.array([total.tobytes()], pa.binary())], ["slice", "by"])

        ddl = "slice int, rows long, at binary, by binary"
        moves = cut(sample.mapInArrow(one_pass, ddl))
        # a shard weighs as many rows as it learnt; it has a row for each slice, of which each knows this number
        learnt = sample.where("part <> 0").count()
        if not learnt:
            break
        for r in moves.groupBy("slice").applyInArrow(average, "slice int, by binary").collect():    # one state in all
            first, last = r["slice"] * SLICE, min((r["slice"] + 1) * SLICE, DIM + 1)
            state[:, first:last] += np.frombuffer(r["by"]).reshape(2, SLICE, len(langs))[:, :last - first] / learnt
    model = LanguageModel(langs, idf, Leader.weights(state[0], state[1]))

    def apart(batches):
        out = [(y, model.logits(at, n)) for y, part, at, n in examples(batches) if not part]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([z.tolist() for _, z in out], pa.list_(pa.float64()))], ["y", "z"])

    rest = sample.mapInArrow(apart, "y int, z array<double>").collect()     # a sixth of the bounded sample
    if rest:
        y, z = np.array([r["y"] for r in rest]), np.array([r["z"] for r in rest])

        def nll(t):
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean()

        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
        model.temperature = float(grid[np.argmin([nll(t) for t in grid])])
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            out = [sent.value.predict(t) for t in b.column("text").to_pylist()]
            yield batch_of(schema, b.column("id"), [x[0] for x in out], [x[1] for x in out])

    return (docs.select(id_key().alias("id"), "text").mapInArrow(run, "id long, lang_pred string, score double")
            .select(id_back("id").alias("doc_id"), "lang_pred", "score"))
