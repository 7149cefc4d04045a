"""Secret scans: fixed patterns and a linear-chain conditional random field over tokens.

Three patterns (``assign``, ``access``, ``hex``) give the base spans of a text. The field tags every
token as begin, inside or outside of a secret from its own shape, the shapes of its neighbours and
features of the whole file, and adds the decoded spans that touch no base span (kind ``crf``).
Its teacher is the base spans of a bounded sample of documents: tokens of
a base span are B and I, all others O. Every taught secret is also redrawn over other
alphabets, and half lose the words around them, so that the shape of a secret counts on its own.

A token's shape is one of a fixed number of classes, so the emission scores of a text are table
look-ups. A token whose score for "outside" leads by more than all transitions can make up is
outside in the best path; Viterbi decodes the stretches between such tokens, which gives the same
path as decoding the whole text. Training sums the gradients of partitions (windows around
taught spans, ``MAX_TRAIN`` documents at most); scanning needs no shuffle.

A null text counts as empty; rows that repeat are scanned one by one.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import batch_of, id_back, id_key, minimise, parts_for, sample_below
from fraudlake.session import cut

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")   # maximal runs, as runs of any length then kept from 24 characters
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex", "crf")
MASK = "[SECRET]"

MAX_TRAIN = 6_000       # documents used for the fit
ROWS_PER_SUM = 3_000    # windows of one partial sum
REACH = 10              # tokens of a training window on either side of its centre
HARD = 8               # outsiders that look like secrets, drawn from each text of the sample
L2 = 0.02
SEED = 29
TOKEN = re.compile(r"[^\s\"'`,;:=()<>\[\]{}|]+|[:=]")
KEYS = re.compile(r"pass|secret|token|key|cred|auth|pwd|bearer", re.I | re.A)
# Values that taught secrets are redrawn from, so that their shape is learnt and not their alphabet.
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "_-")
O, B, I = 0, 1, 2
N_OWN = 7 * 4 * 3 * 2 + 4
N_FILE = 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, by start and then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def shape(token: str) -> int:
    """Class of a token: sign, address, link; otherwise length step, mix of letters and digits, changes between kinds of characters, key word."""
    if token in ":=":
        return N_OWN - 1
    if "@" in token:
        return N_OWN - 3
    if "//" in token or token.startswith("www."):
        return N_OWN - 4
    n = len(token)
    digits = sum(map(str.isdigit, token))
    step = 0 if n < 4 else 1 if n < 8 else 2 if n < 12 else 3 if n < 16 else 4 if n < 24 else 5 if n < 36 else 6
    upper = any(map(str.isupper, token[1:]))
    lower = any(map(str.islower, token))
    mix = 0 if not digits else 1 if digits == n else 2 if not (upper and lower) else 3
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    rate = 0 if changes <= 1 else 1 if changes * 4 < len(kinds) else 2
    return ((step * 4 + mix) * 3 + rate) * 2 + bool(KEYS.search(token))


WORD_SHAPE = shape("words")


class Shapes(dict):
    """Shape of every token, kept for tokens seen before."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = k = shape(token)
        return k


def file_features(text: str, classes: np.ndarray) -> np.ndarray:
    """Features of the whole text, the same for all of its tokens."""
    n = max(len(text), 1)
    t = max(len(classes), 1)
    digits = (classes < N_OWN - 4) & (classes // 6 % 4 > 0)
    return np.array([1.0, min(text.count("\n") * 40 / n, 2.0), min(text.count("=") * 200 / n, 2.0), min(text.count("{") * 200 / n, 2.0),
                     min(digits.sum() * 20 / t, 2.0), float(n < 500), float("BEGIN" in text), min(text.count(";") * 200 / n, 2.0)])


@dataclass
class Field:
    """Weights of the field: own, previous, next and second previous shape, file features, transitions."""
    own: np.ndarray
    prev: np.ndarray
    nxt: np.ndarray
    prev2: np.ndarray
    file: np.ndarray
    move: np.ndarray

    @staticmethod
    def size() -> int:
        return N_OWN * 3 * 4 + N_FILE * 3 + 9

    @staticmethod
    def of(v: np.ndarray) -> Field:
        k = N_OWN * 3
        return Field(*(v[i * k:(i + 1) * k].reshape(N_OWN, 3) for i in range(4)), v[4 * k:4 * k + N_FILE * 3].reshape(N_FILE, 3), v[-9:].reshape(3, 3))

    def emissions(self, c: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Scores (tokens x labels). Beyond the text stands the class N_OWN - 2."""
        pad = np.full(2, N_OWN - 2)
        p = np.concatenate((pad, c, pad[:1]))
        return self.own[c] + self.prev[p[1:-2]] + self.prev2[p[:-3]] + self.nxt[p[3:]] + file @ self.file

    def decode(self, c: np.ndarray, file: np.ndarray) -> list[tuple[int, int]]:
        """Token runs (first, end) tagged B I* by the best path."""
        if not len(c):
            return []
        e = self.emissions(c, file)
        lead = e[:, O] - np.maximum(e[:, B], e[:, I])
        unsure = np.flatnonzero(lead <= 2 * (self.move.max() - self.move.min()) + 1e-9)
        runs, at = [], 0
        while at < len(unsure):
            end = at + 1
            while end < len(unsure) and unsure[end] == unsure[end - 1] + 1:
                end += 1
            a, b = int(unsure[at]), int(unsure[end - 1]) + 1
            runs += [(a + x, a + y) for x, y in self._viterbi(e[a:b], a > 0, b < len(c))]
            at = end
        return runs

    def _viterbi(self, e: np.ndarray, after: bool, before: bool) -> list[tuple[int, int]]:
        """Best path of a stretch; outside tokens stand before it (``after``) and behind it (``before``)."""
        s = e[0] + (self.move[O] if after else 0.0)
        back = []
        for row in e[1:]:
            t = s[:, None] + self.move
            back.append(t.argmax(axis=0))
            s = t.max(axis=0) + row
        if before:
            s = s + self.move[:, O]
        path = [int(s.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        runs, start = [], None
        for i, y in enumerate([*path, O]):
            if start is not None and y != I:
                runs.append((start, i))
                start = None
            if y == B or (y == I and start is None):
                start = i
        return runs


def scan(text: str | None, field: Field | None, shapes: Shapes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text: base ones and those the field adds."""
    if not text:
        return []
    spans = base_spans(text)
    if field is None:
        return spans
    tokens = TOKEN.findall(text)
    c = np.fromiter(map(shapes.__getitem__, tokens), np.int64, len(tokens))
    runs = field.decode(c, file_features(text, c))
    found = list(TOKEN.finditer(text)) if runs else []
    added = []
    for a, b in runs:
        s, e = found[a].start(), found[b - 1].end()
        if all(e <= x or s >= y for x, _, y in spans):
            added.append((s, 3, e))
    return sorted(spans + added)


def windows(text: str | None, shapes: Shapes, rng_seed: int):
    """Training windows of one text: token classes with context, labels, file features."""
    if not text:
        return
    found = list(TOKEN.finditer(text))
    n = len(found)
    if not n:
        return
    c = np.fromiter((shapes[m[0]] for m in found), np.int64, n)
    y = np.zeros(n, np.int64)
    starts = np.fromiter((m.start() for m in found), np.int64, n)
    for s, kind, e in base_spans(text):
        if kind == 0:
            s = e - len(ASSIGN.match(text, s)[2])
        a, b = int(np.searchsorted(starts, s, "right")) - 1, int(np.searchsorted(starts, e))
        y[max(a, 0)] = B
        y[max(a, 0) + 1:b] = I
    rng = np.random.default_rng(rng_seed & 0x7FFFFFFF)
    file = file_features(text, c)
    pad = np.full(REACH + 2, N_OWN - 2)
    cp, yp = np.concatenate((pad, c, pad)), np.concatenate((np.zeros(REACH + 2, np.int64), y, np.zeros(REACH + 2, np.int64)))
    # centres: every taught begin, tokens with digits (hard outsiders) and some of the rest
    hard = np.flatnonzero((y == O) & (c < N_OWN - 2) & ((c >= N_OWN - 4) | (c // 6 % 4 > 0)))
    hard = np.sort(rng.choice(hard, min(len(hard), HARD), replace=False))       # drawn over the whole text
    begins = np.flatnonzero(y == B).tolist()
    for centre, redrawn in [*((k, r) for k in begins for r in (False, True, True)), *((k, False) for k in hard.tolist()),
                            *((k, False) for k in rng.integers(0, n, 2).tolist())]:
        w = cp[centre:centre + 2 * REACH + 5].copy()
        lab = yp[centre + 2:centre + 2 * REACH + 3]
        if redrawn:
            w[REACH + 2] = shape("".join(rng.choice(list(ALPHABETS[rng.integers(len(ALPHABETS))]), rng.integers(18, 48))))
        if y[centre] == B and rng.random() < 0.5:
            near = np.concatenate(([False] * 2, lab == O, [False] * 2))
            w[near] = WORD_SHAPE
        yield w, lab, file


def loss(v: np.ndarray, w: np.ndarray, y: np.ndarray, file: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the windows and its gradient, by forward and backward sums over all windows at once."""
    f = Field.of(v)
    own, prev, prev2, nxt = w[:, 2:-2], w[:, 1:-3], w[:, :-4], w[:, 3:-1]
    e = f.own[own] + f.prev[prev] + f.prev2[prev2] + f.nxt[nxt] + (file @ f.file)[:, None, :]
    n, t, _ = e.shape
    fwd = np.empty((n, t, 3))
    bwd = np.zeros((n, t, 3))
    fwd[:, 0] = e[:, 0]

    def lse(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for k in range(1, t):
        fwd[:, k] = lse(fwd[:, k - 1][:, :, None] + f.move[None], 1) + e[:, k]
    for k in range(t - 2, -1, -1):
        bwd[:, k] = lse(f.move[None] + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
    z = lse(fwd[:, -1], 1)
    p = np.exp(fwd + bwd - z[:, None, None])
    pair = np.exp(fwd[:, :-1, :, None] + f.move[None, None] + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
    hot = np.eye(3)[y]
    gold = (e * hot).sum() + f.move[y[:, :-1], y[:, 1:]].sum()
    d = p - hot
    g = np.zeros_like(v)
    out = Field.of(g)
    for table, idx in ((out.own, own), (out.prev, prev), (out.prev2, prev2), (out.nxt, nxt)):
        for lab in range(3):
            table[:, lab] += np.bincount(idx.ravel(), weights=d[:, :, lab].ravel(), minlength=N_OWN)
    out.file += file.T @ d.sum(axis=1)
    seen = np.zeros((3, 3))
    np.add.at(seen, (y[:, :-1], y[:, 1:]), 1)
    out.move += pair - seen
    return float(z.sum() - gold), g


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, rounds: int = 25) -> Field | None:
    """Train on a sample of the documents (by the hash of text and row number); None when no token was taught as a secret.

    Documents with a base span are taken before others: half of the sample, where there are as many.
    """
    # the row number tells copies apart, so that the sample stays bounded whatever their number
    rows = docs.select("text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    hit = F.col("text").rlike(r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{24}")
    counts = rows.agg(F.count(F.when(hit, 1)).alias("hits"), F.count("text").alias("all")).first()
    keep = (hit & sample_below(counts["hits"], max_train // 2, "text", "row", seed=SEED)) | \
           (~hit & sample_below(counts["all"] - counts["hits"], max_train // 2, "text", "row", seed=SEED))
    schema = pa.schema([("w", pa.binary())])
    width = (2 * REACH + 5) + (2 * REACH + 1) + N_FILE

    def make(batches):
        shapes = Shapes()
        for b in batches:
            out = [np.concatenate(x).astype(np.float64).tobytes()
                   for t, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist()) for x in windows(t, shapes, h)]
            yield batch_of(schema, out)

    train = cut(rows.where(F.col("text").isNotNull() & keep).mapInArrow(make, "w binary"))
    n = train.count()
    if not n:
        return None
    train = cut(train.repartition(parts_for(n, ROWS_PER_SUM)))
    spark = docs.sparkSession

    def run(v: np.ndarray):
        sent = spark.sparkContext.broadcast(v)   # a fixed number of weights

        def each(batches):
            got = [x for b in batches for x in b.column("w").to_pylist()]
            if got:
                m = np.frombuffer(b"".join(got), np.float64).reshape(len(got), width)
                a = 2 * REACH + 5
                f, g = loss(sent.value, m[:, :a].astype(np.int64), m[:, a:-N_FILE].astype(np.int64), m[:, -N_FILE:])
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([f], g)).tobytes()], pa.binary())], ["s"])

        total = sum(np.frombuffer(r.s) for r in train.mapInArrow(each, "s binary").collect())   # as many rows as partial sums
        return total[0] + L2 * n / 100 * (v @ v) / 2, total[1:] + L2 * n / 100 * v

    start = np.zeros(Field.size())
    Field.of(start).move[O, I] = -4.0
    return Field.of(minimise(run, start, rounds=rounds, tol=1e-4))


def named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id``, counts of the base kinds and of added spans, the digest of the base spans and all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        shapes = Shapes()
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                spans = scan(text, sent.value, shapes)
                n = [sum(k == x for _, k, _ in spans) for x in range(4)]
                rows.append((*n, hashlib.sha256(named(x for x in spans if x[1] < 3).encode()).hexdigest(), named(spans)))
            yield batch_of(schema, b.column("id"), *(list(c) for c in (zip(*rows) if rows else [[]] * 6)))

    ddl = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(id_key().alias("id"), "text").mapInArrow(run, ddl).withColumn("id", id_back("id")).withColumnRenamed("id", "doc_id")


def redact(docs: DataFrame, field: Field | None, mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one); ``n_chars`` follows the text where it exists."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def hide(text, shapes):
        spans = scan(text, sent.value, shapes)
        if not spans:
            return text
        out, at, end = [], 0, -1
        for s, _, e in spans:
            if s >= end:
                out += [text[max(at, 0):s], mask]
            at = end = max(end, e)
        return "".join([*out, text[at:]])

    def run(batches):
        shapes = Shapes()
        for b in batches:
            texts = [hide(t, shapes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
