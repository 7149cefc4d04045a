"""Words, shingle hashes and small numeric helpers shared by the training-data operators.

Conventions that hold for every operator here: a null text counts as an empty one, a null
``doc_id`` sorts before all others and comes back as null, columns beside those an operator
reads are ignored or carried through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlake.session import tune

NULL_ID = -(2**63)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def id_key(col: str | Column = "doc_id") -> Column:
    """The id as a long that is never null; ``id_back`` is the way back."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("long"), F.lit(NULL_ID))


def id_back(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != NULL_ID, c)


def held_out(mod: int, rest: int, col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def no_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def parts_for(rows: int, per_part: int) -> int:
    """Partitions that hold about ``per_part`` rows each."""
    return max(1, -(-rows // per_part))


def sample_below(n: int, bound: int, *cols: str, seed: int = 0) -> Column:
    """A condition that keeps about ``bound`` of ``n`` rows by the hash of ``cols``: the same rows in every run."""
    share = min(1.0, bound / max(n, 1))
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 20)) < int(share * (1 << 20))


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and the five ASCII control spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``n`` words joined by a space; of the whole sequence when there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    out = b"".join([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1:].tolist())])
    return np.frombuffer(out, ">u8").astype(np.uint64)


def words_lower(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; other letters stay."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Codes(dict):
    """A 64-bit hash of every word, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` word codes; order counts. Empty when there are fewer words."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * GOLD + codes[k:k + m]
            h ^= h >> np.uint64(29)
        return mix(h)


ONES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, least significant first. Bytes are added in lanes of one word."""
    out = np.zeros((8, 8), np.int64)
    for at in range(0, len(h), 255 * 512):
        part = h[at:at + 255 * 512]
        rows = -(-len(part) // 255)
        block = np.zeros(rows * 255, np.uint64)
        block[: len(part)] = part
        block = block.reshape(rows, 255)
        for b in range(8):
            lanes = ((block >> np.uint64(b)) & ONES).sum(axis=1, dtype=np.uint64)
            out[b] += lanes.view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
    return out.T.reshape(64)


def pack_bits(bits: np.ndarray) -> int:
    """64 booleans, least significant first, as a signed long."""
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def batch_of(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                                       for c, f in zip(cols, schema, strict=True)], schema=schema)


def minimise(fun, x: np.ndarray, rounds: int = 30, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """L-BFGS with step halving; ``fun`` returns value and gradient."""
    f, g = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(np.abs(g).max(), 1e-9)
        for (s, y), a in zip(steps, reversed(alphas)):
            q += s * (a - y @ q / (s @ y))
        t, slope = 1.0, -(g @ q)
        for _ in range(12):
            new = x - t * q
            fn, gn = fun(new)
            if fn <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            return x
        s, y = new - x, gn - g
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1:], (s, y)]
        done = k > 3 and abs(f - fn) <= tol * max(abs(f), 1e-9)
        x, f, g = new, fn, gn
        if done:
            break
    return x


# Rows of a batch sent to Python: whole texts may be long.
BATCH_ROWS = 2000


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the operators; a batch sent to Python stays small even when its texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return tune(spark)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
