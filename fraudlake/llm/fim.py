"""Fill-in-middle transformation by block rotations in place.

A text is cut at two token boundaries (a token is a run of ASCII letters or one other code point) into
prefix, middle and suffix. The bytes are held in one bytearray; sentinels are inserted at the cuts, from the back, and the
blocks then change places by three reversals (each block, then both together): ``psm`` exchanges middle and suffix, ``spm``
exchanges suffix with what stands before it. ``restore`` scans the sentinels, rotates the same blocks back, takes the
sentinels out and so has the exact bytes again.

Cuts and form of a row follow from the SHA-256 of the seed and its id, so every run and every retry makes the same
rows. One pass over the rows, no shuffle; a task holds a batch of texts and arrays of a few times the longest one.

A null text counts as empty. An empty text and one that already holds a sentinel stay ``plain`` (their cuts are null). A null id
hashes like an empty one; repeated rows give equal results. A very long text is handled whole. Columns of the input other than the
text are carried through, those named as the results are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
FIM_PERCENT, SPM_PERCENT = 90, 20
SEED = 1
RESULTS = {"fim_tokens": "long", "fim_form": "string", "prefix_chars": "long", "middle_chars": "long", "fim_output": "string"}


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers from the SHA-256 of ``seed:id``."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k:k + 4], "big") for k in (0, 4, 8, 12))


def scan(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which tokens start, with the end of the text as the last one, and those at which code points start."""
    b = np.frombuffer(data, np.uint8)
    point = (b & 0xC0) != 0x80
    low = b | 0x20
    letter = (low >= 97) & (low <= 122)     # only ASCII letters: bytes of longer code points are above 127
    inside = np.zeros(len(b), bool)
    inside[1:] = letter[1:] & letter[:-1]
    return np.append(np.flatnonzero(point & ~inside), len(b)), np.flatnonzero(point)


def exchange(line: np.ndarray, start: int, mid: int, end: int) -> None:
    """Let ``line[start:mid]`` and ``line[mid:end]`` change places: both are reversed, then the whole stretch."""
    for a, b in ((start, mid), (mid, end), (start, end)):
        line[a:b] = line[a:b][::-1].copy()


def rotate(line: bytearray, form: str, middle: int, suffix: int) -> None:
    """From prefix, middle, suffix (the last two start at the given offsets) to the order of ``form``."""
    exchange(np.frombuffer(line, np.uint8), middle if form == PSM else 0, suffix, len(line))


def transform_bytes(data: bytes, numbers: tuple[int, ...], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT):
    """Tokens, form, code points of prefix and middle (None if plain) and the output of one text."""
    starts, points = scan(data)
    n = len(starts) - 1
    h1, h2, h3, h4 = numbers
    if not data or h3 % 100 >= fim_percent or any(s in data for s in SENTINELS):
        return n, PLAIN, None, None, data
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(starts[one]), int(starts[two])
    line = bytearray(data)
    line[b:b] = SUFFIX
    line[a:a] = MIDDLE
    line[0:0] = PREFIX
    form = SPM if h4 % 100 < spm_percent else PSM
    rotate(line, form, a + len(PREFIX), b + len(PREFIX) + len(MIDDLE))
    at = np.searchsorted(points, (a, b))
    return n, form, int(at[0]), int(at[1] - at[0]), bytes(line)


def restore_bytes(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made of."""
    if form == PLAIN:
        return output
    line = bytearray(output)
    # the blocks that follow the first one start at the sentinels; texts hold none, and no sentinel can overlap another
    if form == PSM:
        first = line.index(SUFFIX)
        second = line.index(MIDDLE, first)
        exchange(np.frombuffer(line, np.uint8), first, second, len(line))       # middle before suffix again
        middle, suffix = first, first + len(line) - second
    else:
        first = line.index(PREFIX)
        length = len(line)
        middle = line.index(MIDDLE, first) - first
        exchange(np.frombuffer(line, np.uint8), 0, first, length)               # suffix behind the others again
        suffix = length - first
    del line[suffix:suffix + len(SUFFIX)]
    del line[middle:middle + len(MIDDLE)]
    del line[:len(PREFIX)]
    return bytes(line)


def _mapped(df: DataFrame, cols: list[str], added: dict[str, str], fun) -> DataFrame:
    """``df`` with the columns ``added``, which ``fun`` computes row by row from binary copies of ``cols``."""
    rest = df.drop(*added)
    packed = rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"), *cols)
    schema = StructType([*packed.schema.fields[:1]])
    for name, kind in added.items():
        schema = schema.add(name, "binary" if kind == "string" else kind)

    def run(batches):
        for b in batches:
            out = [fun(*r) for r in zip(*(b.column(k).to_pylist() for k in range(1, b.num_columns)))]
            new = zip(*out) if out else [()] * len(added)
            kinds = [pa.binary() if k == "string" else pa.int64() for k in added.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(v), k) for v, k in zip(new, kinds, strict=True))], ["row", *added])

    done = packed.mapInArrow(run, schema)
    return done.select("row.*", *[F.col(n).cast(k).alias(n) for n, k in added.items()])


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with ``fim_tokens``, ``fim_form``, ``prefix_chars``, ``middle_chars`` and ``fim_output``."""
    return _mapped(docs, [F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")], RESULTS,
                   lambda i, data: transform_bytes(data, draws(i, seed), fim_percent, spm_percent))


def restore(made: DataFrame, name: str = "restored") -> DataFrame:
    """``made`` with the exact text rebuilt from ``fim_output`` and ``fim_form`` alone."""
    return _mapped(made, [F.col("fim_output").cast("binary"), F.col("fim_form")], {name: "string"},
                   lambda output, form: (restore_bytes(output, form),))


# The same cuts over lists of tokens; the text rebuilt is the text itself.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS tok,
             ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(tok) AS n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS a, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(tok[1:a], '') AS pre, array_to_string(tok[a + 1:b], '') AS mid, array_to_string(tok[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
