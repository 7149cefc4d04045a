"""Token alignment, fill-in-middle and exact duplicates against plain versions, on odd rows too."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fraudlake.llm import align, exact_dedup, fim
from fraudlake.llm.common import ready, table
from fraudlake.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DDL = ("doc_id long, text string, lang string, row long, run long, keep_id string, at string, doc string, fim_form string, "
       "restored int, `a.b` int, tags map<string,int>")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows, repeated ids, sentinels, other scripts, names that clash."""
    ready(spark)
    rng = random.Random(5)
    words = ["the", "of", "Straße", "naïve", "数据", "x1", "'s", "🙂", "ab"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    solid = "".join(rng.choice("abcde数") for _ in range(3_000))
    rows = [(1, "copy of a text"), (2, "copy of a text"), (9, "copy of a text"), (3, None), (4, ""), (None, "no id here"), (None, "copy of a text"),
            (5, long), (6, long), (7, solid), (8, "has <P> inside"), (10, " \n\t  two  spaces "), (11, "piece ▁ sign"), (12, "<|endoftext|> plain <0x41> text"),
            (13, "repeated row"), (13, "repeated row"), (13, "other text of one id"), (14, "é combining   space"), (15, "A"), (16, "nul \x00 byte")]
    return spark.createDataFrame([(i, t, None, k, -k, "keep", "at", "doc", "form", k, k, {"k": k}) for k, (i, t) in enumerate(rows)], DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def key(row):
    return [(v is not None, str(v)) for v in row]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=key)


# fill in the middle

def plain_tokens(text):
    out = []
    for c in text:
        if c.isascii() and c.isalpha() and out and out[-1][-1].isascii() and out[-1][-1].isalpha():
            out[-1] += c
        else:
            out.append(c)
    return out


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    tok = plain_tokens(text)
    a, b = sorted((h1 % (len(tok) + 1), h2 % (len(tok) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tok), "plain", None, None, text
    p, m, s = "".join(tok[:a]), "".join(tok[a:b]), "".join(tok[b:])
    if h4 % 100 < 20:
        return len(tok), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tok), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_plain_cuts_and_restores(spark, odd):
    for docs in (odd.select("doc_id", "text"), table(spark, SMALL).select("doc_id", "text")):
        got = fim.restore(fim.transform(docs)).select("doc_id", "text", *fim.RESULTS, "restored").collect()
        assert len(got) == docs.count()
        for r in got:
            assert tuple(r)[2:7] == plain_fim(r.doc_id, r.text)
            assert r.restored == (r.text or "")
    assert {r.fim_form for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZ<>PSM é数🙂\n"), max_size=30), st.tuples(*[st.integers(0, 2**32 - 1)] * 4), st.booleans())
def test_fim_round_trip_of_any_text(text, numbers, all_spm):
    data = text.encode()
    n, form, a, b, out = fim.transform_bytes(data, numbers, 100, 100 if all_spm else 20)
    assert n == len(plain_tokens(text))
    assert fim.restore_bytes(out, form) == data
    if form != "plain":
        assert len(out) == len(data) + 9 and text[:a].encode() in out


def test_exchange_is_a_rotation():
    line = np.arange(10, dtype=np.uint8)
    fim.exchange(line, 2, 5, 9)
    assert line.tolist() == [0, 1, 5, 6, 7, 8, 2, 3, 4, 9]


def test_fim_carries_columns_and_takes_empty_tables(odd, empty):
    got = fim.transform(odd)
    assert set(got.columns) == set(odd.columns) | set(fim.RESULTS)
    assert rows_of(got.select("row", "`a.b`", "keep_id", "at", "doc", "run")) == rows_of(odd.select("row", "`a.b`", "keep_id", "at", "doc", "run"))
    assert got.where("tags['k'] = row").count() == odd.count()
    assert fim.restore(fim.transform(empty)).count() == 0


# exact duplicates

def plain_groups(docs, largest):
    by = defaultdict(list)
    for i, t in docs:
        by[t or ""].append(i)
    low = -(2**63)
    out = []
    for i, t in docs:
        ids = sorted(low if x is None else x for x in by[t or ""])
        keep = ids[-1] if largest else ids[0]
        out.append((i, None if keep == low else keep, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("sizes", [{}, {"leaf_rows": 2, "range_rows": 3, "fan": 2}, {"leaf_rows": 7, "range_rows": 1_000, "fan": 3}])
def test_exact_groups(odd, keep, sizes):
    got = exact_dedup.groups(odd.repartition(3, "row"), keep, **sizes).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == plain_groups(docs, keep == "largest")
    # one row of each text stays, also among repeated rows of one id
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256: 1 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_groups_of_one_hot_text(spark):
    """A third of all rows are copies of one text: each run passes it on once."""
    docs = spark.range(0, 3_000, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    got = exact_dedup.groups(docs, leaf_rows=50, range_rows=200, fan=4)
    assert rows_of(got.select("doc_id", "keep_id", "group_size", "text_sha256")) == plain_groups([tuple(r) for r in docs.collect()], False)
    run = exact_dedup.merge([exact_dedup.merge([x], False) for x in np.array_split(np.zeros(900, exact_dedup.RECORD), 9)], False)
    assert len(run) == 1


def test_digests_that_agree_are_checked():
    """Equal digests with another check stay apart at every level."""
    r = np.zeros(4, exact_dedup.RECORD)
    r["key"] = [b"d" * 32 + b"c" * 16, b"d" * 32 + b"x" * 16, b"d" * 32 + b"c" * 16, b"d" * 32 + b"c" * 15 + b"\0"]
    r["id"], r["row"], r["count"] = [5, 6, 4, 9], [0, 1, 2, 3], 1
    got = exact_dedup.merge([r[:2][np.argsort(r["key"][:2])], r[2:][np.argsort(r["key"][2:])]], False)
    assert sorted(zip(got["id"].tolist(), got["count"].tolist())) == [(4, 2), (6, 1), (9, 1)]


def test_keep_one_carries_all_columns(odd, empty):
    got = exact_dedup.keep_one(odd, "largest")
    assert got.columns == odd.columns
    assert got.count() == len({r.text or "" for r in odd.collect()})
    assert {r.doc_id for r in got.where("text = 'copy of a text'").collect()} == {9}
    assert got.where("tags['k'] = row and `a.b` = row").count() == got.count()
    assert exact_dedup.keep_one(empty).count() == 0 and exact_dedup.groups(empty).count() == 0


# alignment

ends = st.lists(st.integers(1, 40), max_size=30)


@settings(max_examples=300, deadline=None)
@given(ends, ends, st.integers(1, 12))
def test_groups_do_not_depend_on_the_pieces(x, y, work):
    end = max(x + y, default=1)
    a, b = np.array(sorted({*x, end})), np.array(sorted({*y, end}))
    shared = np.intersect1d(a, b)
    ga, gb = align.group_numbers(a, b, work)
    assert ga.tolist() == np.searchsorted(shared, a).tolist() and gb.tolist() == np.searchsorted(shared, b).tolist()
    at, bt = align.diagonals(a, b, work)
    assert (np.diff(at) + np.diff(bt))[:-1].tolist() == [work] * (len(at) - 2)      # equal work, the last piece has the rest


def plain_alignment(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = align.paths()
    ta, tb = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    ta.encode_special_tokens = True
    back, name = align.byte_alphabet(), {i: s for s, i in ta.get_vocab().items()}

    def bytes_b(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    lines, links = [], []
    for _, text in docs:
        groups = []
        if text:
            x, y = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            wa, wb = [bytes(back[c] for c in name[i]) for i in x], [bytes_b(i) for i in y]
            if b"".join(wa) == b"".join(wb) == (" " + text).encode():
                p, q, ea, eb = [], [], 0, 0
                x, y = list(zip(x, map(len, wa))), list(zip(y, map(len, wb)))
                while x or y:
                    if ea <= eb and x:
                        i, n = x.pop(0)
                        p, ea = [*p, i], ea + n
                    else:
                        i, n = y.pop(0)
                        q, eb = [*q, i], eb + n
                    if ea == eb:
                        groups.append((p, q))
                        p, q = [], []
        lines.append(groups)
        links.append(Counter((i, j) for p, q in groups for i in p for j in q))
    held, best = Counter(k for c in links for k in c), defaultdict(int)
    for (i, _), n in [(k, held[k]) for k in held]:
        best[i] = max(best[i], n)
    out = []
    for (i, _), g, c in zip(docs, lines, links):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        out.append((i, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(c.values()),
                    sum(n for k, n in c.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=key), held, best


@pytest.mark.parametrize("block_tokens", [align.BLOCK_TOKENS, 40])
def test_alignment_equals_plain_merge(spark, odd, block_tokens):
    short = odd.where(F.coalesce(F.length("text"), F.lit(0)) < 4_000)
    docs = short.select("doc_id", "text").unionByName(table(spark, SMALL).select("doc_id", "text").where("length(text) < 1500").limit(40))
    rows = [tuple(r) for r in docs.collect()]
    want, _, _ = plain_alignment(rows)
    assert rows_of(align.align_documents(docs, block_tokens=block_tokens)) == want
    unlike = [r for r in want if r[1] == 0]
    assert len(unlike) >= 3                                                           # null, empty, other bytes


def test_pair_table_and_long_texts(spark, odd):
    docs = odd.where("doc_id in (1, 2, 7, 14)")
    _, held, best = plain_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {((r.a, r.b), r.n, r.best) for r in align.pair_table(docs).collect()} == {(k, n, n == best[k[0]]) for k, n in held.items()}
    v, w = (align.vocabulary(p) for p in align.paths())
    text = odd.where("doc_id = 5").first().text
    assert len(align.chunks_of(text, 1_000)) > 50 and " ".join(align.chunks_of(text, 1_000)) == text
    for x in (v, w):
        assert x.splits and x.encode([text], 1_000)[0].tolist() == x.encode([text], 10**9)[0].tolist()
        assert x.decode(x.encode([text])[0]) == b" " + text.encode()


def test_alignment_of_an_empty_table(empty):
    assert align.align_documents(empty).count() == 0 and align.pair_table(empty).count() == 0


def test_queries_give_their_columns(spark):
    want = {"op11_merge_path_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
            "op12_rotation_fim": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
            "op13_run_merge_dedup": "doc_id keep_id group_size kept text_sha256"}
    for name, cols in want.items():
        got = QUERIES[name](spark, SMALL)
        assert got.columns == cols.split() and got.count() == 200
