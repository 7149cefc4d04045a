"""Order statistics, monotone fit, running maxima, limited peers, searches from many seeds: paths for big inputs against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, SEC_US
from fraudlake.operators import components, decide, detect, evaluate, model, neighbors, pit, quality, ranks, retrieval, rings
from fraudlake.operators.rolling import value_numbers
from fraudlake.operators.timeline import running_max

LOW = {"fraudlake.maxRowsPerTask": 60}


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=900), np.repeat(0.25, 400), np.repeat(-0.0, 5), [np.inf, np.inf, -np.inf, 1e300, -1e-300], rng.integers(0, 20, 300) / 10])
    rng.shuffle(x)
    return x, spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)


@pytest.mark.parametrize("limit,parts", [(10**6, 1000), (50, 10), (3, 4)])
def test_values_at_any_rank(numbers, limit, parts):
    x, df = numbers
    x = np.sort(x)
    at = [0, 1, 7, 400, 700, 701, 900, len(x) - 3, len(x) - 1, len(x) + 5]
    got = ranks.values_at(df, "x", at, limit, parts)
    assert got == {r: (x[r], int((x < x[r]).sum()), int((x == x[r]).sum())) for r in at if r < len(x)}


def test_values_at_of_nothing_and_one_value(spark):
    df = spark.createDataFrame([], "x double")
    assert ranks.values_at(df, "x", [0, 3]) == {} and ranks.quantiles(df, "x", [0.5]) == []
    one = spark.createDataFrame([(2.5,)] * 9, "x double")
    assert ranks.values_at(one, "x", [0, 8], 2, 3) == {0: (2.5, 0, 9), 8: (2.5, 0, 9)}


def test_quantiles_interpolate(spark):
    x = np.random.default_rng(7).random(501)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0, 0.1, 0.333, 0.5, 0.9, 1]
    assert np.allclose(ranks.quantiles(df, "x", probs, 40), np.quantile(x, probs))


def test_keys_at_with_ties_nan_and_null_scores(spark, conf):
    rng = random.Random(2)
    data = [(rng.choice([0.1, 0.2, 0.2, 0.9, float("nan"), None, rng.random()]), i * 2**30 - 2**33) for i in range(600)]
    df = spark.createDataFrame(data, "risk_score double, txn_id long")
    key = df.select(F.col("risk_score").isNull().alias("z"), F.coalesce("risk_score", F.lit(0.0)).alias("s"), "txn_id")
    order = sorted(data, key=lambda r: (r[0] is None, r[0] != r[0], r[0] if r[0] is not None and r[0] == r[0] else 0.0, r[1]))
    at = [0, 60, 120, 180, 240, 300, 360, 420, 480, 540, 599]
    for kv in ({}, LOW):
        with conf(**kv):
            assert [t[2] for t in ranks.keys_at(key, 600, at)] == [order[r][1] for r in at]
    with conf(**{"fraudlake.maxRowsPerTask": 100}):
        want = {r[1]: k for k, r in enumerate(order)}
        assert all(r.risk_decile == want[r.txn_id] // 60 + 1 for r in pit.risk_decile(df).collect())


def test_running_total_and_auc_by_ranges(spark):
    x = [(round(random.Random(i).random(), 2), i % 3 == 0) for i in range(400)]
    by = spark.createDataFrame(x, "p double, y boolean").groupBy("p").agg(F.count("*").alias("n"))
    got = {r.p: r.before for r in ranks.running_total(by, "p", "n", rows_per_range=7).collect()}
    assert got == {p: sum(q < p for q, _ in x) for p in {p for p, _ in x}}


def plain_fit(x, y, w):
    """Pool adjacent violators over distinct scores, one at a time."""
    blocks = []
    for v in np.unique(x):
        m = x == v
        blocks.append([v, v, (y[m] * w[m]).sum(), w[m].sum()])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return sorted({(p, round(s / v, 9)) for a, b, s, v in blocks for p in (a, b)})


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "late drop"])
def test_isotonic_by_ranges_equals_plain(spark, kind):
    rng = np.random.default_rng(3)
    x = np.round(rng.random(700), 3)
    chance = {"noise": 0.5 + 0 * x, "rising": x, "falling": 1 - x, "late drop": np.where(x < 0.97, x, 0.0)}[kind]
    y, w = (rng.random(700) < chance).astype(float), rng.integers(1, 4, 700).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)], "p double, y double, weight double").repartition(4)
    want = plain_fit(x, y, w)
    for size in (10**6, 9):
        got = sorted((r.x, round(r.y, 9)) for r in model.fit_isotonic(df, range_rows=size).collect())
        assert got == want


def test_pooling_a_long_chain_is_linear():
    n = 200_000
    m = np.append(np.arange(1.0, n), -1e12)
    x0, x1, wy, w = model.pool(np.arange(n), np.arange(n), m, np.ones(n))
    assert len(w) == 1 and w[0] == n and x0[0] == 0 and x1[0] == n - 1


def test_stratified_sample_does_not_depend_on_the_ranges(fx, conf):
    ask = lambda: rows(evaluate.stratified_sample(fx.cases, F.col("pattern"), 20).select("case_id", "stratum"))
    plain = ask()
    assert len(plain) == 20
    with conf(**{"fraudlake.maxRowsPerTask": 4}):
        assert ask() == plain


def test_value_numbers_of_a_big_card(spark, conf):
    rng = random.Random(9)
    r = [(c, rng.choice([float(rng.randrange(300)), float("nan"), -1.5])) for c in ["hot"] * 900 + ["few"] * 20 + [None] * 50]
    df = spark.createDataFrame(r, "card string, v double")
    key = lambda v: (v != v, v if v == v else 0)
    want = {(c, str(v)): k for c in {c for c, _ in r} for k, v in enumerate(sorted({str(x): x for d, x in r if d == c}.values(), key=key))}
    for kv in ({}, LOW):
        with conf(**kv):
            assert {(x.card, str(x.v)): x.number for x in value_numbers(df).collect()} == want


def test_running_max_by_slices(spark, conf):
    rng = random.Random(1)
    ev = [(c, rng.randrange(1000), rng.random()) for c in ["a"] * 400 + ["b"] * 9 + [None] * 3]
    pr = [(c, rng.randrange(-5, 1010), i) for i, c in enumerate(["a"] * 60 + ["b"] * 9 + ["c"])]
    events, probes = spark.createDataFrame(ev, "k string, t long, m double"), spark.createDataFrame(pr, "k string, t long, id long")
    want = {i: max((m for k, u, m in ev if k == c and u <= t), default=None) for c, t, i in pr}
    for kv in ({}, LOW):
        with conf(**kv):
            assert {r.id: r.m for r in running_max(events, probes, ["k"], "m", ["id"]).collect()} == want


def test_big_purchase_looks_at_the_largest_earlier_amount(spark):
    flags = spark.createDataFrame([("A", "c", 100, 1500.0), ("B", "c", 50, 1500.0), ("C", "c", 100, 900.0), ("D", None, 100, 5000.0), ("E", "d", 100, 3000.0)],
                                  "alert_id string, customer_id string, ts_us long, amt double")
    txn = spark.createDataFrame([("c", 60, 800.0), ("c", 100, 9000.0), ("c", 40, 100.0), ("d", 5, 1499.0), ("d", 7, 1400.0)], "customer_id string, ts_us long, amt double")
    got = {r.alert_id: r.has_prior_big for r in detect.prior_big_purchases(flags, txn).collect()}
    assert got == {"A": True, "B": False, "C": False, "D": False, "E": False}


def test_window_cells_cover_a_window_once(spark):
    cells = [64, 16, 4]
    r = [(i, lo, lo + n) for i, (lo, n) in enumerate((lo, n) for lo in (0, 1, 5, 15, 63, 64, 70) for n in (0, 1, 3, 4, 17, 63, 64, 65, 200))]
    got = defaultdict(list)
    for x in rings.window_cells(spark.createDataFrame(r, "id long, lo_us long, hi_us long"), cells).collect():
        width = (cells + cells[-1:])[x.level]
        inside = [u for u in range(x.cell * width, (x.cell + 1) * width) if x.lo_us <= u <= x.hi_us]
        assert x.level == len(cells) or len(inside) == width
        got[x.id] += inside
    assert {i: sorted(v) for i, v in got.items()} == {i: list(range(lo, hi + 1)) for i, lo, hi in r}


def test_region_peers_are_the_first_ones_and_rows_stay_linear(spark):
    rng = random.Random(5)
    t = [(f"c{rng.randrange(80):02d}", rng.choice("XY"), rng.randrange(20 * DAY_US)) for _ in range(3000)]
    t += [("c00", "X", 7 * DAY_US), ("c01", "X", 7 * DAY_US + 1)]
    al = [(f"A{i}", f"c{i:02d}", rng.choice("XY"), (h := rng.randrange(DAY_US, 19 * DAY_US)) - rng.randrange(14 * DAY_US), h) for i in range(20)]
    al += [("E", "c05", "X", 7 * DAY_US, 7 * DAY_US), ("Z", "c05", "X", 7 * DAY_US, 7 * DAY_US + 1), ("N", "c05", None, 0, DAY_US)]
    flags = spark.createDataFrame(al, "alert_id string, card string, addr1 string, lo_us long, hi_us long")
    txn = spark.createDataFrame(t, "card string, addr1 string, ts_us long")
    want = set()
    for a, own, region, lo, hi in al:
        cards = sorted({c for c, r, u in t if r == region and lo <= u <= hi and c != own})
        want |= {(a, c) for c in cards[:6]} if len(cards) >= 2 else set()
    assert {tuple(r) for r in rings.region_peers(flags, txn, cap=6).collect()} == want
    # what an alert meets is bounded by its cells times the length of their lists
    assert rings.window_cells(flags.where("addr1 is not null")).groupBy("alert_id").count().agg(F.max("count")).first()[0] < 200


def test_search_from_many_seeds_equals_plain_search(spark):
    rng = random.Random(8)
    known = sorted({(f"k{rng.randrange(700)}", f"d{rng.randrange(600)}") for _ in range(900)} | {(f"k{i}", "hub") for i in range(50)})
    txn = [(f"k{rng.randrange(720)}", rng.randrange(100), round(rng.random() * 10, 2)) for _ in range(2500)]
    al = [(f"A{i}", f"k{rng.randrange(720)}", (lo := rng.randrange(100)), lo + 40) for i in range(690)]
    degree, on, of = defaultdict(int), defaultdict(set), defaultdict(set)
    for _, d in known:
        degree[d] += 1
    for c, d in known:
        if degree[d] <= 5:
            on[d].add(c)
            of[c].add(d)
    want = {}
    for a, seed, lo, hi in al:
        seen, front, devices, last = {seed}, {seed}, set(), 0
        for i in range(1, 4):
            hop = {d for c in front for d in of[c]} - devices
            devices |= hop
            front = {c for d in hop for c in on[d]} - seen
            if not front:
                break
            seen |= front
            last = i
        use = [m for c, t, m in txn if c in seen and lo <= t <= hi]
        want[a] = (len(seen), len(devices), min(last + 1, 3), len(use), round(sum(use), 2))
    got = components.ring_wcc(spark.createDataFrame(al, "alert_id string, card string, lo_us long, hi_us long"), spark.createDataFrame(known, "card string, device_profile string"),
                              spark.createDataFrame(txn, "card string, ts_us long, amt double"), cap=5, max_iter=3).collect()
    assert {r.alert_id: (r.size, r.n_devices, r.iterations, r.component_n_txns, round(r.component_exposure, 2)) for r in got} == want


def test_equal_vectors_give_k_candidates(spark):
    v = [1.0, 0.0, 2.0]
    q, c = (spark.range(n).select(F.col("id").alias(name), F.array(*map(F.lit, v)).alias("vec")) for name, n in (("qid", 40), ("cid", 500)))
    vec = np.repeat([v], 500, axis=0) / np.linalg.norm(v)
    part = retrieval._best(np.arange(40), vec[:40], np.arange(500)[::-1], vec, 7)
    assert len(part) == 40 * 7 and set(part.cid) == set(range(7))
    assert {(r.qid, r.cid) for r in retrieval.vector_topk(q, c, 7).collect()} == {(i, j) for i in range(40) for j in range(7)}


def test_approximate_search_follows_the_corpus(spark):
    assert [retrieval.bits_for(n) for n in (0, 10, 501, 50_000, 10**12)] == [1, 1, 1, 7, 30]
    v = np.random.default_rng(11).normal(size=(4000, 24))
    v[1::2] = v[::2] + 0.25 * np.random.default_rng(12).normal(size=(2000, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(4)
    q, c = df.where("id % 100 = 0").withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "cid")
    got = retrieval.recall(retrieval.vector_topk_lsh(q, c, 5, block=150), retrieval.vector_topk(q, c, 5)).first()
    assert got.n_queries == 40 and got.n_wanted == 200 and got.recall >= 0.9


AFFECTED = "alert_id string, flagged_txn_id long, card string, lo_us long, hi_us long"


def test_affected_ids_only_of_what_fires(spark):
    flags = spark.createDataFrame([("A", 1, "c", 0, 100), ("B", 9, "c", 0, 50), ("N", 5, None, 0, 100)], AFFECTED)
    fired = spark.createDataFrame([("A", "card_testing", True), ("A", "legit_trip", False), ("A", "out_of_region_use", True), ("B", "account_takeover", True), ("N", "card_testing", True)],
                                  "alert_id string, detector string, names_flagged boolean")
    txn = spark.createDataFrame([(1, "c", 100, "online", 3.0), (2, "c", 0, "online", 4.99), (3, "c", 10, "online", 50.0), (4, "c", 20, "online", 101.0), (6, "c", 30, "in_person", 1.0),
                                 (7, "c", 101, "online", 1.0), (8, "d", 30, "online", 1.0), (9, "c", 40, "online", 2.0)], "txn_id long, card string, ts_us long, channel string, amt double")
    got = detect.affected_ids(flags, txn, fired)
    assert {tuple(r) for r in got.collect()} == {("A", "card_testing", i) for i in (1, 2, 4, 9)} | {("A", "out_of_region_use", 1), ("B", "account_takeover", 9), ("N", "card_testing", 5)}
    out = {(r.alert_id, r.detector): (r.n_affected, r.affected_txn_ids) for r in detect.with_affected(fired, got).collect()}
    assert out[("A", "card_testing")] == (4, "1|2|4|9") and out[("A", "legit_trip")] == (0, "") and out[("B", "account_takeover")] == (1, "9")
    # a rule of one's own looks at the same windows
    mine = detect.affected_ids(flags, txn, fired, members={**detect.MEMBERS, "account_takeover": "channel = 'in_person'"})
    assert ("B", "account_takeover", 6) in {tuple(r) for r in mine.collect()}
    assert detect.affected_ids(flags, txn, fired.limit(0)).count() == 0


def test_compromised_credentials_open_the_block_of_all_cards(spark):
    base = dict(verdict="fraud", p=0.9, exposure=100.0, pattern="account_takeover", n_channels=2, shared_element=None, response=None, is_dispute=False, is_recurring=False, two_cards=False,
                undocumented_coordinated=False, testing_fires=False, over_100_cleared=False, trigger_type="risk_score", channel="in_person", id_15_new=False, evidence_requested=False)
    ddl = ("verdict string, p double, exposure double, pattern string, n_channels int, shared_element string, response string, is_dispute boolean, is_recurring boolean, two_cards boolean, "
           "undocumented_coordinated boolean, testing_fires boolean, over_100_cleared boolean, trigger_type string, channel string, id_15_new boolean, evidence_requested boolean, credentials_compromised boolean")
    cases = [(base, True), (base, False), (base, None), ({**base, "pattern": "none"}, True), ({**base, "verdict": "uncertain"}, True)]
    out = decide.decide(spark.createDataFrame([(*c.values(), k) for c, k in cases], ddl)).collect()
    assert ["BLOCK_ALL_CARDS" in [a.action for a in r.actions] for r in out] == [True, False, False, False, False]


def test_acceptance_counts_invented_citations(spark):
    ddl = ("case_id string, verdict string, report boolean, asked boolean, summary string, pattern_description string, narrative string, similar array<string>, "
           "initial array<struct<action:string,route:string,reason:string>>, final array<struct<action:string,route:string,reason:string>>")
    r = [("CASE-A-1", "fraud", False, False, "See CC-0001 and CASE-A-1.", "", "CC-0002 again, CC-0001", ["CC-0001"], [], []), ("CASE-A-2", "fraud", False, False, "CC-0009", None, None, None, [], [])]
    got = quality.acceptance(spark.createDataFrame(r, ddl)).first()
    assert (got.n, got.n_citing, got.n_citations) == (2, 2, 2)


def test_no_python_in_the_median(skewed_plan):
    for bad in ("FlatMapGroupsInPandas", "ArrowEvalPython", "MapInPandas", "CartesianProduct"):
        assert bad not in skewed_plan


@pytest.fixture
def skewed_plan(fx, conf):
    from fraudlake.operators.rolling import rolling_median
    with conf(**{"fraudlake.nativeMedianRows": 60, "fraudlake.maxRowsPerTask": 120}):
        hot = fx.txn.withColumn("card", F.when(F.col("txn_id") % 3 == 0, "HOT").otherwise(F.col("card")))
        return rolling_median(hot, "amt", 3600 * SEC_US, "m")._jdf.queryExecution().executedPlan().toString()


def test_region_peers_meet_only_cards_up_to_the_bound_of_their_days(spark):
    rng = random.Random(9)
    t = [(f"c{rng.randrange(400):03d}", rng.choice("XY"), rng.randrange(10 * DAY_US)) for _ in range(6000)]
    al = [(f"A{i}", f"c{rng.randrange(12):03d}", rng.choice("XY"), (h := rng.randrange(10 * DAY_US)) - 4 * DAY_US, h) for i in range(25)]
    al += [("S", "c001", "X", 5, DAY_US // 2), ("E", "c001", "Y", 30 * DAY_US, 34 * DAY_US)]      # no whole day; days without rows
    flags = spark.createDataFrame(al, "alert_id string, card string, addr1 string, lo_us long, hi_us long")
    txn = spark.createDataFrame(t, "card string, addr1 string, ts_us long")
    top, want = {}, set()
    for a, own, region, lo, hi in al:
        whole = sorted({c for c, r, u in t if r == region and -(-lo // DAY_US) * DAY_US <= u < (hi + 1) // DAY_US * DAY_US})
        top[a] = whole[6] if len(whole) >= 7 else None
        cards = sorted({c for c, r, u in t if r == region and lo <= u <= hi and c != own})
        want |= {(a, c) for c in cards[:6]} if len(cards) >= 2 else set()
    probes = flags.select("alert_id", "addr1", "lo_us", "hi_us")
    assert {r.alert_id: r.top for r in rings.day_bounds(probes, txn, 7).collect()} == top
    assert top["S"] is None and top["E"] is None and sum(v is not None for v in top.values()) > 15
    assert {tuple(r) for r in rings.region_peers(flags, txn, cap=6).collect()} == want


def test_recurring_amounts_of_some_rows_equal_those_of_all(spark):
    rng = random.Random(4)
    t = [(rng.choice(["a", "b", None]), rng.choice("PQ"), rng.choice([None, *[round(rng.random() * 20, 1) for _ in range(9)]]), i, rng.randrange(300)) for i in range(400)]
    txn = spark.createDataFrame(t + t[:60], "customer_id string, product_cd string, amt double, txn_id long, ts_us long")
    ids = spark.createDataFrame([(i,) for i in (*range(0, 400, 9), 9, 4000)], "txn_id long")
    every = {tuple(r) for r in neighbors.recurring_prior(txn, tol=2.5).collect()}
    want = {r for r in every if r[0] % 9 == 0}
    assert {tuple(r) for r in neighbors.recurring_prior(txn, tol=2.5, ids=ids).collect()} == want and len({r[1] for r in want}) > 3
