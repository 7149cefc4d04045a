"""Hand tables for keys, evidence, decisions, components, retrieval, evaluation and plan guards."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fraudlake.operators import components, decide, evaluate, evidence, keys, neighbors, quality, retrieval
from fraudlake.plans import ORACLES, QUERIES


def test_explode_ids_drops_blanks_repeats_and_text(spark):
    df = spark.createDataFrame([("a", "1| 2||x|2|"), ("b", ""), ("c", None), ("d", "7")], "case_id string, txn_ids string")
    assert rows(keys.explode_ids(df)) == [("a", 1), ("a", 2), ("d", 7)]


def test_calibrator_edges(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.3,), (0.5,), (0.9,)], "p double")
    xs, ys = [0.1, 0.4, 0.8], [0.0, 0.5, 1.0]
    step = [r[0] for r in df.select(evidence.calibrate(F.col("p"), xs, ys)).collect()]
    line = [round(r[0], 6) for r in df.select(evidence.calibrate(F.col("p"), xs, ys, "linear")).collect()]
    assert step == [0.0, 0.0, 0.0, 0.5, 1.0] and line == [0.0, 0.0, 0.333333, 0.625, 1.0]


@pytest.mark.parametrize("pairs,want", [([(0.5, 1), (0.5, 0), (0.5, 1)], 0.5), ([(0.9, 1), (0.1, 0)], 1.0), ([(0.9, 1)], None)])
def test_auc(spark, pairs, want):
    assert evaluate.auc(spark.createDataFrame(pairs, "p double, y int")).first().auc == want


BASE = dict(verdict="uncertain", p=0.5, exposure=100.0, pattern="none", n_channels=2, shared_element=None, response=None, is_dispute=False,
            is_recurring=False, two_cards=False, undocumented_coordinated=False, testing_fires=False, over_100_cleared=False, trigger_type="risk_score",
            channel="in_person", id_15_new=False, evidence_requested=False)
SCHEMA = ("verdict string, p double, exposure double, pattern string, n_channels int, shared_element string, response string, is_dispute boolean, "
          "is_recurring boolean, two_cards boolean, undocumented_coordinated boolean, testing_fires boolean, over_100_cleared boolean, trigger_type string, "
          "channel string, id_15_new boolean, evidence_requested boolean")
DECISIONS = [
    (dict(is_dispute=True, is_recurring=True, trigger_type="customer_report"), ["CREATE_CASE", "VERIFY_WITH_CUSTOMER", "WARN_CUSTOMER"]),
    (dict(verdict="legitimate", p=0.05), ["CLOSE_NO_FRAUD"]),
    (dict(response="denied", verdict="fraud", p=0.9, exposure=3000.0, pattern="account_takeover"), ["BLOCK_CARD", "CREATE_CASE", "FILE_REPORT"]),
    (dict(response="no_reply", exposure=600.0), ["MONITOR_CARD", "DECLINE_TRANSACTION", "ESCALATE_TO_ANALYST"]),
    (dict(channel="online", id_15_new=True), ["STEP_UP_AUTH", "CREATE_CASE"]),
    (dict(verdict="fraud", p=0.9, pattern="undocumented", shared_element="device"), ["BLOCK_CARD", "CREATE_CASE", "FILE_REPORT", "ESCALATE_TO_ANALYST", "MONITOR_CONNECTED_CARDS"]),
    (dict(testing_fires=True, n_channels=1), ["DECLINE_TRANSACTION", "STEP_UP_AUTH", "VERIFY_WITH_CUSTOMER"]),
    (dict(verdict="fraud", p=0.9, two_cards=True, pattern="out_of_region_use"), ["BLOCK_CARD", "CREATE_CASE", "BLOCK_ALL_CARDS"]),
]


def test_decision_table(spark):
    data = [tuple({**BASE, **c}.values()) for c, _ in DECISIONS]
    out = decide.decide(spark.createDataFrame(data, SCHEMA)).collect()
    assert [[a.action for a in r.actions] for r in out] == [w for _, w in DECISIONS]
    assert {a.action: a.route for a in out[2].actions} == {"BLOCK_CARD": "L2", "CREATE_CASE": "auto", "FILE_REPORT": "L2"}


def test_dedupe_keeps_joint_or_strongest(spark):
    ev = spark.createDataFrame([
        ("a", 1, "signal:id_15_new", "identity_flags", 0.2), ("a", 2, "lr_table:is_new_device_for_card", "device", -0.9),
        ("b", 1, "signal:id_15_new", "identity_flags", 0.2), ("b", 2, "conjunctive-lr:new_device + proxy", "device", 0.1),
        ("b", 3, "signal:prior_fraud_on_customer", "history", 1.0), ("c", 1, "signal:prior_fraud_on_customer", "history", 1.0),
        ("c", 2, "signal:prior_fraud_on_card_tuple", "history", 0.5)], "alert_id string, seq int, ref string, channel string, log_lr double")
    assert rows(evidence.dedupe_evidence(ev).select("alert_id", "seq")) == [("a", 2), ("b", 2), ("b", 3), ("c", 2)]


def test_wcc_equals_union_find(spark):
    rnd = random.Random(3)
    edges = {(f"c{rnd.randrange(60)}", f"d{rnd.randrange(60)}") for _ in range(55)} | {(f"x{i + j}", f"y{i}") for i in range(12) for j in (0, 1)}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for c, d in edges:
        a, b = find("c:" + c), find("d:" + d)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components.wcc(spark.createDataFrame(list(edges), "card string, device_profile string")).collect()}
    assert got == {n: find(n) for n in got} and len(got) == len({x for x in parent})


def test_ring_wcc_stops_at_hub(spark):
    known = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("b", "hub"), ("c", "hub"), ("e", "hub"), ("c", "d2")], "card string, device_profile string")
    flags = spark.createDataFrame([("A", "a", 0, 10), ("C", "c", 0, 10)], "alert_id string, card string, lo_us long, hi_us long")
    txn = spark.createDataFrame([("a", 5, 1.5), ("b", 10, 2.0), ("b", 11, 9.0)], "card string, ts_us long, amt double")
    out = {r.alert_id: r for r in components.ring_wcc(flags, known, txn, cap=2).collect()}
    assert (out["A"].size, out["A"].n_devices, out["A"].component_n_txns, out["A"].component_exposure) == (2, 1, 2, 3.5)
    assert (out["C"].size, out["C"].n_devices, out["C"].iterations) == (1, 1, 1)


def test_topk_equals_brute_force_and_lsh_recall(spark, monkeypatch):
    v = np.random.default_rng(1).normal(size=(300, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(3)
    q, c = df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "cid")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, int(j)) for i, row in enumerate(u @ u.T) for j in np.argsort(-row)[:5]}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 100)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 70)  # three query blocks meet five corpus blocks
    assert {(r.qid, r.cid) for r in retrieval.vector_topk(q, c, 5).collect()} == want
    # every query is dated by its number: only earlier rows and the undated ones (multiples of 50) count, to the last one
    when = q.select("qid", F.col("qid").alias("as_of"))
    dates = c.where("cid % 50 <> 0").select("cid", F.col("cid").alias("at"))
    ok = lambda i, j: j < i or j % 50 == 0
    early = {(i, int(j)) for i, row in enumerate(u @ u.T) for j in [x for x in np.argsort(-row) if ok(i, x)][:5]}
    assert {(r.qid, r.cid) for r in retrieval.topk_asof(q, c, when, dates, 5).collect()} == early
    near = {(r.qid, r.cid) for r in retrieval.vector_topk_lsh(q, c, 5, bits=3, tables=8, block=40).collect()}
    assert len(near & want) / len(want) > 0.8


def test_recurring_cadence(spark):
    day = 86_400_000_000
    t = [("k", "P", 10.0, "r", i * 10 * day) for i in range(3)] + [("k", "Q", 7.0, "r", 0)]
    txn = spark.createDataFrame(t, "card string, product_cd string, amt double, addr1 string, ts_us long")
    flags = spark.createDataFrame([("A", "k", "P", 10.0), ("B", "k", "Q", 7.0)], "alert_id string, card string, product_cd string, amt double")
    out = {r.alert_id: r for r in neighbors.recurring_match(flags, txn).collect()}
    assert round(out["A"].cadence_cv, 6) == 0 and out["A"].fires and out["A"].n == 3
    assert out["B"].cadence_cv == -1 and not out["B"].fires


def test_scrub_keeps_text_without_invented_ids(spark):
    df = spark.createDataFrame([("See CC-0001. Then CC-9999! End.", ["CC-0001"]), ("Fine.  Two  spaces.", [])], "text string, allowed array<string>")
    assert [r.clean for r in quality.scrub_citations(df).collect()] == ["See CC-0001. End.", "Fine.  Two  spaces."]


def test_registry_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 170


@pytest.mark.parametrize("name", ["w08_first_seen_flags", "g05_device_neighbors", "g07_region_cluster", "m02_signal_counts", "p01_decision_flags", "s03_near_threshold_sweep"])
def test_plan_guards(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan


def test_pit_uses_one_shuffle(spark, fx):
    from fraudlake.operators import pit
    plan = pit.pit_base(fx.txn)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_training_rows_have_all_graph_inputs(fx):
    """The four window inputs of the fit against plain counts, and a fit whose gradient vanishes."""
    from fraudlake.operators import model
    from fraudlake.plans.evidence_queries import D14, training

    feats = training(fx).toPandas().drop_duplicates("alert_id").set_index("alert_id")
    t = fx.txn.select("txn_id", "card", "addr1", "r_email", "channel", "amt", "ts_us").toPandas()
    by_id, want = t.set_index("txn_id"), {}
    for i in feats.index:
        r = by_id.loc[int(i)]
        w = t[(t.ts_us >= r.ts_us - D14) & (t.ts_us <= r.ts_us)]
        on = w[(w.card == r.card) & (w.channel == "online")]
        want[i] = (int(((t.card == r.card) & (t.addr1 == r.addr1)).any()), int(w[(w.r_email == r.r_email) & (w.card != r.card)].card.nunique() >= 2),
                   int((on.amt < 20).sum() >= 3 and (on.amt > 60).sum() >= 1), int(((on.amt < 60) & (on.amt >= 57)).sum() >= 2))
    four = ["had_prior_txn_in_region", "recipient_cluster_ge2", "testing_sequence_fires", "near_threshold_burst"]
    assert {i: tuple(int(v) for v in r) for i, r in zip(feats.index, feats[four].values)} == want
    assert feats.had_prior_txn_in_region.sum() > 0
    data = training(fx).toPandas()
    coef = model.coefficients(model.fit_alert_model(training(fx)))
    x, y = data[list(model.FEATURES)].to_numpy(float), data.y.to_numpy(float)
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    b = np.array([coef[n] for n in model.FEATURES])
    p = 1 / (1 + np.exp(-(x @ b + coef["__intercept_raw__"])))
    assert np.abs((weight * (p - y)) @ x / len(y) + b / len(y)).max() < 1e-3
