"""Evidence statistics, alert model, ledger and detectors."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, HOUR_US
from fraudlake.operators import detect, evidence, model, neighbors
from fraudlake.plans.base_queries import BASE_SQL
from fraudlake.plans.graph_queries import (DN_SQL, NP_SQL, OF_SQL, PF_SQL, REC_SQL, RH_SQL, TIERS, cc_dev, cluster_sql, home,
                                           ring_ctes, ring_table, tier_table)
from fraudlake.plans.pit_queries import FEATS
from fraudlake.plans.registry import query
from fraudlake.session import cut_all

H48, D14 = 48 * HOUR_US, 14 * DAY_US
# The test tables have no product R: its two scopes read purchases instead.
REG = evidence.SignalRegistry()
REG.register_scope("online_R", "channel = 'online' AND product_cd = 'purchase'")
REG.register_scope("product_R", "product_cd = 'purchase'")
LAB_SQL = """SELECT t.*, CASE WHEN f.txn_id IS NOT NULL THEN 1 ELSE 0 END AS y, c.txn_id IS NOT NULL AS is_cleared
FROM feat t LEFT JOIN fraud_ids f USING (txn_id) LEFT JOIN cleared_ids c ON c.txn_id = t.txn_id"""
LV = ("txn", "cj", "fraud_ids", "cleared_ids")
LAB = {**FEATS, "lab": LAB_SQL}


def labelled(f):
    return f.stored("labelled", lambda: evidence.labels(f.features, f.fraud_ids, f.cleared_ids))


def counts_sql(specs: dict[str, tuple[str, str]], scopes: dict[str, str], table: str = "lab") -> str:
    """One count query for each signal, joined by UNION ALL."""
    out = []
    for name, (pred, scope) in specs.items():
        s, h = f"coalesce({scopes[scope]}, FALSE)", f"coalesce({scopes[scope]}, FALSE) AND coalesce(({pred}), FALSE)"
        cells = [f"count(*) FILTER (WHERE {c} AND {k}) AS {a}" for c, names in ((h, ("a_pos", "b_neg", "c_cleared")), (s, ("n_pos", "n_neg", "n_cleared")))
                 for k, a in zip(("y = 1", "y = 0", "is_cleared"), names)]
        out.append(f"SELECT '{name}' AS signal, '{scope}' AS scope, {', '.join(cells)} FROM {table}")
    return " UNION ALL ".join(out)


def lr_sql(inner: str) -> str:
    p = lambda a, n: f"(({a} + 1.0::DOUBLE) / ({n} + 2.0))"
    lr, lc = f"{p('a_pos', 'n_pos')} / {p('b_neg', 'n_neg')}", f"{p('a_pos', 'n_pos')} / {p('c_cleared', 'n_cleared')}"
    return f"""SELECT *, round({p('a_pos', 'n_pos')}, 6) AS p_pos, round({p('b_neg', 'n_neg')}, 6) AS p_neg, round({p('c_cleared', 'n_cleared')}, 6) AS p_cleared,
  round({lr}, 4) AS lr, round(ln({lr}), 4) AS log_lr, round({lc}, 4) AS lr_vs_cleared, round(ln({lc}), 4) AS log_lr_vs_cleared FROM ({inner})"""


COUNTS = counts_sql(REG.signals, REG.scopes)


@query("m01_labels", "SELECT txn_id, y, is_cleared FROM lab", LV, LAB)
def _(f):
    return evidence.labels(f.txn, f.fraud_ids, f.cleared_ids).select("txn_id", "y", "is_cleared")


@query("m02_signal_counts", COUNTS, LV, LAB)
def _(f):
    return evidence.signal_counts(labelled(f), REG)


@query("m03_likelihood_ratios", lr_sql(COUNTS), LV, LAB)
def _(f):
    return evidence.likelihood_ratios(evidence.signal_counts(labelled(f), REG))


JOINT = {
    "card_testing": ("burst_bucket IN ('2-4', '5+') AND amt < 20", "channel = 'online'"),
    "cnp_burst": ("unseen_product AND burst_bucket IN ('2-4', '5+') AND abs(amt_z) > 1", "channel = 'online'"),
    "new_device": ("is_new_device OR id_15 = 'New'", "channel = 'online'"),
    "new_device_proxy": ("(is_new_device OR id_15 = 'New') AND proxy_flag", "channel = 'online'"),
    "account_takeover": ("mixed_24h OR (id_15 = 'New' AND proxy_flag)", "true"),
}


def joint_sql(tests, table="lab"):
    scopes = {f"_{i}": s for i, (_, s) in enumerate(tests.values())}
    return lr_sql(counts_sql({n: (p, f"_{i}") for i, (n, (p, _)) in enumerate(tests.items())}, scopes, table))


@query("m04_joint_lr", joint_sql(JOINT), LV, LAB)
def _(f):
    return evidence.joint_lr(labelled(f), JOINT)


@query("m05_decile_lr", """
SELECT risk_decile, a_pos, n_pos, c_cleared, n_cleared, round(r, 4) AS lr, round(ln(r), 4) AS log_lr, greatest(-0.7, least(0.7, round(ln(r), 4)))::DOUBLE AS log_lr_used FROM (
  SELECT *, ((a_pos + 1.0::DOUBLE) / (n_pos + 2)) / ((c_cleared + 1.0::DOUBLE) / (n_cleared + 2)) AS r FROM (
    SELECT risk_decile, count(*) FILTER (WHERE y = 1) AS a_pos, count(*) FILTER (WHERE is_cleared) AS c_cleared FROM lab GROUP BY 1),
    (SELECT count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE is_cleared) AS n_cleared FROM lab))
""", LV, LAB)
def _(f):
    return evidence.decile_lr(labelled(f))


# every online transaction as its own alert
ALL_FLAGS = """SELECT CAST(txn_id AS VARCHAR) AS alert_id, txn_id AS flagged_txn_id, customer_id, card, ts_us AS opened_us, device_profile, id_23 FROM txn WHERE channel = 'online'"""
T6 = {"flag": ALL_FLAGS, "pf": PF_SQL, "np": NP_SQL, "off": OF_SQL, "tiers": TIERS["tiers"],
      "lab": """SELECT t.*, CASE WHEN f.txn_id IS NOT NULL THEN 1 ELSE 0 END AS y, c.txn_id IS NOT NULL AS is_cleared FROM tiers t
  LEFT JOIN fraud_ids f ON CAST(f.txn_id AS VARCHAR) = t.alert_id LEFT JOIN cleared_ids c ON CAST(c.txn_id AS VARCHAR) = t.alert_id"""}
TIER_TESTS = {**{t: (p + " AND bucket IS NOT NULL", "bucket IS NOT NULL") for t, p in evidence.TIER_TESTS.items()},
              **{f"{t}_{b}": (f"{p} AND bucket = '{b}'", f"bucket = '{b}'") for b in evidence.BUCKETS for t, p in evidence.TIER_TESTS.items()}}


@query("m06_tier_lr", joint_sql(TIER_TESTS), ("txn", "cj", "deg", "fraud_ids", "cleared_ids"), T6)
def _(f):
    rows = f.txn.where("channel = 'online'").select(F.col("txn_id").cast("string").alias("alert_id"), "txn_id", "customer_id", "card",
                                                    F.col("ts_us").alias("opened_us"), "device_profile", "id_23")
    tiers = neighbors.all_device_tiers(rows, f.txn, f.cj, f.known)
    return evidence.tier_lr(evidence.labels(tiers.withColumn("txn_id", F.col("alert_id").cast("long")), f.fraud_ids, f.cleared_ids))


REC10 = """SELECT t.txn_id, count(p.txn_id) >= 3 AS recurring_ge3 FROM txn t LEFT JOIN txn p ON p.customer_id = t.customer_id AND p.product_cd = t.product_cd
AND abs(p.amt - t.amt) < 2.5 AND p.ts_us < t.ts_us GROUP BY 1"""


def recurring(f):
    return f.stored("recurring", lambda: neighbors.recurring_prior(f.txn, tol=2.5))


def recurring_of(f, ids):
    return neighbors.recurring_prior(f.txn, tol=2.5, ids=ids).select("txn_id", "recurring_ge3")


@query("m07_recurring_lr", joint_sql({"recurring_ge3": ("recurring_ge3", "true")}, "rl"), LV,
       {**LAB, "r10": REC10, "rl": "SELECT l.*, r.recurring_ge3 FROM lab l JOIN r10 r USING (txn_id)"})
def _(f):
    return evidence.recurring_lr(labelled(f).join(recurring(f).select("txn_id", "recurring_ge3"), "txn_id"))


# fixed weights for the score query, so that both engines add the same numbers
WEIGHTS = {n: round(0.125 * ((i * 5) % 13 - 6), 3) for i, n in enumerate(REG.signals)}


@query("m08_lr_score", "SELECT txn_id, round(-1.5 + " + " + ".join(
    f"CASE WHEN coalesce({REG.scopes[REG.signals[n][1]]}, FALSE) AND coalesce(({REG.signals[n][0]}), FALSE) THEN {w} ELSE 0 END" for n, w in WEIGHTS.items())
    + ", 6)::DOUBLE AS log_odds FROM feat", ("txn", "cj"), FEATS)
def _(f):
    return evidence.lr_score(f.features, WEIGHTS, REG, -1.5).withColumn("log_odds", F.round("log_odds", 6))


@query("m09_balanced_weights", "SELECT case_id, y, round((SELECT count(*) FROM prediction) / (2.0 * c), 6)::DOUBLE AS weight FROM prediction JOIN (SELECT y, count(*) AS c FROM prediction GROUP BY 1) USING (y)", ("prediction",))
def _(f):
    return model.balanced_weights(f.predictions).select("case_id", "y", F.round("weight", 6).alias("weight"))


RANKED = "row_number() OVER (PARTITION BY y ORDER BY md5(CAST({key} AS VARCHAR) || '|42'), {key}) - 1 AS r, count(*) OVER (PARTITION BY y) AS c"


@query("m10_fold_of_rows", f"SELECT txn_id, y, CAST(r % 5 AS INT) AS fold FROM (SELECT txn_id, y, {RANKED.format(key='txn_id')} FROM lab)", ("txn", "cj", "fraud_ids", "cleared_ids"), LAB)
def _(f):
    return model.stratified_folds(labelled(f), "txn_id", "y").select("txn_id", "y", "fold")


@query("m10_stratified_folds", f"SELECT CAST(r % 5 AS INT) AS fold, y, count(*) AS n FROM (SELECT y, {RANKED.format(key='txn_id')} FROM lab) GROUP BY 1, 2", ("txn", "cj", "fraud_ids", "cleared_ids"), LAB)
def _(f):
    return model.fold_sizes(model.stratified_folds(labelled(f), "txn_id", "y"))


@query("m10_stratified_split", f"SELECT y, r < floor(0.2::DOUBLE * c + 0.5) AS is_test, count(*) AS n FROM (SELECT y, {RANKED.format(key='case_id')} FROM prediction) GROUP BY 1, 2", ("prediction",))
def _(f):
    return model.stratified_split(f.predictions, "case_id", "y").groupBy("y", "is_test").agg(F.count("*").alias("n"))


# the largest mean over all earlier starts of the smallest mean over all later ends is the monotone fit
ISO = {
    "pool": """SELECT p AS x, row_number() OVER (ORDER BY p) AS i, sum(y * w) AS wy, sum(w) AS w FROM (SELECT *, (SELECT count(*) FROM prediction) / (2.0 * count(*) OVER (PARTITION BY y)) AS w FROM prediction) GROUP BY 1""",
    "run": "SELECT i, x, sum(wy) OVER (ORDER BY i) AS cy, sum(w) OVER (ORDER BY i) AS cw, wy, w FROM pool",
    "mean": "SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.wy) / (b.cw - a.cw + a.w) AS m FROM run a JOIN run b ON a.i <= b.i",
    "low": "SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM mean",
    "fit": "SELECT b AS i, max(m) AS y FROM low GROUP BY 1",
    "knot": """SELECT r.x, round(greatest(0, least(1, y)), 6)::DOUBLE AS y FROM (SELECT *, lag(y) OVER (ORDER BY i) AS py, lead(y) OVER (ORDER BY i) AS ny FROM fit) f JOIN run r USING (i)
      WHERE py IS NULL OR ny IS NULL OR abs(y - py) > 1e-9 OR abs(ny - y) > 1e-9""",
}


@query("m11_isotonic", "SELECT * FROM knot", ("prediction",), ISO)
def _(f):
    return model.fit_isotonic(model.balanced_weights(f.predictions)).withColumn("y", F.round("y", 6))


# the fit itself has no SQL form; what must hold for any right fit has
@query("m14_fit_properties", f"SELECT {len(model.FEATURES) + 2}::BIGINT AS n_rows, TRUE AS flat, TRUE AS shifted")
def _(f):
    return model.fit_properties(training(f), model.fit_alert_model(training(f)))


@query("m15_cross_validation_properties", "SELECT 5::BIGINT AS n_folds, TRUE AS in_range, TRUE AS better_than_none")
def _(f):
    return model.cv_properties(model.cv_eval(training(f), k=5))


XS, YS = [0.1, 0.25, 0.4, 0.65, 0.8], [0.05, 0.2, 0.45, 0.7, 0.95]
STEP_SQL = "CASE WHEN {p} <= 0.1 THEN 0.05 WHEN {p} >= 0.8 THEN 0.95 WHEN {p} >= 0.65 THEN 0.7 WHEN {p} >= 0.4 THEN 0.45 WHEN {p} >= 0.25 THEN 0.2 ELSE 0.05 END"
LINE_SQL = """CASE WHEN {p} <= 0.1 THEN 0.05 WHEN {p} >= 0.8 THEN 0.95 WHEN {p} < 0.25 THEN 0.05 + 0.15 * ({p} - 0.1) / 0.15 WHEN {p} < 0.4 THEN 0.2 + 0.25 * ({p} - 0.25) / 0.15
WHEN {p} < 0.65 THEN 0.45 + 0.25 * ({p} - 0.4) / 0.25 ELSE 0.7 + 0.25 * ({p} - 0.65) / 0.15 END"""


@query("m12_calibrate", f"SELECT case_id, CAST({STEP_SQL.format(p='p')} AS DOUBLE) AS step, round({LINE_SQL.format(p='p')}, 6)::DOUBLE AS line FROM prediction", ("prediction",))
def _(f):
    p = F.col("p")
    return f.predictions.select("case_id", evidence.calibrate(p, XS, YS).alias("step"), F.round(evidence.calibrate(p, XS, YS, "linear"), 6).alias("line"))


# ---- the signal row of every alert ----------------------------------------------

TEST_SQL = """SELECT alert_id, n_small >= 3 AND n_large >= 1 AS testing_fires FROM (SELECT f.alert_id, count(*) FILTER (WHERE t.channel = 'online' AND t.amt < 20) AS n_small,
 count(*) FILTER (WHERE t.channel = 'online' AND t.amt > 60) AS n_large FROM flag f LEFT JOIN txn t ON t.card = f.card AND t.ts_us BETWEEN f.lo_us AND f.hi_us GROUP BY 1)"""
BURST_SQL = f"SELECT f.alert_id, count(t.txn_id) AS n_online FROM flag f LEFT JOIN txn t ON t.card = f.card AND t.channel = 'online' AND t.ts_us BETWEEN f.opened_us - {H48} AND f.opened_us GROUP BY 1"
NEARTH_SQL = """SELECT f.alert_id, count(t.txn_id) >= 2 AS near_threshold_fires FROM flag f LEFT JOIN txn t ON t.card = f.card AND t.channel = 'online' AND t.amt < 60 AND t.amt >= 57
 AND t.ts_us BETWEEN f.lo_us AND f.hi_us GROUP BY 1"""
NEARBY_SQL = f"""SELECT f.alert_id, count(*) FILTER (WHERE t.channel = 'online') AS near_online, count(*) FILTER (WHERE t.channel = 'in_person') AS near_in_person,
 count(*) FILTER (WHERE t.channel = 'online' AND t.id_15 = 'New') AS near_new, count(*) FILTER (WHERE t.channel = 'online' AND t.id_23 LIKE 'IP_PROXY:%') AS near_proxied, count(*) FILTER (WHERE t.channel = 'online' AND ('false' IN (lower(t."M1"), lower(t."M9")))) AS near_bad_match
 FROM flag f LEFT JOIN txn t ON t.customer_id = f.customer_id AND t.ts_us BETWEEN f.ts_us - {H48} AND f.ts_us + {H48} GROUP BY 1"""
BIG_SQL = "SELECT f.alert_id, EXISTS (SELECT 1 FROM txn t WHERE t.customer_id = f.customer_id AND t.ts_us < f.ts_us AND t.amt >= f.amt * 0.5) AND f.amt > 60 AS has_prior_big FROM flag f"
SIG_SQL = """
SELECT f.*, t.is_new_device, t.unseen_product, t.unseen_email, t.out_of_home, t.amt_z, t.mixed_24h, t.burst_bucket, t.proxy_flag, t.risk_decile,
  t.prior_fraud_card, t.prior_fraud_customer, t.prior_cleared_travel, t.prior_cleared_phone, t.home_addr1 AS home_asof,
  te.testing_fires, b.n_online, nt.near_threshold_fires, rm.n AS n_recurring, rm.fires AS recurring_fires, rh.had_prior_txn_in_region, rh.n_home_in_window,
  ti.degree, ti.bucket, ti.tier, ti.is_hub, ti.n_prior_fraud, ti.n_other_new_or_proxied, ti.n_other_fraud, rc.n_other_cards AS n_region_others, re.n_other_cards AS n_recipient_others,
  dn.n_other_cards AS n_device_others, s.n AS n_ring_cards, nb.near_online, nb.near_in_person, nb.near_new, nb.near_proxied, nb.near_bad_match, bg.has_prior_big, r10.recurring_ge3,
  0.1 * t.risk_decile - 0.55 AS decile_log_lr
FROM flag f JOIN feat t ON t.txn_id = f.flagged_txn_id JOIN test te USING (alert_id) JOIN burst b USING (alert_id) JOIN nearth nt USING (alert_id) LEFT JOIN rec rm USING (alert_id)
JOIN rhist rh USING (alert_id) JOIN tiers ti USING (alert_id) LEFT JOIN reg rc USING (alert_id) LEFT JOIN recip re USING (alert_id) LEFT JOIN devn dn USING (alert_id)
JOIN (SELECT alert_id, count(*) AS n FROM ring_cards GROUP BY 1) s USING (alert_id) JOIN nearby nb USING (alert_id) JOIN big bg USING (alert_id) JOIN r10 ON r10.txn_id = f.flagged_txn_id
"""
SV = ("txn", "flag", "deg", "known", "closed_case", "cj")
SIG = {**FEATS, "test": TEST_SQL, "burst": BURST_SQL, "nearth": NEARTH_SQL, "rec": REC_SQL, "rowset": "SELECT * FROM txn", "base": BASE_SQL, "rhist": RH_SQL, **TIERS,
       "reg": cluster_sql("addr1"), "recip": cluster_sql("r_email"), **ring_ctes(100), "devn": DN_SQL, "nearby": NEARBY_SQL, "big": BIG_SQL, "r10": REC10, "sig": SIG_SQL}


def signals(f):
    return f.stored("signals", lambda: _signals(f))


def _signals(f):
    fl, t = f.flags, f.txn
    # stored tables that several questions read come first; the questions themselves do not depend on each other
    home_, dev, known, feats = home(f), cc_dev(f), f.known, f.features
    parts = cut_all(
        lambda: ring_table(f).select("alert_id", F.col("n_cards").alias("n_ring_cards")),
        lambda: neighbors.card_signals(fl, t, 20.0, 60.0, threshold=60.0, near=2).select("alert_id", "testing_fires", "n_online", "near_threshold_fires"),
        lambda: neighbors.recurring_match(fl, t, tol=2.5).select("alert_id", F.col("n").alias("n_recurring"), F.col("fires").alias("recurring_fires")),
        lambda: neighbors.region_history(fl, t, home_).select("alert_id", "had_prior_txn_in_region", "n_home_in_window"),
        lambda: tier_table(f).drop("proxy_flag"),
        lambda: neighbors.region_cluster(fl, t).select("alert_id", F.col("n_other_cards").alias("n_region_others")),
        lambda: neighbors.recipient_cluster(fl, t).select("alert_id", F.col("n_other_cards").alias("n_recipient_others")),
        lambda: neighbors.device_neighbors(fl, t, dev, known=known).select("alert_id", F.col("n_other_cards").alias("n_device_others")),
        lambda: detect.nearby_activity(fl, t), lambda: detect.prior_big_purchases(fl, t, floor=60.0),
        lambda: recurring_of(f, fl.select(F.col("flagged_txn_id").alias("txn_id"))).withColumnRenamed("txn_id", "flagged_txn_id"))
    rec = parts.pop()
    feats = feats.withColumnRenamed("home_addr1", "home_asof")
    out = detect.alert_signals(fl, feats, parts).join(rec, "flagged_txn_id", "left")
    return out.withColumn("decile_log_lr", 0.1 * F.col("risk_decile") - 0.55)


M13_SQL = "SELECT alert_id, " + ", ".join(f'CAST(coalesce(({sql}), FALSE) AS INT) AS "{n}"' for n, sql in model.FEATURES.items()) + " FROM sig"


@query("m13_alert_features", M13_SQL, SV, SIG)
def _(f):
    return model.alert_features(signals(f))


def training(f):
    """Features of the flagged transaction of every closed case, with its outcome.

    The case's transaction is treated as an alert opened at its own time, so graph features take part.
    """
    return f.stored("training", lambda: _training(f))


def _training(f):
    first = f.cases.select("case_id", F.col("first_fraud_txn_id").alias("txn_id"), (F.col("outcome") == "confirmed_fraud").cast("int").alias("y"))
    ids = first.select("txn_id")
    rows = f.features.join(ids, "txn_id", "left_semi").withColumn("alert_id", F.col("txn_id").cast("string")).withColumn("opened_us", F.col("ts_us"))
    rows = rows.withColumn("lo_us", F.col("ts_us") - D14).withColumn("hi_us", F.col("ts_us"))
    tiers = neighbors.all_device_tiers(rows, f.txn, f.cj, f.known)
    sig = rows.join(tiers.drop("proxy_flag"), "alert_id", "left")
    sig = sig.join(neighbors.region_cluster(rows, f.txn).select("alert_id", F.col("n_other_cards").alias("n_region_others")), "alert_id", "left")
    sig = sig.join(neighbors.device_neighbors(rows, f.txn, cc_dev(f), known=f.known).select("alert_id", F.col("n_other_cards").alias("n_device_others")), "alert_id", "left")
    sig = sig.join(recurring_of(f, ids), "txn_id", "left")
    for part in (
        neighbors.region_history(rows, f.txn, home(f)).select("alert_id", "had_prior_txn_in_region"),
        neighbors.card_signals(rows, f.txn, 20.0, 60.0, threshold=60.0, near=2).select("alert_id", "testing_fires", "near_threshold_fires"),
        neighbors.recipient_cluster(rows, f.txn).select("alert_id", F.col("n_other_cards").alias("n_recipient_others")),
    ):
        sig = sig.join(part, "alert_id", "left")
    return model.alert_features(sig).join(first.select(F.col("txn_id").cast("string").alias("alert_id"), "y"), "alert_id")


@query("m14_fit_alert_model")
def _(f):
    return model.fit_alert_model(training(f))


@query("m15_cross_validation")
def _(f):
    return model.cv_eval(training(f), k=5)


COEF = {n: round(0.0625 * ((i * 7) % 17 - 8), 4) for i, n in enumerate(model.FEATURES)} | {"__intercept__": -0.25}
LOGIT = "-0.25 + " + " + ".join(f'"{n}" * {COEF[n]}' for n in model.FEATURES)
M16 = {**SIG, "ft": M13_SQL, "sc": f"SELECT *, CAST({LOGIT} AS DOUBLE) AS logit FROM ft"}


def half_up(x: float) -> str:
    return f"{Decimal(str(x)).quantize(Decimal('0.01'), ROUND_HALF_UP):+}"


def scored(f):
    return model.score_alerts(model.alert_features(signals(f)), COEF)


@query("m16_score_alerts", "SELECT alert_id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS p, CAST(" + " + ".join(f'"{n}"' for n in model.FEATURES) + " AS INT) AS n_fired FROM sc", SV, M16)
def _(f):
    return scored(f).select("alert_id", F.round("logit", 6).alias("logit"), F.round("p", 6).alias("p"), F.size("fired").alias("n_fired"))


@query("m21_model_evidence", " UNION ALL ".join(
    f"SELECT alert_id, 'alert_model:{n}' AS ref, '{model.CHANNEL.get(n, 'history')}' AS channel, CAST({COEF[n]} AS DOUBLE) AS log_lr, {str(abs(COEF[n]) >= 0.5).upper()} AS published, "
    f"'{half_up(COEF[n])}' AS weight_text FROM sc WHERE \"{n}\" = 1" for n in model.FEATURES if abs(COEF[n]) >= 0.05), SV, M16)
def _(f):
    ev = model.model_evidence(scored(f))
    return ev.select("alert_id", "ref", "channel", "log_lr", "published", F.regexp_extract("claim", r"weight ([+-][0-9.]+)\)", 1).alias("weight_text"))


# ---- ledger -----------------------------------------------------------------------

LED_SRC = """
SELECT alert_id, 1 AS seq, 'signal:prior_fraud_on_card_tuple' AS ref, 'history' AS channel, 0.375::DOUBLE AS log_lr FROM flag WHERE flagged_txn_id % 3 = 0
UNION ALL SELECT alert_id, 2, 'signal:prior_fraud_on_customer', 'history', 0.25 FROM flag WHERE flagged_txn_id % 2 = 0
UNION ALL SELECT alert_id, 3, 'signal:id_15_new', 'identity_flags', 0.5 FROM flag WHERE flagged_txn_id % 5 < 3
UNION ALL SELECT alert_id, 4, 'lr_table:is_new_device_for_card', 'device', -0.75 FROM flag WHERE flagged_txn_id % 7 < 4
UNION ALL SELECT alert_id, 5, 'conjunctive-lr:new_device + proxy', 'device', 1.25 FROM flag WHERE flagged_txn_id % 11 < 3
UNION ALL SELECT alert_id, 6, 'signal:amt_gt_1000', 'amount', amt / 100.0 - 0.5 FROM flag
UNION ALL SELECT alert_id, 7, 'query:burst', 'sequence', 0.0 FROM flag
UNION ALL SELECT alert_id, 8, 'alert_model:__intercept__', 'history', -0.125 FROM flag WHERE flagged_txn_id % 13 < 4
"""


def ledger(f):
    return f._sql(LED_SRC.replace("0.375::DOUBLE", "CAST(0.375 AS DOUBLE)"), flag=f.flags)


DED_SQL = """
SELECT alert_id, seq, ref, channel, log_lr FROM (
  SELECT l.*, bool_or(ref LIKE '%signal:prior_fraud_on_card_tuple%') OVER (PARTITION BY alert_id) AS has_card, bool_or(ref LIKE '%conjunctive-lr:new_device%') OVER (PARTITION BY alert_id) AS has_joint,
    ref IN ('signal:id_15_new', 'lr_table:is_new_device_for_card') AS single,
    row_number() OVER (PARTITION BY alert_id, ref IN ('signal:id_15_new', 'lr_table:is_new_device_for_card') ORDER BY abs(log_lr) DESC, seq) AS rk FROM led l)
WHERE NOT (has_card AND ref LIKE '%prior_fraud_on_customer%') AND NOT (single AND (has_joint OR rk > 1))
"""
F1 = ("flag",)
POST_SQL = f"""
SELECT alert_id, delta, log_odds, capped, p_raw, greatest(0.02, least(0.98, CASE WHEN m THEN p_raw ELSE {STEP_SQL.format(p='p_raw')} END))::DOUBLE AS p FROM (
  SELECT *, 1 / (1 + exp(-log_odds)) AS p_raw FROM (SELECT alert_id, delta, greatest(-4.0, least(4.0, delta)) AS log_odds, delta NOT BETWEEN -4 AND 4 AS capped, m
    FROM (SELECT alert_id, CAST(sum(CAST(log_lr AS DECIMAL(28,12))) AS DOUBLE) AS delta, bool_or(ref LIKE 'alert_model:%') AS m FROM {{src}} GROUP BY 1)))
"""
LED = {"led": LED_SRC, "ded": DED_SQL, "post": POST_SQL.format(src="ded")}


@query("m18_dedupe_evidence", "SELECT * FROM ded", F1, LED)
def _(f):
    return evidence.dedupe_evidence(ledger(f))


@query("m17_posterior", "SELECT alert_id, round(delta, 6) AS delta, round(log_odds, 6) AS log_odds, capped, round(p_raw, 6) AS p_raw, round(p, 6) AS p FROM post", F1, LED)
def _(f):
    r = lambda c: F.round(c, 6).alias(c)
    return evidence.posterior(evidence.dedupe_evidence(ledger(f)), XS, YS).select("alert_id", r("delta"), r("log_odds"), "capped", r("p_raw"), r("p"))


CH_SQL = "SELECT alert_id, count(DISTINCT CASE WHEN abs(log_lr) > 1e-9 THEN channel END) AS n_channels FROM ded GROUP BY 1"


@query("m19_channel_count", CH_SQL, F1, LED)
def _(f):
    return evidence.channel_count(evidence.dedupe_evidence(ledger(f)))


RESP = "CASE flagged_txn_id % 6 WHEN 0 THEN 'denied' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'no_reply' END"
VER_SQL = f"""SELECT alert_id, CASE r WHEN 'denied' THEN 'fraud' WHEN 'confirmed' THEN 'legitimate' WHEN 'no_reply' THEN 'uncertain' ELSE
 CASE WHEN p >= 0.85 AND n_channels >= 2 THEN 'fraud' WHEN p <= 0.15 AND n_channels >= 2 THEN 'legitimate' ELSE 'uncertain' END END AS verdict
 FROM post JOIN ch USING (alert_id) JOIN (SELECT alert_id, {RESP} AS r FROM flag) USING (alert_id)"""


def verdict_rows(f):
    ev = evidence.dedupe_evidence(ledger(f))
    j = (evidence.posterior(ev, XS, YS).join(evidence.channel_count(ev), "alert_id")
         .join(f.flags.select("alert_id", F.expr(RESP).alias("response")), "alert_id"))
    return j.withColumn("verdict", evidence.verdict(F.col("p"), F.col("n_channels"), F.col("response")))


@query("m20_verdict", "SELECT * FROM ver", F1, {**LED, "ch": CH_SQL, "ver": VER_SQL})
def _(f):
    return verdict_rows(f).select("alert_id", "verdict")


@query("m24_needs_response", "SELECT alert_id FROM ver WHERE verdict = 'uncertain'", F1, {**LED, "ch": CH_SQL, "ver": VER_SQL})
def _(f):
    return evidence.needs_response(verdict_rows(f)).select("alert_id")


SCN = f"""
SELECT alert_id, p, response, new_log_odds, new_p, w / sum(w) OVER (PARTITION BY alert_id) AS weight FROM (
  SELECT *, {STEP_SQL.format(p='raw')}::DOUBLE AS new_p, lr * p + (1 - p) AS w FROM (
    SELECT a.alert_id, a.p, v.response, v.lr, a.log_odds + ln(v.lr) AS new_log_odds, 1 / (1 + exp(-(a.log_odds + ln(v.lr)))) AS raw
    FROM post a, (VALUES ('denied', 9.0::DOUBLE), ('confirmed', 0.1), ('no_reply', 1.2)) v(response, lr)))
"""


@query("m22_response_scenarios", """
SELECT s.alert_id, response, round(new_log_odds, 6) AS new_log_odds, round(new_p, 6) AS new_p, round(weight, 6) AS weight, round(ep, 6) AS expected_p, round(es, 6) AS expected_shift,
  ((s.p >= 0.3 AND s.p < 0.85) OR (f.amt > 500 AND s.p < 0.85)) AND es > 0.05 AS should_ask
FROM scn s JOIN flag f USING (alert_id) JOIN (SELECT alert_id, sum(weight * new_p) AS ep, sum(weight * abs(new_p - p)) AS es FROM scn GROUP BY 1) USING (alert_id)
""", F1, {**LED, "scn": SCN})
def _(f):
    a = evidence.posterior(evidence.dedupe_evidence(ledger(f)), XS, YS).join(f.flags.select("alert_id", F.col("amt").alias("exposure")), "alert_id")
    r = lambda c: F.round(c, 6).alias(c)
    return evidence.response_scenarios(a, XS, YS).select("alert_id", "response", r("new_log_odds"), r("new_p"), r("weight"), r("expected_p"), r("expected_shift"), "should_ask")


@query("m23_apply_response", """
SELECT alert_id, response, round(b.p, 6) AS p_before, round(CASE response WHEN 'denied' THEN greatest(a.p, 0.85) WHEN 'confirmed' THEN least(a.p, 0.15) ELSE a.p END, 6)::DOUBLE AS p
FROM post2 a JOIN post b USING (alert_id) JOIN rs USING (alert_id)
""", F1, {**LED, "rs": f"SELECT alert_id, {RESP} AS response FROM flag",
          "led2": "SELECT alert_id, ref, log_lr FROM ded UNION ALL SELECT alert_id, 'customer', CASE response WHEN 'denied' THEN ln(9.0) WHEN 'confirmed' THEN ln(0.1) ELSE ln(1.2) END FROM rs WHERE response IS NOT NULL",
          "post2": POST_SQL.format(src="led2")})
def _(f):
    rs = f.flags.select("alert_id", F.expr(RESP).alias("response"))
    r = lambda c: F.round(c, 6).alias(c)
    return evidence.apply_response(evidence.dedupe_evidence(ledger(f)), rs, XS, YS).select("alert_id", "response", r("p_before"), r("p"))


# ---- detectors ----------------------------------------------------------------------

LRS = {"card_testing": 0.5, "cnp_burst": 0.75, "new_device": 0.25, "new_device_proxy": 0.5, "out_of_region": 1.0, "account_takeover": 0.375, "T1": 0.125, "T2": 0.25,
       "T3": 0.5, "T4": 1.0, "near_threshold": 3.0, "cleared_travel": -0.5, "cleared_phone": -0.25, "amt_gt_1000": -0.125, "recurring": -0.476, "prior_fraud_card": 0.75,
       "prior_fraud_customer": 0.5}
# the big-purchase limit follows the small amounts of the test tables
SET = {**detect.DETECTORS, "legit_big_purchase": lambda lr: detect.legit_big_purchase(lr, 60.0)}
N = "CAST(NULL AS VARCHAR)"
DET = [
    ("card_testing", "testing_fires", "'card_testing'", "'testing_sequence_fires'", "sequence", "0.5"),
    ("card_not_present_fraud", "channel = 'online' AND unseen_product AND n_online >= 2 AND abs(amt_z) > 3", "'card_not_present_fraud'", N, "amount", "0.75"),
    ("card_not_present_new_device", "channel = 'online' AND device_profile IS NOT NULL AND (is_new_device IS TRUE OR id_15 = 'New')", "'card_not_present_new_device'", N, "device", "CASE WHEN proxy_flag THEN 0.5 ELSE 0.25 END"),
    ("out_of_region_use", "channel = 'in_person' AND addr1 <> home_asof", "'out_of_region_use'", "CASE WHEN prior_cleared_travel THEN 'legit_trip_hint' END", "region",
     "(CASE WHEN had_prior_txn_in_region THEN 0.5 ELSE 1 END) * (CASE WHEN prior_cleared_travel THEN 0.35 ELSE 1 END) * (CASE WHEN n_home_in_window > 0 THEN 1.5 ELSE 1 END)"),
    ("account_takeover", "mixed_24h IS TRUE OR (near_online >= 1 AND near_in_person >= 1) OR ((near_new >= 1)::INT + (near_proxied >= 1)::INT + (near_bad_match >= 1)::INT) >= 2", "'account_takeover'", N, "identity_flags", "0.375"),
    ("undocumented_proxy_ring", "device_profile IS NOT NULL AND (is_hub OR tier IS NOT NULL OR n_ring_cards >= 3)", "CASE WHEN NOT is_hub AND tier IN ('T3', 'T4') THEN 'undocumented' END",
     "CASE WHEN NOT is_hub AND tier IN ('T3', 'T4') THEN 'undocumented_coordinated' END", "device", "CASE WHEN is_hub OR tier IS NULL THEN 0 WHEN tier = 'T1' THEN 0.125 WHEN tier = 'T2' THEN 0.25 WHEN tier = 'T3' THEN 0.5 ELSE 1 END"),
    ("undocumented_threshold_burst", "near_threshold_fires", "'undocumented'", "'undocumented_coordinated'", "sequence", "3.0"),
    ("legit_trip", "prior_cleared_travel", "'none'", "'legit_trip_hint'", "memory", "-0.5"),
    ("legit_new_phone", "prior_cleared_phone", "'none'", "'legit_new_phone_hint'", "memory", "-0.25"),
    ("legit_big_purchase", "amt > 60 AND id_15 IS DISTINCT FROM 'New' AND is_new_device IS DISTINCT FROM TRUE AND (channel = 'in_person' OR is_new_device IS FALSE) AND has_prior_big", "'none'", "'legit_big_purchase_hint'", "amount", "-0.125"),
    ("legit_recurring", "recurring_fires AND n_recurring >= 3", "CASE WHEN trigger_type = 'customer_report' THEN 'none' END", "CASE WHEN trigger_type = 'customer_report' THEN 'is_recurring_match' END", "amount", "-0.476"),
    ("risk_score_decile", "trigger_type <> 'risk_score'", N, N, "history", "greatest(-0.7, least(0.7, decile_log_lr))"),
    ("prior_fraud_history", "prior_fraud_card OR prior_fraud_customer", N, N, "history", "CASE WHEN prior_fraud_card THEN 0.75 ELSE 0.5 END"),
]


# detectors that hold the flagged transaction for affected, and when
NAMES = {**{d[0]: "TRUE" for d in DET[:5]}, "undocumented_proxy_ring": "tier IS NOT NULL AND NOT is_hub", "undocumented_threshold_burst": "TRUE"}


def det_sql(i, weights=None):
    name, cond, pat, tag, ch, w = DET[i]
    w = (weights or {}).get(name, w)
    return (f"SELECT alert_id, {i} AS seq, '{name}' AS detector, {pat} AS pattern, {tag} AS tag, '{ch}' AS channel, round(CAST({w} AS DOUBLE), 6) AS log_lr, "
            f"coalesce({NAMES.get(name, 'FALSE')}, FALSE) AS names_flagged FROM sig WHERE {cond}")


DET_ALL = " UNION ALL ".join(det_sql(i) for i in range(len(DET)))
# the flagged row of each detector that names it, and the small and large online rows of a testing sequence that fires
AFF_SQL = """
SELECT d.alert_id, d.detector, f.flagged_txn_id AS txn_id FROM det d JOIN flag f USING (alert_id) WHERE d.names_flagged
UNION SELECT d.alert_id, d.detector, t.txn_id FROM det d JOIN flag f USING (alert_id) JOIN txn t ON t.card = f.card AND t.ts_us BETWEEN f.lo_us AND f.hi_us
WHERE d.detector = 'card_testing' AND t.channel = 'online' AND (t.amt < 20 OR t.amt > 60)
"""
WITH_AFF = """SELECT d.alert_id, d.seq, d.detector, d.pattern, d.tag, d.channel, d.log_lr, coalesce(a.n, 0) AS n_affected, coalesce(a.ids, '') AS affected_txn_ids
FROM det d LEFT JOIN (SELECT alert_id, detector, count(*) AS n, string_agg(CAST(txn_id AS VARCHAR), '|' ORDER BY txn_id) AS ids FROM aff GROUP BY 1, 2) a USING (alert_id, detector)"""
DETS = {**SIG, "det": DET_ALL, "aff": AFF_SQL}


def fired(f):
    return f.stored("fired", lambda: detect.run_detectors(signals(f), LRS, SET))


def affected(f):
    return f.stored("affected", lambda: detect.affected_ids(f.flags, f.txn, fired(f), 20.0, 60.0))


def detections(f):
    return detect.with_affected(fired(f), affected(f)).withColumn("log_lr", F.round("log_lr", 6)).drop("names_flagged")


def _one_detector(i):
    name = DET[i][0]

    @query(f"t{i + 1:02d}_{name}", f"{WITH_AFF} WHERE d.detector = '{name}'", SV, DETS)
    def _(f):
        rows = detect.run_detectors(signals(f), LRS, SET).where(F.col("detector") == name)
        return (detect.with_affected(rows, detect.affected_ids(f.flags, f.txn, rows, 20.0, 60.0))
                .withColumn("log_lr", F.round("log_lr", 6)).drop("names_flagged"))


for _i in range(len(DET)):
    _one_detector(_i)


@query("t14_run_detectors", WITH_AFF, SV, DETS)
def _(f):
    return detections(f)


@query("t14_affected_ids", "SELECT alert_id, detector, txn_id FROM aff", SV, DETS)
def _(f):
    return affected(f)


PATTERN_SQL = """SELECT f.alert_id, coalesce(p.pattern, 'none') AS pattern FROM flag f LEFT JOIN (SELECT alert_id, pattern FROM det WHERE pattern IS NOT NULL AND pattern <> 'none'
 QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY (pattern = 'undocumented') DESC, greatest(log_lr, 0) DESC, seq) = 1) p USING (alert_id)"""


@query("t14_select_pattern", PATTERN_SQL, SV, {**SIG, "det": DET_ALL})
def _(f):
    return detect.select_pattern(f.flags, fired(f))


@query("t14_fallback_pattern", """SELECT alert_id, CASE WHEN channel = 'in_person' AND addr1 <> home_asof THEN 'out_of_region_use' WHEN near_online >= 1 AND near_in_person >= 1 THEN 'account_takeover'
 WHEN channel = 'online' AND (id_15 = 'New' OR is_new_device IS TRUE) THEN 'card_not_present_new_device' WHEN channel = 'online' THEN 'card_not_present_fraud' ELSE 'none' END AS pattern FROM sig""", SV, SIG)
def _(f):
    return signals(f).select("alert_id", detect.fallback_pattern().alias("pattern"))


@query("p13_implied_response", """SELECT f.alert_id, coalesce(CASE WHEN f.flagged_txn_id % 9 = 0 THEN 'no_reply' END, CASE WHEN f.trigger_type = 'customer_report' AND NOT coalesce(r.hit, FALSE) THEN 'denied' END) AS response
 FROM flag f LEFT JOIN (SELECT alert_id, bool_or(tag = 'is_recurring_match') AS hit FROM det GROUP BY 1) r USING (alert_id)""", SV, {**SIG, "det": DET_ALL})
def _(f):
    a = f.flags.select("alert_id", "trigger_type", F.expr("CASE WHEN flagged_txn_id % 9 = 0 THEN 'no_reply' END").alias("response"))
    return detect.implied_response(a, detect.alert_tags(fired(f))).select("alert_id", "response")


@query("u01_register_signal", lr_sql(counts_sql({"night_view": ("product_cd = 'view' AND k % 4 = 0", "_s")}, {"_s": "channel = 'in_person'"})), LV, LAB)
def _(f):
    r = evidence.SignalRegistry({}, {})
    r.register_scope("_s", "channel = 'in_person'")
    r.register_signal("night_view", "product_cd = 'view' AND k % 4 = 0", "_s", sample=labelled(f))
    return evidence.likelihood_ratios(evidence.signal_counts(labelled(f), r))


@query("u02_register_detector", f"SELECT alert_id, 13 AS seq, 'small_purchase' AS detector, 'card_testing' AS pattern, {N} AS tag, 'amount' AS channel, 0.25::DOUBLE AS log_lr, FALSE AS names_flagged FROM sig WHERE amt < 20 AND channel = 'online'", SV, SIG)
def _(f):
    mine = detect.register_detector("small_purchase", lambda lr: detect._row("small_purchase", detect.yes("amt < 20 AND channel = 'online'"), "card_testing", "amount", F.lit(0.25)))
    return detect.run_detectors(signals(f), LRS, mine).where(F.col("detector") == "small_purchase")


