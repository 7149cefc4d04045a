"""Labels, scoped signal counts, likelihood ratios and the evidence ledger."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signal predicates and their scopes over the feature table.
SCOPES = {
    "all": "true",
    "online": "channel = 'online'",
    "in_person": "channel = 'in_person'",
    "online_R": "channel = 'online' AND product_cd = 'R'",
    "product_R": "product_cd = 'R'",
}
SIGNALS = {
    "is_new_device_for_card": ("is_new_device", "online"),
    "unseen_productcd": ("unseen_product", "all"),
    "unseen_p_emaildomain": ("unseen_email", "online"),
    "out_of_home_region_asof": ("out_of_home", "in_person"),
    "amt_z_asof_gt3": ("abs(amt_z) > 3", "all"),
    "amt_z_asof_gt5": ("abs(amt_z) > 5", "all"),
    "proxy_flag": ("channel = 'online' AND proxy_flag", "online"),
    "id_15_new": ("channel = 'online' AND id_15 = 'New'", "online"),
    "online_R_near_100": ("amt BETWEEN 95 AND 105", "online_R"),
    "P_or_R_anonymous_com_on_R": ("p_email = 'anonymous.com' OR r_email = 'anonymous.com'", "product_R"),
    "amt_gt_1000": ("amt > 1000", "all"),
    "prior_fraud_on_card_tuple": ("prior_fraud_card", "all"),
    "prior_fraud_on_customer": ("prior_fraud_customer", "all"),
    "prior_cleared_travel_on_card": ("prior_cleared_travel", "all"),
    "prior_cleared_new_phone_on_card": ("prior_cleared_phone", "all"),
    "n_online_last_48h_2_4": ("burst_bucket = '2-4'", "online"),
    "n_online_last_48h_5plus": ("burst_bucket = '5+'", "online"),
    "mixed_channel_last_24h": ("mixed_24h", "all"),
    **{f"risk_score_decile_{d}": (f"risk_decile = {d}", "all") for d in range(1, 11)},
}
LOG_ODDS_CAP = 4.0
P_MIN, P_MAX = 0.02, 0.98
# Likelihood ratios of a customer response.
RESPONSE_LR = {"denied": 9.0, "confirmed": 0.10, "no_reply": 1.20}


class SignalRegistry:
    """Named predicates with a scope; users add their own to the built-in ones."""

    def __init__(self, signals: dict[str, tuple[str, str]] | None = None, scopes: dict[str, str] | None = None):
        self.signals = dict(SIGNALS if signals is None else signals)
        self.scopes = dict(SCOPES if scopes is None else scopes)

    def register_scope(self, name: str, predicate: str) -> None:
        self.scopes[name] = predicate

    def register_signal(self, name: str, predicate: str, scope: str = "all", sample: DataFrame | None = None) -> None:
        """Add a predicate; with ``sample`` Spark checks that it is valid on that table."""
        if scope not in self.scopes:
            raise ValueError(f"unknown scope {scope}")
        if sample is not None:
            sample.where(F.expr(predicate))  # analysis fails for bad names or types
        self.signals[name] = (predicate, scope)


def labels(txn: DataFrame, fraud: DataFrame, cleared: DataFrame) -> DataFrame:
    """``y`` = 1 inside a confirmed-fraud episode, else 0; ``is_cleared`` marks cleared cases."""
    f = fraud.select("txn_id", F.lit(1).alias("y"))
    c = cleared.select("txn_id", F.lit(True).alias("is_cleared"))
    return (txn.join(f, "txn_id", "left").join(c, "txn_id", "left")
            .withColumn("y", F.coalesce("y", F.lit(0))).withColumn("is_cleared", F.coalesce("is_cleared", F.lit(False))))


def _yes(predicate: str) -> Column:
    return F.coalesce(F.expr(f"({predicate})"), F.lit(False))


def signal_counts(labelled: DataFrame, registry: SignalRegistry | None = None) -> DataFrame:
    """Hits and scope sizes of every signal among fraud, other and cleared rows, in one pass."""
    r = registry or SignalRegistry()
    pos, neg, clr = F.col("y") == 1, F.col("y") == 0, F.col("is_cleared")
    aggs, names = [], list(r.signals)
    n = lambda c, a: F.count(F.when(c, 1)).alias(a)
    used = sorted({s for _, s in r.signals.values()})
    for i, s in enumerate(used):
        sc = _yes(r.scopes[s])
        aggs += [n(sc & pos, f"s{i}_p"), n(sc & neg, f"s{i}_n"), n(sc & clr, f"s{i}_c")]
    for i, name in enumerate(names):
        p, s = r.signals[name]
        hit = _yes(r.scopes[s]) & _yes(p)
        aggs += [n(hit & pos, f"h{i}_p"), n(hit & neg, f"h{i}_n"), n(hit & clr, f"h{i}_c")]
    one = labelled.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(name).alias("signal"), F.lit(r.signals[name][1]).alias("scope"),
        *[F.col(f"h{i}_{k}").alias(a) for k, a in (("p", "a_pos"), ("n", "b_neg"), ("c", "c_cleared"))],
        *[F.col(f"s{used.index(r.signals[name][1])}_{k}").alias(a) for k, a in (("p", "n_pos"), ("n", "n_neg"), ("c", "n_cleared"))])
        for i, name in enumerate(names)])
    return one.select(F.inline(rows))


def likelihood_ratios(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Smoothed ratio against other rows and against cleared rows, with logarithms."""
    p = lambda a, n: (F.col(a) + alpha) / (F.col(n) + 2 * alpha)
    lr, lc = p("a_pos", "n_pos") / p("b_neg", "n_neg"), p("a_pos", "n_pos") / p("c_cleared", "n_cleared")
    r = lambda c, d: F.round(c, d)
    return counts.select(
        "*", r(p("a_pos", "n_pos"), 6).alias("p_pos"), r(p("b_neg", "n_neg"), 6).alias("p_neg"),
        r(p("c_cleared", "n_cleared"), 6).alias("p_cleared"), r(lr, 4).alias("lr"), r(F.log(lr), 4).alias("log_lr"),
        r(lc, 4).alias("lr_vs_cleared"), r(F.log(lc), 4).alias("log_lr_vs_cleared"))


def joint_lr(labelled: DataFrame, predicates: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios of arbitrary predicates: ``{name: (predicate, scope predicate)}``."""
    scopes = {f"_{i}": sc for i, (_, sc) in enumerate(predicates.values())}
    sig = {n: (p, f"_{i}") for i, (n, (p, _)) in enumerate(predicates.items())}
    return likelihood_ratios(signal_counts(labelled, SignalRegistry(sig, scopes)))


def decile_lr(labelled: DataFrame, alpha: float = 1.0, clip: float = 0.7) -> DataFrame:
    """Ratio of fraud to cleared rows in each risk decile, with the clipped logarithm used as evidence."""
    n = lambda c: F.count(F.when(c, 1))
    g = labelled.groupBy("risk_decile").agg(n(F.col("y") == 1).alias("a_pos"), n(F.col("is_cleared")).alias("c_cleared"))
    tot = labelled.agg(n(F.col("y") == 1).alias("n_pos"), n(F.col("is_cleared")).alias("n_cleared"))
    # a one-row table: the totals, looked up on a constant key
    j = g.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k").drop("_k")
    lr = ((F.col("a_pos") + alpha) / (F.col("n_pos") + 2 * alpha)) / ((F.col("c_cleared") + alpha) / (F.col("n_cleared") + 2 * alpha))
    log = F.round(F.log(lr), 4)
    return j.select("risk_decile", "a_pos", "n_pos", "c_cleared", "n_cleared", F.round(lr, 4).alias("lr"), log.alias("log_lr"),
                    F.greatest(F.lit(-clip), F.least(F.lit(clip), log)).alias("log_lr_used"))


TIER_TESTS = {
    "T1": "n_prior_fraud > 0",
    "T2": "n_prior_fraud > 0 AND proxy_flag",
    "T3": "n_prior_fraud > 0 AND proxy_flag AND n_other_new_or_proxied >= 2",
    "T4": "n_prior_fraud > 0 AND n_other_fraud >= 2",
}
BUCKETS = ["le5", "6-20", "21-100"]


def tier_lr(tiered: DataFrame) -> DataFrame:
    """Ratios of the four device tiers, overall and for each degree bucket; ``tiered`` has labels and tier inputs."""
    tests = {f"{t}": (p + " AND bucket IS NOT NULL", "bucket IS NOT NULL") for t, p in TIER_TESTS.items()}
    tests |= {f"{t}_{b}": (f"{p} AND bucket = '{b}'", f"bucket = '{b}'") for b in BUCKETS for t, p in TIER_TESTS.items()}
    return joint_lr(tiered, tests)


def recurring_lr(labelled: DataFrame) -> DataFrame:
    return joint_lr(labelled, {"recurring_ge3": ("recurring_ge3", "true")})


def lr_score(features: DataFrame, lr: dict[str, float], registry: SignalRegistry | None = None, prior: float = 0.0) -> DataFrame:
    """Log-odds of every transaction: prior plus the ratio of each signal that fires inside its scope."""
    r = registry or SignalRegistry()
    total = F.lit(float(prior))
    for name, value in lr.items():
        p, s = r.signals[name]
        total = total + F.when(_yes(r.scopes[s]) & _yes(p), F.lit(float(value))).otherwise(0.0)
    return features.select("txn_id", total.alias("log_odds"))


def lr_values(lr: DataFrame) -> dict[str, float]:
    """Ratio table as a dictionary; one row for each registered signal, so it is small by construction."""
    return {r["signal"]: r["log_lr"] for r in lr.select("signal", "log_lr").collect()}


# ---- ledger ------------------------------------------------------------------

# References that take part in the removal of doubled evidence.
CARD_FRAUD = "signal:prior_fraud_on_card_tuple"
CUSTOMER_FRAUD = "signal:prior_fraud_on_customer"
NEW_DEVICE_SINGLE = ["signal:is_new_device_for_card", "signal:id_15_new", "lr_table:is_new_device_for_card", "lr_table:id_15_new"]
NEW_DEVICE_JOINT = "conjunctive-lr:new_device"


def dedupe_evidence(ev: DataFrame) -> DataFrame:
    """Remove doubled evidence: ``ev(alert_id, seq, ref, channel, log_lr)``.

    Card-level prior fraud replaces customer-level; a joint new-device item replaces single ones,
    otherwise the strongest single item stays (the first of equals).
    """
    has = lambda s: F.coalesce(F.col("ref").contains(s), F.lit(False))
    single = has(NEW_DEVICE_SINGLE[0])
    for s in NEW_DEVICE_SINGLE[1:]:
        single = single | has(s)
    w = Window.partitionBy("alert_id")
    flag = lambda c: F.max(F.when(c, 1).otherwise(0)).over(w) == 1
    best = Window.partitionBy("alert_id", "_single").orderBy(F.desc(F.abs("log_lr")), "seq")
    d = (ev.withColumn("_card", flag(has(CARD_FRAUD))).withColumn("_joint", flag(has(NEW_DEVICE_JOINT)))
         .withColumn("_single", single).withColumn("_rk", F.row_number().over(best)))
    drop = (F.col("_card") & has(CUSTOMER_FRAUD)) | (F.col("_single") & (F.col("_joint") | (F.col("_rk") > 1)))
    return d.where(~drop).drop("_card", "_joint", "_single", "_rk")


def channel_count(ev: DataFrame) -> DataFrame:
    live = F.when(F.abs("log_lr") > 1e-9, F.col("channel"))
    return ev.groupBy("alert_id").agg(F.countDistinct(live).alias("n_channels"))


def sigmoid(x: Column) -> Column:
    return F.when(x > 60, 1.0).when(x < -60, 0.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def calibrate(p: Column, xs: list[float], ys: list[float], mode: str = "step") -> Column:
    """Look up a probability on calibration knots: the last knot at or below it, or linear between knots."""
    if not xs:
        return p
    x, y = F.array(*[F.lit(float(v)) for v in xs]), F.array(*[F.lit(float(v)) for v in ys])
    i = F.size(F.filter(x, lambda k: k <= p))
    out = F.element_at(y, F.greatest(i, F.lit(1)))
    if mode == "linear":
        n = F.least(i + 1, F.lit(len(xs)))
        x0, x1, y0, y1 = F.element_at(x, F.greatest(i, F.lit(1))), F.element_at(x, n), out, F.element_at(y, n)
        out = F.when(x1 > x0, y0 + (y1 - y0) * (p - x0) / (x1 - x0)).otherwise(y0)
    return F.when(p <= xs[0], float(ys[0])).when(p >= xs[-1], float(ys[-1])).otherwise(out)


def posterior(ev: DataFrame, xs: list[float], ys: list[float], prior: float = 0.0, mode: str = "step") -> DataFrame:
    """Sum the ledger, cap the log-odds, calibrate unless the alert model owns the score, clamp."""
    model = F.max(F.when(F.col("ref").startswith("alert_model:"), 1).otherwise(0))
    # exact decimal sum, so the result does not depend on row order
    s = ev.groupBy("alert_id").agg(F.sum(F.col("log_lr").cast("decimal(28,12)")).cast("double").alias("delta"), model.alias("_m"))
    raw = F.lit(float(prior)) + F.col("delta")
    s = s.withColumn("log_odds", F.greatest(F.lit(-LOG_ODDS_CAP), F.least(F.lit(LOG_ODDS_CAP), raw)))
    s = s.withColumn("p_raw", sigmoid(F.col("log_odds"))).withColumn("capped", F.col("log_odds") != raw)
    cal = F.when(F.col("_m") == 1, F.col("p_raw")).otherwise(calibrate(F.col("p_raw"), xs, ys, mode))
    return s.withColumn("p", F.greatest(F.lit(P_MIN), F.least(F.lit(P_MAX), cal))).drop("_m")


def verdict(p: Column, n_channels: Column, response: Column) -> Column:
    two = n_channels >= 2
    return (F.when(response == "denied", "fraud").when(response == "confirmed", "legitimate").when(response == "no_reply", "uncertain")
            .when((p >= 0.85) & two, "fraud").when((p <= 0.15) & two, "legitimate").otherwise("uncertain"))


def response_scenarios(alerts: DataFrame, xs: list[float], ys: list[float]) -> DataFrame:
    """What each customer answer would do: three rows for each of ``alerts(alert_id, log_odds, p, exposure)``."""
    opts = F.array(*[F.struct(F.lit(r).alias("response"), F.lit(v).alias("lr"), F.lit(math.log(v)).alias("shift")) for r, v in RESPONSE_LR.items()])
    x = alerts.withColumn("o", F.explode(opts)).select("alert_id", "p", "exposure", "o.response", "o.lr", (F.col("log_odds") + F.col("o.shift")).alias("new_log_odds"))
    x = x.withColumn("new_p", calibrate(sigmoid(F.col("new_log_odds")), xs, ys))
    x = x.withColumn("_w", F.col("lr") * F.col("p") + (1 - F.col("p")))
    # three rows for each alert
    w = Window.partitionBy("alert_id")
    x = x.withColumn("weight", F.col("_w") / F.sum("_w").over(w))
    x = (x.withColumn("expected_p", F.sum(F.col("weight") * F.col("new_p")).over(w))
          .withColumn("expected_shift", F.sum(F.col("weight") * F.abs(F.col("new_p") - F.col("p"))).over(w)))
    middle = F.col("p").between(0.30, 0.85) & (F.col("p") != 0.85)
    ask = (middle | ((F.col("exposure") > 500) & (F.col("p") < 0.85))) & (F.col("expected_shift") > 0.05)
    return x.withColumn("should_ask", ask).drop("_w", "lr", "exposure")


def apply_response(ev: DataFrame, responses: DataFrame, xs: list[float], ys: list[float], prior: float = 0.0) -> DataFrame:
    """Add the customer's answer as evidence and clamp the new probability to it; keeps the old one."""
    lr = F.create_map(*[F.lit(v) for r, x in RESPONSE_LR.items() for v in (r, math.log(x))])
    cols = ["alert_id", "ref", "channel", "log_lr"]
    add = responses.where(F.col("response").isNotNull()).select(
        "alert_id", F.concat(F.lit("customer_response:"), "response").alias("ref"), F.lit("customer").alias("channel"), lr[F.col("response")].alias("log_lr"))
    before = posterior(ev, xs, ys, prior).select("alert_id", F.col("p").alias("p_before"))
    after = posterior(ev.select(*cols).unionByName(add), xs, ys, prior).select("alert_id", "p")
    j = after.join(before, "alert_id").join(responses.select("alert_id", "response"), "alert_id", "left")
    p = F.when(F.col("response") == "denied", F.greatest("p", F.lit(0.85))).when(F.col("response") == "confirmed", F.least("p", F.lit(0.15))).otherwise(F.col("p"))
    return j.select("alert_id", "response", "p_before", p.alias("p"))


def needs_response(df: DataFrame) -> DataFrame:
    return df.where(F.col("verdict") == "uncertain")
