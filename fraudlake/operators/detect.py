"""The thirteen detectors over one signal row for each alert, and the choice of a pattern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, HOUR_US
from fraudlake.operators.neighbors import DISTANT_PAST, around, longs, one, online, proxied
from fraudlake.operators.timeline import asked, running_max, window_members, window_sums

# Weights used when no fitted ratio is given, and the near-threshold weight.
DEFAULT_LR = {
    "card_testing": 0.0, "cnp_burst": 0.0, "new_device": 0.0, "new_device_proxy": 0.0, "out_of_region": 0.0, "account_takeover": 0.0,
    "T1": 0.0, "T2": 0.0, "T3": 0.0, "T4": 0.0, "near_threshold": 3.0, "cleared_travel": 0.0, "cleared_phone": 0.0,
    "amt_gt_1000": 0.0, "recurring": -0.476, "prior_fraud_card": 0.0, "prior_fraud_customer": 0.0,
}


def nearby_activity(flags: DataFrame, txn: DataFrame, hours: int = 48, entity: str = "customer_id") -> DataFrame:
    """Channel and warning counts of the entity within ``hours`` either side of the flagged row."""
    bad = F.lit(False)
    for c in ("M1", "M2", "M3", "M6", "M7", "M8", "M9"):
        if c in txn.columns:
            bad = bad | F.coalesce(F.lower(F.col(c)) == "false", F.lit(False))
    on = online()
    m = {"near_online": one(on), "near_in_person": one(F.col("channel") == "in_person"),
         "near_new": one(on & F.coalesce(F.col("id_15") == "New", F.lit(False))), "near_proxied": one(on & proxied()), "near_bad_match": one(on & bad)}
    n = window_sums(around(flags, hours * HOUR_US), txn, [entity], m, ["alert_id"])
    return longs(flags.select("alert_id").join(n, "alert_id", "left"), *m)


def prior_big_purchases(flags: DataFrame, txn: DataFrame, entity: str = "customer_id", floor: float = 1000.0) -> DataFrame:
    """Whether an earlier row of the entity has at least half the flagged amount.

    The largest earlier amount decides: a time line of the entity carries the running maximum, and an alert is one
    probe on it. Only alerts above ``floor`` ask, and rows below half of it cannot answer, so little data takes part.
    """
    probes = flags.where(F.col("amt") > floor).select(
        "alert_id", entity, F.lit(DISTANT_PAST).alias("lo_us"), (F.col("ts_us") - 1).alias("t"), F.col("amt").alias("x"))
    probes = probes.where(F.col(entity).isNotNull())
    rows = asked(probes, txn.where((F.col("amt") >= floor / 2) & F.col(entity).isNotNull()), [entity], F.col("t"))
    top = running_max(rows.select(entity, F.col("ts_us").alias("t"), "amt"), probes, [entity], "amt", ["alert_id", "x"])
    hit = top.where(F.col("amt") >= F.col("x") * 0.5).select("alert_id").distinct().withColumn("has_prior_big", F.lit(True))
    return flags.select("alert_id").join(hit, "alert_id", "left").withColumn("has_prior_big", F.coalesce("has_prior_big", F.lit(False)))


def alert_signals(flags: DataFrame, features: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """One wide row for each alert: flagged features joined with one-row-per-alert signal tables."""
    have = set(flags.columns)
    feat = features.select(F.col("txn_id").alias("flagged_txn_id"), *[c for c in features.columns if c not in have and c != "txn_id"])
    out = flags.join(feat, "flagged_txn_id", "left")
    for p in parts:
        out = out.join(p.select("alert_id", *[c for c in p.columns if c not in out.columns]), "alert_id", "left")
    return out


def yes(sql: str) -> Column:
    return F.coalesce(F.expr(f"({sql})"), F.lit(False))


def _row(name: str, fires: Column, pattern: Column | str | None, channel: str, log_lr: Column, tag: Column | str | None = None,
         names: Column | bool = False) -> Column:
    """The row of a detector that fires; ``names`` tells whether it holds the flagged transaction itself for affected."""
    text = lambda v: (F.lit(v) if v is None or isinstance(v, str) else v).cast("string")
    own = F.lit(names) if isinstance(names, bool) else names
    return F.when(fires, F.struct(F.lit(name).alias("detector"), text(pattern).alias("pattern"), text(tag).alias("tag"),
                                  F.lit(channel).alias("channel"), log_lr.cast("double").alias("log_lr"), own.alias("names_flagged")))


def card_testing(lr):
    return _row("card_testing", yes("testing_fires"), "card_testing", "sequence", F.lit(lr["card_testing"]), "testing_sequence_fires", True)


def card_not_present(lr):
    f = yes("channel = 'online' AND unseen_product AND n_online >= 2 AND abs(amt_z) > 3")
    return _row("card_not_present_fraud", f, "card_not_present_fraud", "amount", F.lit(lr["cnp_burst"]), names=True)


def new_device(lr):
    f = yes("channel = 'online' AND device_profile IS NOT NULL AND (coalesce(is_new_device, false) OR coalesce(id_15 = 'New', false))")
    return _row("card_not_present_new_device", f, "card_not_present_new_device", "device",
                F.when(yes("proxy_flag"), lr["new_device_proxy"]).otherwise(lr["new_device"]), names=True)


def out_of_region(lr):
    f = yes("channel = 'in_person' AND addr1 IS NOT NULL AND home_asof IS NOT NULL AND addr1 <> home_asof")
    damp = (F.when(yes("had_prior_txn_in_region"), 0.5).otherwise(1.0) * F.when(yes("prior_cleared_travel"), 0.35).otherwise(1.0)
            * F.when(yes("n_home_in_window > 0"), 1.5).otherwise(1.0))
    tag = F.when(yes("prior_cleared_travel"), "legit_trip_hint")
    return _row("out_of_region_use", f, "out_of_region_use", "region", F.lit(lr["out_of_region"]) * damp, tag, True)


def account_takeover(lr):
    f = yes("coalesce(mixed_24h, false) OR (near_online >= 1 AND near_in_person >= 1) OR "
            "(CAST(near_new >= 1 AS INT) + CAST(near_proxied >= 1 AS INT) + CAST(near_bad_match >= 1 AS INT)) >= 2")
    return _row("account_takeover", f, "account_takeover", "identity_flags", F.lit(lr["account_takeover"]), names=True)


def proxy_ring(lr):
    """Hub devices and unlinked crowds give a neutral row; tiers 3 and 4 name the undocumented pattern."""
    f = yes("device_profile IS NOT NULL AND (is_hub OR tier IS NOT NULL OR n_ring_cards >= 3)")
    w = F.when(yes("is_hub"), 0.0)
    for t in ("T1", "T2", "T3", "T4"):
        w = w.when(F.col("tier") == t, lr[t])
    ring = yes("tier IN ('T3', 'T4') AND NOT is_hub")
    return _row("undocumented_proxy_ring", f, F.when(ring, "undocumented"), "device", w.otherwise(0.0), F.when(ring, "undocumented_coordinated"),
                yes("tier IS NOT NULL AND NOT is_hub"))


def near_threshold(lr):
    return _row("undocumented_threshold_burst", yes("near_threshold_fires"), "undocumented", "sequence", F.lit(lr["near_threshold"]), "undocumented_coordinated", True)


def legit_trip(lr):
    return _row("legit_trip", yes("prior_cleared_travel"), "none", "memory", F.lit(lr["cleared_travel"]), "legit_trip_hint")


def legit_new_phone(lr):
    return _row("legit_new_phone", yes("prior_cleared_phone"), "none", "memory", F.lit(lr["cleared_phone"]), "legit_new_phone_hint")


def legit_big_purchase(lr, floor: float = 1000.0):
    f = yes(f"amt > {floor} AND NOT coalesce(id_15 = 'New', false) AND NOT coalesce(is_new_device, false) "
            "AND (channel = 'in_person' OR is_new_device = false) AND has_prior_big")
    return _row("legit_big_purchase", f, "none", "amount", F.lit(lr["amt_gt_1000"]), "legit_big_purchase_hint")


def legit_recurring(lr):
    dispute = yes("trigger_type = 'customer_report'")
    return _row("legit_recurring", yes("recurring_fires AND n_recurring >= 3"), F.when(dispute, "none"), "amount", F.lit(lr["recurring"]),
                F.when(dispute, "is_recurring_match"))


def risk_decile_evidence(lr):
    return _row("risk_score_decile", yes("coalesce(trigger_type, '') <> 'risk_score' AND decile_log_lr IS NOT NULL"), None, "history",
                F.greatest(F.lit(-0.7), F.least(F.lit(0.7), F.col("decile_log_lr"))))


def prior_fraud(lr):
    f = yes("coalesce(prior_fraud_card, false) OR coalesce(prior_fraud_customer, false)")
    return _row("prior_fraud_history", f, None, "history", F.when(yes("prior_fraud_card"), lr["prior_fraud_card"]).otherwise(lr["prior_fraud_customer"]))


DETECTORS: dict[str, Callable[[dict], Column]] = {
    "card_testing": card_testing, "card_not_present_fraud": card_not_present, "card_not_present_new_device": new_device,
    "out_of_region_use": out_of_region, "account_takeover": account_takeover, "undocumented_proxy_ring": proxy_ring,
    "undocumented_threshold_burst": near_threshold, "legit_trip": legit_trip, "legit_new_phone": legit_new_phone,
    "legit_big_purchase": legit_big_purchase, "legit_recurring": legit_recurring, "risk_score_decile": risk_decile_evidence,
    "prior_fraud_history": prior_fraud,
}


def register_detector(name: str, fn: Callable[[dict], Column], into: dict | None = None) -> dict:
    """A copy of the detectors with ``fn(lr) -> Column`` added at the end."""
    return {**(DETECTORS if into is None else into), name: fn}


def run_detectors(signals: DataFrame, lr: dict[str, float] | None = None, detectors: dict | None = None) -> DataFrame:
    """All detector rows of all alerts in one projection: ``(alert_id, seq, detector, pattern, tag, channel, log_lr, names_flagged)``."""
    lr = {**DEFAULT_LR, **(lr or {})}
    cols = [fn(lr) for fn in (detectors or DETECTORS).values()]
    x = signals.select("alert_id", F.posexplode(F.array(*cols)).alias("seq", "r")).where(F.col("r").isNotNull())
    return x.select("alert_id", "seq", "r.*")


# Which rows of the alert's window a detector names besides the flagged one: a predicate on transactions for each such detector.
MEMBERS: dict[str, str] = {"card_testing": "channel = 'online' AND (amt < {small} OR amt > {large})"}


def affected_ids(flags: DataFrame, txn: DataFrame, fired: DataFrame, small: float = 5.0, large: float = 100.0,
                 members: dict[str, str] | None = None, width_us: int = 14 * DAY_US) -> DataFrame:
    """``(alert_id, detector, txn_id)``: the transactions each firing detector holds for affected.

    ``fired`` are the rows of ``run_detectors``. Detectors that look at a window put their name and window on
    one list of intervals, and a single bucketed interval join finds the rows of all of them; a row passes only the
    predicate of the detector that asks. Alerts on which no such detector fires read nothing.
    """
    rules = {n: p.format(small=small, large=large) for n, p in (MEMBERS if members is None else members).items()}
    own = flags.select("alert_id", F.col("flagged_txn_id").alias("txn_id"))
    named = fired.where("names_flagged").select("alert_id", "detector").join(own, "alert_id").select("alert_id", "detector", "txn_id")
    if not rules:
        return named
    asking = fired.where(F.col("detector").isin(list(rules))).select("alert_id", "detector")
    spans = asking.join(flags.select("alert_id", "card", "lo_us", "hi_us"), "alert_id").where(F.col("card").isNotNull())
    # one flag for each rule, so that a row meets the intervals once whatever the number of rules
    tests = {f"_is_{k}": yes(rule) for k, rule in enumerate(rules.values())}
    any_rule = F.lit(False)
    for t in tests.values():
        any_rule = any_rule | t
    rows = txn.where(any_rule).select("card", "txn_id", "ts_us", *[t.alias(n) for n, t in tests.items()])
    hit = window_members(spans, rows, ["card"], width_us)
    keep = F.lit(False)
    for k, name in enumerate(rules):
        keep = keep | ((F.col("detector") == name) & F.col(f"_is_{k}"))
    return named.unionByName(hit.where(keep).select("alert_id", "detector", "txn_id")).distinct()


def with_affected(fired: DataFrame, affected: DataFrame) -> DataFrame:
    """``fired`` with the number of affected transactions and their ids in ascending order, joined by ``|`` (empty: none).

    The list is that of one alert and detector, as a report prints it; joins and counts start from ``affected_ids``.
    """
    ids = affected.groupBy("alert_id", "detector").agg(F.count("*").alias("n_affected"), F.array_sort(F.collect_list("txn_id")).alias("_ids"))
    out = fired.join(ids, ["alert_id", "detector"], "left")
    return (out.withColumn("n_affected", F.coalesce("n_affected", F.lit(0).cast("long")))
            .withColumn("affected_txn_ids", F.coalesce(F.array_join(F.col("_ids").cast("array<string>"), "|"), F.lit(""))).drop("_ids"))


def select_pattern(alerts: DataFrame, rows: DataFrame) -> DataFrame:
    """Undocumented wins; else the named pattern with the largest positive weight, detector order breaking ties."""
    named = rows.where(F.col("pattern").isNotNull() & (F.col("pattern") != "none"))
    rank = F.struct((F.col("pattern") == "undocumented").alias("u"), F.greatest("log_lr", F.lit(0.0)).alias("w"), (-F.col("seq")).alias("s"))
    best = named.groupBy("alert_id").agg(F.max_by("pattern", rank).alias("pattern"))
    return alerts.select("alert_id").join(best, "alert_id", "left").withColumn("pattern", F.coalesce("pattern", F.lit("none")))


def fallback_pattern() -> Column:
    """Pattern of a fraud verdict that no detector named, from channel, region and nearby activity."""
    return (F.when(yes("channel = 'in_person' AND addr1 IS NOT NULL AND home_asof IS NOT NULL AND addr1 <> home_asof"), "out_of_region_use")
            .when(yes("near_online >= 1 AND near_in_person >= 1"), "account_takeover")
            .when(yes("channel = 'online' AND (coalesce(id_15 = 'New', false) OR coalesce(is_new_device, false))"), "card_not_present_new_device")
            .when(yes("channel = 'online'"), "card_not_present_fraud").otherwise("none"))


def alert_tags(rows: DataFrame) -> DataFrame:
    """Policy tags of each alert as booleans."""
    t = lambda v: F.max(F.when(F.col("tag") == v, True).otherwise(False))
    return rows.groupBy("alert_id").agg(*[t(v).alias(v) for v in (
        "testing_sequence_fires", "is_recurring_match", "undocumented_coordinated", "legit_trip_hint", "legit_new_phone_hint", "legit_big_purchase_hint")])


def implied_response(alerts: DataFrame, tags: DataFrame) -> DataFrame:
    """A customer report counts as a denial unless the recurring rule fires; a response already there stays."""
    j = alerts.join(tags.select("alert_id", "is_recurring_match"), "alert_id", "left")
    hit = (F.col("trigger_type") == "customer_report") & ~F.coalesce("is_recurring_match", F.lit(False))
    return j.withColumn("response", F.coalesce(F.col("response"), F.when(hit, "denied"))).drop("is_recurring_match")


