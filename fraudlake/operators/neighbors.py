"""One-hop questions about the card, device, region and recipient of every alert at once.

``flags`` is one row for each alert with the flagged transaction's attributes and a look-back
window ``[lo_us, hi_us]`` (see ``keys.alert_context``). Counts come from time lines, so an
alert costs a few probe rows however many transactions its card, device or region has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, HOUR_US
from fraudlake.operators.pairs import key_pairs, window_pairs
from fraudlake.operators.tables import device_degree, known_device
from fraudlake.operators.timeline import prior_time, window_counts, window_members, window_sums
from fraudlake.session import cut
from fraudlake.session import small as if_small

DISTANT_PAST = -(2**61)


def one(cond):
    return F.when(cond, 1).otherwise(0)


def online():
    return F.col("channel") == "online"


def proxied():
    return F.coalesce(F.col("id_23").startswith("IP_PROXY:"), F.lit(False))


def longs(df: DataFrame, *names: str) -> DataFrame:
    """Counts as longs, zero where a probe had no key."""
    for n in names:
        df = df.withColumn(n, F.coalesce(F.col(n), F.lit(0)).cast("long"))
    return df


def look_back(flags: DataFrame, us: int) -> DataFrame:
    return flags.withColumn("lo_us", F.col("opened_us") - us).withColumn("hi_us", F.col("opened_us"))


def around(flags: DataFrame, us: int, at: str = "ts_us") -> DataFrame:
    return flags.withColumn("lo_us", F.col(at) - us).withColumn("hi_us", F.col(at) + us)


def per_alert(flags: DataFrame, part: DataFrame, *names: str) -> DataFrame:
    """All alerts with the counts of ``part``; alerts without a key get zeros."""
    return longs(flags.select("alert_id").join(part, "alert_id", "left"), *names)


def card_window(flags: DataFrame, txn: DataFrame, width_us: int = 14 * DAY_US, key: str = "card") -> DataFrame:
    """Transactions of the alert's card inside its window, one row for each."""
    probes = flags.select("alert_id", key, "lo_us", "hi_us")
    data = txn.select(key, "txn_id", "ts_us", "channel", "product_cd", "amt", "addr1", "device_profile", "id_15", "id_23")
    return window_members(probes, data, [key], width_us).drop("lo_us", "hi_us")


def burst(flags: DataFrame, txn: DataFrame, hours: int = 48, min_n: int = 2) -> DataFrame:
    n = window_sums(look_back(flags, hours * HOUR_US), txn, ["card"], {"n_online": one(online())}, ["alert_id"])
    return per_alert(flags, n, "n_online").withColumn("fires", F.col("n_online") >= min_n)


def burst_members(flags: DataFrame, txn: DataFrame, hours: int = 48) -> DataFrame:
    m = card_window(look_back(flags, hours * HOUR_US), txn.where(online()), hours * HOUR_US)
    return m.select("alert_id", "txn_id")


def testing_sequence(flags: DataFrame, txn: DataFrame, small: float = 5.0, large: float = 100.0, k: int = 3) -> DataFrame:
    """Small and large online amounts in the window; fires on ``k`` small and one large."""
    m = {"n_small": one(online() & (F.col("amt") < small)), "n_large": one(online() & (F.col("amt") > large))}
    n = per_alert(flags, window_sums(flags, txn, ["card"], m, ["alert_id"]), "n_small", "n_large")
    return n.withColumn("fires", (F.col("n_small") >= k) & (F.col("n_large") >= 1))


def card_signals(flags: DataFrame, txn: DataFrame, small: float = 5.0, large: float = 100.0, k: int = 3, hours: int = 48, threshold: float = 500.0,
                 near: int = 3) -> DataFrame:
    """Testing sequence, burst and near-threshold counts of every alert's card in one pass over its time line.

    Both windows of an alert are probes on the same line: its own, and the ``hours`` before it opened.
    """
    ends = F.array(F.struct(F.lit("own").alias("frame"), F.col("lo_us").alias("lo_us"), F.col("hi_us").alias("hi_us")),
                   F.struct(F.lit("burst").alias("frame"), (F.col("opened_us") - hours * HOUR_US).alias("lo_us"), F.col("opened_us").alias("hi_us")))
    probes = flags.select("alert_id", "card", F.explode(ends).alias("e")).select("alert_id", "card", "e.frame", "e.lo_us", "e.hi_us")
    m = {"n_online": F.lit(1), "n_small": one(F.col("amt") < small), "n_large": one(F.col("amt") > large),
         "n_near": one((F.col("amt") < threshold) & (F.col("amt") >= threshold * 0.95))}
    sums = window_sums(probes, txn.where(online()), ["card"], m, ["alert_id", "frame"])
    pick = lambda frame, c: F.max(F.when(F.col("frame") == frame, F.col(c))).alias(c)
    n = sums.groupBy("alert_id").agg(pick("burst", "n_online"), *[pick("own", c) for c in ("n_small", "n_large", "n_near")])
    out = per_alert(flags, n, "n_online", "n_small", "n_large", "n_near")
    return (out.withColumn("testing_fires", (F.col("n_small") >= k) & (F.col("n_large") >= 1)).withColumn("near_threshold_fires", F.col("n_near") >= near))


def testing_members(flags: DataFrame, txn: DataFrame, small: float = 5.0, large: float = 100.0) -> DataFrame:
    rows = txn.where(online() & ((F.col("amt") < small) | (F.col("amt") > large)))
    kind = F.when(F.col("amt") < small, "small").otherwise("large")
    return card_window(flags, rows).select("alert_id", "txn_id", kind.alias("kind"))


def testing_sequence_ordered(txn: DataFrame, small: float = 5.0, large: float = 100.0, k: int = 3,
                             hours: float = 1.0) -> DataFrame:
    """Large online rows that follow at least ``k`` small ones within the time before them."""
    on = txn.where(online())
    probes = on.where(F.col("amt") > large).select(
        "card", "txn_id", (F.col("ts_us") - int(hours * HOUR_US)).alias("lo_us"), (F.col("ts_us") - 1).alias("hi_us"))
    n = window_sums(probes, on.where(F.col("amt") < small), ["card"], {"n_small": F.lit(1)}, ["txn_id"])
    return longs(n, "n_small").where(F.col("n_small") >= k)


def device_neighbors(flags: DataFrame, txn: DataFrame, cc_dev: DataFrame, cap: int = 100,
                     known: DataFrame | None = None) -> DataFrame:
    """Use of the alert's device by all its cards in the window; hubs above ``cap`` cards are not followed.

    A followed device has at most ``cap`` cards, so the probes are (alert, device, card).
    """
    known = known if known is not None else known_device(txn)
    deg = device_degree(known)
    dev = flags.where(F.col("device_profile").isNotNull()).join(deg, "device_profile", "left")
    narrow = dev.where(F.col("degree") <= cap).withColumnRenamed("card", "own")
    pairs = narrow.join(known.select("device_profile", "card"), "device_profile")
    pairs = cut(pairs.select("alert_id", "own", "card", "device_profile", "lo_us", "hi_us"))
    n = window_sums(pairs, txn, ["device_profile", "card"], {"n": F.lit(1)}, ["alert_id", "own", "card"])
    got = n.groupBy("alert_id").agg(
        F.sum("n").alias("n_txns"), F.sum(one(F.col("n") > 0)).alias("n_cards"),
        F.sum(one((F.col("n") > 0) & (F.col("card") != F.col("own")))).alias("n_other_cards"))
    cases = (narrow.select("alert_id", "device_profile").join(
        cc_dev.groupBy("device_profile").agg(F.countDistinct("case_id").alias("n_cases")), "device_profile")
        .select("alert_id", "n_cases"))
    out = dev.select("alert_id", F.col("degree").alias("degree")).join(got, "alert_id", "left").join(cases, "alert_id", "left")
    return longs(out, "degree", "n_txns", "n_cards", "n_other_cards", "n_cases")


def device_peers(flags: DataFrame, txn: DataFrame, cap: int = 100, known: DataFrame | None = None) -> DataFrame:
    """Other cards on the alert's narrow device inside the window: ``(alert_id, card)``."""
    known = known if known is not None else known_device(txn)
    narrow = device_degree(known).where(F.col("degree") <= cap)
    dev = flags.join(narrow, "device_profile").withColumnRenamed("card", "own")
    pairs = dev.join(known.select("device_profile", "card"), "device_profile").where(F.col("card") != F.col("own"))
    pairs = cut(pairs.select("alert_id", "card", "device_profile", "lo_us", "hi_us"))
    n = window_sums(pairs, txn, ["device_profile", "card"], {"n": F.lit(1)}, ["alert_id", "card"])
    return n.where(F.col("n") > 0).select("alert_id", "card")


def region_history(flags: DataFrame, txn: DataFrame, home: DataFrame) -> DataFrame:
    """Rows ever in the alert's region, and in-person rows at home inside the window."""
    h = cut(flags.select("alert_id", "card", F.col("addr1").alias("at"), "lo_us", "hi_us").join(home.select("card", "home_addr1"), "card", "left"))
    # only rows of an alert's card in its region or at home are read; both counts come from them
    wanted = (h.select("card", F.col("at").alias("addr1")).unionByName(h.select("card", F.col("home_addr1").alias("addr1")))
              .where(F.col("card").isNotNull() & F.col("addr1").isNotNull()).distinct())
    rows = txn.select("card", "addr1", "ts_us", "channel").join(if_small(cut(wanted)), ["card", "addr1"], "left_semi")
    ever = rows.groupBy("card", F.col("addr1").alias("at")).agg(F.count("*").alias("n_in_region_ever"))
    at_home = window_sums(h.select("alert_id", "card", F.col("home_addr1").alias("addr1"), "lo_us", "hi_us"), rows.where(F.col("channel") == "in_person"),
                          ["card", "addr1"], {"n_home_in_window": F.lit(1)}, ["alert_id"])
    out = h.join(ever, ["card", "at"], "left").join(at_home, "alert_id", "left")
    out = longs(out, "n_in_region_ever", "n_home_in_window")
    return (out.withColumn("had_prior_txn_in_region", F.col("n_in_region_ever") > 0)
            .select("alert_id", "home_addr1", "n_in_region_ever", "n_home_in_window", "had_prior_txn_in_region"))


def cluster(flags: DataFrame, txn: DataFrame, key: str, width_us: int = 14 * DAY_US) -> DataFrame:
    """Rows and distinct other cards that share ``key`` (region or recipient) in the window."""
    f = flags.where(F.col(key).isNotNull()).select("alert_id", "card", key, "lo_us", "hi_us")
    n = window_counts(f, txn.where(F.col(key).isNotNull()).select(key, "card", "ts_us"), [key], "card", width_us, "alert_id")
    out = longs(f.select("alert_id").join(n, "alert_id", "left"), "n_rows", "n_items", "n_own")
    return out.select("alert_id", F.col("n_rows").alias("n_txns"), (F.col("n_items") - one(F.col("n_own") > 0)).cast("long").alias("n_other_cards"))


def region_cluster(flags: DataFrame, txn: DataFrame) -> DataFrame:
    return cluster(flags, txn, "addr1")


def recipient_cluster(flags: DataFrame, txn: DataFrame) -> DataFrame:
    return cluster(flags, txn, "r_email")


def recurring_match(flags: DataFrame, txn: DataFrame, tol: float = 0.02, min_days: int = 20) -> DataFrame:
    """Rows of the card with the alert's product and amount: count, span, regions and cadence.

    Alerts are reduced to their distinct (card, product, amount) first. Both sides are keyed by
    an amount bucket too, and the gap statistics come from sums, not from a collected list.
    """
    band = tol + 0.0001
    width = max(2 * band, 0.01)
    asked = flags.select("card", "product_cd", F.col("amt").alias("x")).where(
        F.col("x").isNotNull() & F.col("product_cd").isNotNull()).distinct()
    b = lambda c: F.floor(c / width)
    p = asked.withColumn("_b", F.explode(F.sequence(b(F.col("x") - band), b(F.col("x") + band))))
    rows = txn.select("card", "product_cd", "amt", "addr1", "ts_us").withColumn("_b", b(F.col("amt")))
    m = p.join(rows, ["card", "product_cd", "_b"]).where(F.abs(F.col("amt") - F.col("x")) <= band)
    key = ["card", "product_cd", "x"]
    tot = m.groupBy(*key).agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
                              F.countDistinct("addr1").alias("n_regions"))
    gap = (F.col("ts_us") - F.col("prev_us")) / F.lit(1e6)
    sq = prior_time(m, key).groupBy(*key).agg(F.sum(gap * gap).alias("_sq"))
    g = tot.join(sq, key)
    span = ((F.col("last_us") - F.col("first_us")) / F.lit(1e6))
    mean = span / (F.col("n") - 1)
    var = F.greatest(F.coalesce("_sq", F.lit(0.0)) / (F.col("n") - 1) - mean * mean, F.lit(0.0))
    many = F.col("n") >= 2
    slots = F.when(many, F.floor(span / 2_629_800)).otherwise(0).cast("long")
    g = (g.withColumn("span_days", F.when(many, span / 86_400).otherwise(0.0))
         .withColumn("cadence_cv", F.when(many & (span > 0), F.sqrt(var) / mean).otherwise(-1.0))
         .withColumn("expected_slots", slots)
         .withColumn("missed_slots", F.when(many, F.greatest(slots + 1 - F.col("n"), F.lit(0))).otherwise(0).cast("long"))
         .withColumn("fires", many & (F.col("span_days") >= min_days)))
    j = flags.select("alert_id", "card", "product_cd", F.col("amt").alias("x")).join(g, key)
    return j.select("alert_id", "n", "first_us", "last_us", "n_regions", "span_days", "cadence_cv", "expected_slots",
                    "missed_slots", "fires")


def recurring_prior(txn: DataFrame, entity: str = "customer_id", tol: float = 0.02, ids: DataFrame | None = None) -> DataFrame:
    """For every row, earlier rows of the entity with the same product and nearly the same amount.

    Distinct amounts are paired inside buckets of the tolerance; rows then only count, on the
    time line of each paired amount, so equal amounts never multiply. With ``ids(txn_id)`` only these rows
    ask, and only the amounts they are paired with are read.
    """
    key = [entity, "product_cd"]
    rows = txn.where(F.col("amt").isNotNull() & F.col("product_cd").isNotNull()).select(*key, "amt", "txn_id", "ts_us")
    asking = rows if ids is None else cut(rows.join(ids.select("txn_id").distinct(), "txn_id", "left_semi"))
    bucket = lambda df: df.select(*key, "amt").distinct().withColumn("_b", F.floor(F.col("amt") / tol))
    near = bucket(asking).withColumn("_b", F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1)))
    other = bucket(rows).withColumnRenamed("amt", "v")
    pairs = near.join(other, [*key, "_b"]).where(F.abs(F.col("v") - F.col("amt")) < tol).select(*key, "amt", "v")
    probes = asking.join(pairs, [*key, "amt"]).select(
        *key, "v", "txn_id", F.lit(DISTANT_PAST).alias("lo_us"), (F.col("ts_us") - 1).alias("hi_us"))
    probes = probes if ids is None else cut(probes)
    n = window_sums(probes, rows.withColumnRenamed("amt", "v"), [*key, "v"], {"n_prior_same": F.lit(1)}, ["txn_id"], prune=ids is not None)
    return longs(n, "n_prior_same").withColumn("recurring_ge3", F.col("n_prior_same") >= 3)


def cases_touching(flags: DataFrame, txn: DataFrame, cc_card: DataFrame, cc_dev: DataFrame, cc_txn: DataFrame, region_cap: int | None = None) -> DataFrame:
    """Closed cases on the alert's card, device or region, with the leg that found them. ``region_cap`` leaves out regions with more rows; by default none is."""
    key = lambda df, i, c: df.select(i, F.col(c).alias("key"))
    by_card = key_pairs(key(flags, "alert_id", "card"), key(cc_card, "case_id", "card"), "alert_id", "case_id").withColumn("leg", F.lit("card"))
    by_dev = (key_pairs(key(flags, "alert_id", "device_profile"), key(cc_dev, "case_id", "device_profile"), "alert_id", "case_id")
              .withColumn("leg", F.lit("device")))
    by_reg = window_pairs(*region_windows(flags, txn, cc_txn, region_cap), "alert_id", "case_id").withColumn("leg", F.lit("region"))
    return by_card.unionByName(by_dev).unionByName(by_reg)


def region_windows(flags: DataFrame, txn: DataFrame, cc_txn: DataFrame, region_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(alert_id, key, lo_us, hi_us)`` and ``(case_id, key, ts_us)``: the region and window of each alert, the regions and times of each case's transactions.

    With ``region_cap`` only regions of at most so many rows.
    """
    probes = flags.where(F.col("addr1").isNotNull()).select("alert_id", F.col("addr1").alias("key"), "lo_us", "hi_us")
    rows = cc_txn.join(txn.select("txn_id", "addr1", "ts_us"), "txn_id").where(F.col("addr1").isNotNull()).select("case_id", F.col("addr1").alias("key"), "ts_us")
    if region_cap is None:
        return probes, rows
    size = txn.where(F.col("addr1").isNotNull()).groupBy(F.col("addr1").alias("key")).agg(F.count("*").alias("n_seen"))
    regs = cut(size.where(F.col("n_seen") <= region_cap).select("key"))
    return probes.join(regs, "key", "left_semi"), rows.join(regs, "key", "left_semi")


def near_threshold(flags: DataFrame, txn: DataFrame, threshold: float = 500.0, k: int = 3) -> DataFrame:
    hit = online() & (F.col("amt") < threshold) & (F.col("amt") >= threshold * 0.95)
    n = per_alert(flags, window_sums(flags, txn, ["card"], {"n": one(hit)}, ["alert_id"]), "n")
    return n.withColumn("fires", F.col("n") >= k)


def device_prior_fraud(flags: DataFrame, cj: DataFrame) -> DataFrame:
    """Confirmed-fraud cases on the alert's device closed before the alert opened."""
    return device_fraud(flags, cj).select("alert_id", "n_prior_fraud")


def device_fraud(flags: DataFrame, cj: DataFrame) -> DataFrame:
    """Confirmed-fraud cases, and other customers with one, on the alert's device before the alert opened: one time line answers both.

    A case counts from its first closing, a customer from the first case closed.
    """
    c = cj.where((F.col("outcome") == "confirmed_fraud") & F.col("device_profile").isNotNull())
    cases = c.groupBy("device_profile", "case_id").agg(F.min("closed_us").alias("ts_us"))
    people = cut(c.groupBy("device_profile", "customer_id").agg(F.min("closed_us").alias("ts_us")))
    one_line = (cases.select("device_profile", "ts_us", F.lit(1).alias("c"), F.lit(0).alias("p"))
                .unionByName(people.select("device_profile", "ts_us", F.lit(0).alias("c"), F.lit(1).alias("p"))))
    probes = flags.withColumn("hi_us", F.col("opened_us") - 1).withColumn("lo_us", F.lit(DISTANT_PAST))
    n = window_sums(probes, one_line, ["device_profile"], {"n_prior_fraud": F.col("c"), "n_all": F.col("p")}, ["alert_id"], prune=False)
    own = (probes.join(people.withColumnRenamed("ts_us", "_first"), ["device_profile", "customer_id"])
           .where(F.col("_first") <= F.col("hi_us")).select("alert_id", F.lit(1).alias("n_own")))
    out = per_alert(flags, n.join(own, "alert_id", "left"), "n_prior_fraud", "n_all", "n_own")
    return out.select("alert_id", "n_prior_fraud", (F.col("n_all") - F.col("n_own")).cast("long").alias("n_other_fraud"))


def device_other_new_or_proxied(flags: DataFrame, txn: DataFrame, days: int = 14) -> DataFrame:
    """Other customers with a new-device or proxied row on the device within ``days`` either side."""
    rows = txn.where(F.col("device_profile").isNotNull() & (F.coalesce(F.col("id_15") == "New", F.lit(False)) | proxied()))
    f = around(flags.where(F.col("device_profile").isNotNull()), days * DAY_US, "opened_us").select("alert_id", "customer_id", "device_profile", "lo_us", "hi_us")
    n = window_counts(f, rows.select("device_profile", "customer_id", "ts_us"), ["device_profile"], "customer_id", 2 * days * DAY_US, "alert_id")
    out = per_alert(flags, n, "n_items", "n_own")
    return out.select("alert_id", (F.col("n_items") - one(F.col("n_own") > 0)).cast("long").alias("n_other_new_or_proxied"))


def device_other_fraud(flags: DataFrame, cj: DataFrame) -> DataFrame:
    """Other customers with a confirmed-fraud case on the device closed before the alert opened."""
    return device_fraud(flags, cj).select("alert_id", "n_other_fraud")


def device_tiers(flags: DataFrame, degree: DataFrame, prior: DataFrame, others: DataFrame, fraud: DataFrame,
                 cap: int = 100) -> DataFrame:
    """Highest device tier of each alert and the bucket of its device's degree; hubs have no tier."""
    j = (flags.select("alert_id", "device_profile", proxied().alias("proxy_flag"))
         .join(degree, "device_profile", "left").join(prior, "alert_id", "left")
         .join(others, "alert_id", "left").join(fraud, "alert_id", "left"))
    j = longs(j, "degree", "n_prior_fraud", "n_other_new_or_proxied", "n_other_fraud")
    d = F.col("degree")
    bucket = F.when(d.between(1, 5), "le5").when(d.between(6, 20), "6-20").when(d.between(21, cap), "21-100")
    has = (F.col("n_prior_fraud") > 0) & bucket.isNotNull()
    tier = (F.when(~has, None).when(F.col("n_other_fraud") >= 2, "T4")
            .when(F.col("proxy_flag") & (F.col("n_other_new_or_proxied") >= 2), "T3")
            .when(F.col("proxy_flag"), "T2").otherwise("T1"))
    return j.select("alert_id", "degree", bucket.alias("bucket"), tier.alias("tier"), (d > cap).alias("is_hub"),
                    "proxy_flag", "n_prior_fraud", "n_other_new_or_proxied", "n_other_fraud")


def all_device_tiers(flags: DataFrame, txn: DataFrame, cj: DataFrame, known: DataFrame | None = None) -> DataFrame:
    known = known if known is not None else known_device(txn)
    fraud = cut(device_fraud(flags, cj))
    return device_tiers(flags, device_degree(known), fraud.select("alert_id", "n_prior_fraud"),
                        device_other_new_or_proxied(flags, txn), fraud.select("alert_id", "n_other_fraud"))


def prior_fraud_cards(flags: DataFrame, cj: DataFrame, verdicts: DataFrame | None = None, gate: int = 2) -> DataFrame:
    """Distinct cards of the customer with confirmed fraud before the alert, plus its own card when fraud."""
    c = cj.where((F.col("outcome") == "confirmed_fraud") & F.col("card").isNotNull())
    first = c.groupBy("customer_id", "card").agg(F.min("closed_us").alias("ts_us"))
    f = flags.withColumn("hi_us", F.col("opened_us") - 1).withColumn("lo_us", F.lit(DISTANT_PAST))
    n = window_sums(f, first, ["customer_id"], {"n_all": F.lit(1)}, ["alert_id"])
    own = window_sums(f, first, ["customer_id", "card"], {"n_own": F.lit(1)}, ["alert_id"])
    out = per_alert(flags, n.join(own, "alert_id", "left"), "n_all", "n_own")
    if verdicts is not None:
        out = out.join(verdicts.select("alert_id", "verdict"), "alert_id", "left")
        extra = one(F.coalesce(F.col("verdict") == "fraud", F.lit(False)) & (F.col("n_own") == 0))
    else:
        extra = F.lit(0)
    cards = (F.col("n_all") + extra).cast("long")
    return out.select("alert_id", cards.alias("n_fraud_cards"), (cards >= gate).alias("two_cards"))
