"""Per-card baselines, distinct-value lists, recurring pairs and card profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, HOUR_US, exact_mean


def amount_stats(txn: DataFrame) -> DataFrame:
    """Median, deviation from the median and 95th percentile from (card, amount) counts.

    Counting equal amounts first spreads a hot card over its amounts; the exact
    percentiles then read one row for each distinct amount.
    """
    hist = txn.where(F.col("amt").isNotNull()).groupBy("card", "amt").agg(F.count("*").alias("_n"))
    med = hist.groupBy("card").agg(
        F.expr("percentile(amt, 0.5D, _n)").alias("median_amt"),
        F.expr("percentile(amt, 0.95D, _n)").alias("p95_amt"))
    dev = hist.join(med.select("card", "median_amt"), "card")
    mad = dev.groupBy("card").agg(F.expr("percentile(abs(amt - median_amt), 0.5D, _n)").alias("mad_amt"))
    return med.join(mad, "card")


def home_region(txn: DataFrame) -> DataFrame:
    """Most used in-person region with its count; the smaller region wins ties."""
    n = (txn.where((F.col("channel") == "in_person") & F.col("addr1").isNotNull())
         .groupBy("card", "addr1").agg(F.count("*").alias("n_home")))
    w = Window.partitionBy("card").orderBy(F.desc("n_home"), "addr1")
    # one row for each (card, region) reaches this window
    return (n.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("card", F.col("addr1").alias("home_addr1"), "n_home"))


def recurring_pairs(txn: DataFrame, min_n: int = 2, min_days: float = 20.0) -> DataFrame:
    """(product, amount in cents) groups seen often enough over a long enough span."""
    g = (txn.groupBy("card", "product_cd", F.round(F.col("amt") * 100).cast("long").alias("cents"))
         .agg(F.count("*").alias("n"), ((F.max("ts_us") - F.min("ts_us")) / DAY_US).alias("span_days")))
    return g.where((F.col("n") >= min_n) & (F.col("span_days") >= min_days))


def _values(col: str):
    """Sorted distinct non-null values; the set is built on the map side first."""
    return F.array_sort(F.collect_set(col))


def card_baseline(txn: DataFrame, exclude: DataFrame | None = None, min_n: int = 2,
                  min_days: float = 20.0) -> DataFrame:
    """Baseline row for each card; ``exclude(txn_id)`` removes rows of fraud episodes first."""
    if exclude is not None:
        txn = txn.join(exclude, "txn_id", "left_anti")
    online = F.sum(F.when(F.col("channel") == "online", 1).otherwise(0))
    base = txn.groupBy("card").agg(
        F.count("*").alias("n_txns"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        exact_mean("amt").alias("mean_amt"), F.max("amt").alias("max_amt"), (online / F.count("*")).alias("online_share"),
        # the mean of consecutive gaps telescopes
        F.when(F.count("*") > 1, (F.max("ts_us") - F.min("ts_us")) / (F.count("*") - 1) / HOUR_US).alias("avg_gap_hours"),
        _values("addr1").alias("regions_seen"), _values("product_cd").alias("products_seen"),
        _values("device_profile").alias("devices_seen"), _values("p_email").alias("emails_seen"))
    rec = recurring_pairs(txn, min_n, min_days)
    label = F.concat_ws(":", "product_cd", F.format_string("%.2f", F.col("cents") / 100))
    rec = rec.groupBy("card").agg(F.array_sort(F.collect_set(label)).alias("recurring"))
    return (base.join(amount_stats(txn), "card", "left").join(home_region(txn), "card", "left")
            .join(rec, "card", "left")
            .withColumn("recurring", F.coalesce("recurring", F.array().cast("array<string>"))))


def card_profile(txn: DataFrame, flags: DataFrame) -> DataFrame:
    """Activity counters of each alert's card, computed once for a card."""
    cards = flags.select("card").distinct()
    agg = txn.join(cards, "card", "left_semi").groupBy("card").agg(
        F.count("*").alias("n_txns"), F.sum(F.when(F.col("channel") == "online", 1).otherwise(0)).alias("n_online"),
        F.countDistinct("addr1").alias("n_regions"), F.countDistinct("product_cd").alias("n_products"),
        F.countDistinct("device_profile").alias("n_devices"), F.countDistinct("p_email").alias("n_emails"))
    return flags.select("alert_id", "flagged_txn_id", "card").join(agg, "card", "left")


def distinct_per_group(df: DataFrame, group: str, item: str, approx: bool = False) -> DataFrame:
    """Distinct items of each group, exact or by sketch."""
    fn = F.approx_count_distinct(item) if approx else F.count_distinct(F.col(item))
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(fn.alias("n_items"))


def channel_counts(txn: DataFrame) -> DataFrame:
    """Conditional sums: rows by channel, new devices and proxied rows."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    online = F.col("channel") == "online"
    return txn.groupBy("card").agg(
        one(online).alias("n_online"), one(F.col("channel") == "in_person").alias("n_in_person"),
        one(online & (F.col("id_15") == "New")).alias("n_new_device"),
        one(online & F.col("id_23").startswith("IP_PROXY:")).alias("n_proxied"))


def top_row(df: DataFrame, group: str, *order) -> DataFrame:
    """First row of each group in the given order; every task sends on at most one row of a group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
