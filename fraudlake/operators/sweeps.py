"""Population sweeps: the risk-score monitor and the two undocumented-pattern scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.cols import HOUR_US, exact_mean
from fraudlake.operators import pit
from fraudlake.operators.timeline import window_sums


def new_device_bursts(txn: DataFrame, score: float = 0.9, n_online: int = 2) -> DataFrame:
    """High-score transactions on a device new to the card inside an online burst."""
    df = pit.pit_base(txn).withColumn("is_new_device", pit.flag_columns()["is_new_device"])
    return (df.where((F.col("risk_score") >= score) & F.col("is_new_device") & (F.col("n_online_48h") >= n_online))
            .select("txn_id", "card", "risk_score", F.col("n_online_48h").cast("long").alias("n_online_48h"),
                    F.lit("card_not_present_new_device").alias("pattern")))


def candidate_alerts(txn: DataFrame, known: DataFrame, lo_us: int, hi_us: int, score: float, n: int) -> DataFrame:
    """Top ``n`` scores of the period that are not alerts yet; the anti join runs before the limit."""
    rows = txn.where((F.col("risk_score") >= score) & F.col("ts_us").between(lo_us, hi_us))
    fresh = rows.join(known.select("txn_id"), "txn_id", "left_anti")
    return (fresh.orderBy(F.desc("risk_score"), F.desc("ts_us"), F.desc("txn_id")).limit(n)
            .select("txn_id", "ts_us", "channel", "customer_id", "card", "risk_score", "amt", "addr1"))


def sweep_device_rings(txn: DataFrame, degree: DataFrame, lo_us: int, hi_us: int, cap: int = 100,
                       min_entities: int = 3, entity: str = "customer_id", n: int = 10) -> DataFrame:
    """Narrow devices used by several entities in the period with at least one proxied row."""
    rows = txn.where((F.col("channel") == "online") & F.col("device_profile").isNotNull()
                     & F.col("ts_us").between(lo_us, hi_us))
    per = rows.groupBy("device_profile", entity).agg(
        F.sum(F.when(F.col("id_23").startswith("IP_PROXY:"), 1).otherwise(0)).alias("p"),
        F.min("ts_us").alias("f"), F.max("ts_us").alias("l"), F.count("*").alias("c"))
    agg = per.groupBy("device_profile").agg(
        F.count("*").alias("n_cards"), F.sum("p").alias("n_proxied_txns"), F.min("f").alias("first_us"),
        F.max("l").alias("last_us"), F.sum("c").alias("n_txns"))
    agg = agg.where((F.col("n_cards") >= min_entities) & (F.col("n_proxied_txns") >= 1))
    narrow = degree.where(F.col("degree") <= cap).select("device_profile")
    return (agg.join(narrow, "device_profile", "left_semi")
            .orderBy(F.desc("n_cards"), F.desc("n_proxied_txns"), "device_profile").limit(n))


def sweep_near_threshold(txn: DataFrame, lo_us: int, hi_us: int, thresholds: list[float], width: float = 20.0,
                         k: int = 3, hours: int = 48, entity: str = "customer_id", n: int = 10) -> DataFrame:
    """Entities whose online rows just below a threshold number ``k`` or more within one short span.

    A row falls into few bands, so each row is copied once for each band it is in.
    """
    rows = txn.where((F.col("channel") == "online") & F.col("ts_us").between(lo_us, hi_us))
    bands = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]),
                     lambda t: (F.col("amt") < t) & (F.col("amt") > t - width))
    agg = (rows.withColumn("threshold", F.explode(bands)).groupBy("threshold", entity)
           .agg(F.count("*").alias("n_below"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
                exact_mean("amt").alias("avg_amt"))
           .where((F.col("n_below") >= k) & (F.col("last_us") - F.col("first_us") < hours * HOUR_US)))
    w = Window.partitionBy("threshold").orderBy(F.desc("n_below"), entity)
    # the top-n report reads aggregated groups only; the cut below keeps n rows of each threshold
    return agg.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sweep_near_threshold_sliding(txn: DataFrame, lo_us: int, hi_us: int, thresholds: list[float],
                                 width: float = 20.0, k: int = 3, hours: int = 48,
                                 entity: str = "customer_id") -> DataFrame:
    """The same with any window of the given length: the largest count ending at one of the rows."""
    rows = txn.where((F.col("channel") == "online") & F.col("ts_us").between(lo_us, hi_us))
    bands = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]),
                     lambda t: (F.col("amt") < t) & (F.col("amt") > t - width))
    hit = rows.withColumn("threshold", F.explode(bands)).select(entity, "threshold", "txn_id", "ts_us")
    probes = hit.select(entity, "threshold", "txn_id", (F.col("ts_us") - hours * HOUR_US).alias("lo_us"),
                        F.col("ts_us").alias("hi_us"))
    sums = window_sums(probes, hit, [entity, "threshold"], {"n": F.lit(1)}, [entity, "threshold", "txn_id"])
    return (sums.groupBy("threshold", entity).agg(F.max("n").cast("long").alias("max_in_window"))
            .where(F.col("max_in_window") >= k))
