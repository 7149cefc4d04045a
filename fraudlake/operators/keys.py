"""Keys, enrichment, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, is_proxied


def explode_ids(cases: DataFrame, col: str = "txn_ids", out: str = "txn_id", numeric: bool = True) -> DataFrame:
    """Unpack a ``|``-packed list: one row for each distinct (case, id), blanks and bad numbers dropped."""
    v = F.trim("_x")
    x = cases.select("case_id", F.explode(F.split(col, r"\|")).alias("_x")).where(v != "")
    v = F.expr("try_cast(trim(_x) AS BIGINT)") if numeric else v
    return x.select("case_id", v.alias(out)).where(F.col(out).isNotNull()).distinct()


def fraud_ids(cases: DataFrame, outcome: str = "confirmed_fraud") -> DataFrame:
    return explode_ids(cases.where(F.col("outcome") == outcome)).select("txn_id").distinct()


def negatives(txn: DataFrame, ids: DataFrame) -> DataFrame:
    """Transactions outside the given set; an anti join, so NULL ids cannot empty the result."""
    return txn.join(ids, "txn_id", "left_anti")


def card_map(txn: DataFrame) -> DataFrame:
    """Cards with first and last use, count, and the display rank: newest first use first."""
    agg = txn.groupBy("customer_id", "card").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("first_us"), F.desc("n"), "card")
    k = agg.withColumn("k", F.row_number().over(w))
    return k.withColumn("card_id", F.concat("customer_id", F.lit("-K"), F.col("k").cast("string")))


def enrich(txn: DataFrame, identity: DataFrame, ids: DataFrame) -> DataFrame:
    """Join identity, build the device profile of online rows, flag proxies and fraud episodes."""
    part = lambda c: F.coalesce(F.col(c), F.lit("-"))
    j = txn.join(identity, "txn_id", "left")
    profile = F.when(F.col("channel") == "online",
                     F.concat_ws(" | ", part("device_info"), part("id_30"), part("id_31"), part("id_33")))
    flag = ids.select("txn_id", F.lit(True).alias("in_fraud_episode"))
    return (j.withColumn("device_profile", profile).withColumn("proxy_flag", is_proxied())
            .join(flag, "txn_id", "left")
            .withColumn("in_fraud_episode", F.coalesce("in_fraud_episode", F.lit(False))))


def resolve_cards(txn: DataFrame, ids: DataFrame) -> DataFrame:
    return txn.join(ids, "txn_id", "left_semi").select("customer_id", "card").distinct()


def emit_card_id(cmap: DataFrame, alert_ids: DataFrame, case_ids: DataFrame) -> DataFrame:
    """Display id by precedence: the alert's own, else a closed case's, else the rank rule.

    ``alert_ids(card, alert_card_id)`` and ``case_ids(card, case_card_id)``; several ids of
    one card are reduced to the smallest.
    """
    a = alert_ids.groupBy("card").agg(F.min("alert_card_id").alias("alert_card_id"))
    c = case_ids.groupBy("card").agg(F.min("case_card_id").alias("case_card_id"))
    j = cmap.select("card", "card_id").join(a, "card", "left").join(c, "card", "left")
    src = (F.when(F.col("alert_card_id").isNotNull(), "case_pack")
           .when(F.col("case_card_id").isNotNull(), "closed_case").otherwise("rule_E"))
    return j.select("card", F.coalesce("alert_card_id", "case_card_id", "card_id").alias("display_id"),
                    src.alias("source"))


def tuple_ids(rows: DataFrame, cmap: DataFrame, col: str = "card_id") -> DataFrame:
    """Map display ids to card keys; an unknown id stays as it is."""
    m = cmap.select(F.col("card_id").alias(col), F.col("card").alias("_key"))
    return rows.join(m, col, "left").withColumn("tuple_id", F.coalesce("_key", F.col(col))).drop("_key")


def case_join(cases: DataFrame, txn: DataFrame) -> DataFrame:
    """Closed cases with the card, device and region of their first transaction."""
    t = txn.select(F.col("txn_id").alias("first_fraud_txn_id"), F.col("card").alias("_card"),
                   "device_profile", "addr1")
    have = "card" in cases.columns
    j = cases.join(t, "first_fraud_txn_id", "left")
    card = F.coalesce("_card", "card") if have else F.col("_card")
    return (j.withColumn("card", card).drop("_card")
            .withColumn("closed_us", F.unix_micros("closed_at")))


def flagged_txn(cases: DataFrame) -> DataFrame:
    """The transaction a case starts from: its first fraud id, else the first packed id."""
    first = F.expr("nullif(trim(cast(first_fraud_txn_id AS STRING)), '')")
    raw = F.coalesce(first, F.trim(F.split("txn_ids", r"\|")[0]))
    out = cases.select("case_id", "outcome", raw.alias("_raw"))
    return (out.select("case_id", "outcome", F.expr("try_cast(_raw AS BIGINT)").alias("txn_id"))
            .where(F.col("txn_id").isNotNull()))


def alert_context(alerts: DataFrame, txn: DataFrame, days: int = 14) -> DataFrame:
    """Alerts with the attributes of their flagged transaction and the look-back window."""
    t = txn.select(F.col("txn_id").alias("flagged_txn_id"), "ts", "ts_us", "channel", "product_cd", "amt",
                   "risk_score", "addr1", "device_profile", "id_15", "id_23", "p_email", "r_email")
    opened = F.unix_micros("opened_at")
    return (alerts.join(t, "flagged_txn_id")
            .select("alert_id", "flagged_txn_id", "customer_id", "card", "opened_at", "trigger_type",
                    opened.alias("opened_us"), (opened - days * DAY_US).alias("lo_us"), opened.alias("hi_us"),
                    *[c for c in t.columns if c != "flagged_txn_id"]))


def compare_to_baseline(txn: DataFrame, base: DataFrame) -> DataFrame:
    """Each transaction against its card's baseline: robust z and four unseen-value flags."""
    b = base.select("card", "median_amt", "mad_amt", "home_addr1", "products_seen", "devices_seen", "emails_seen")
    j = txn.join(b, "card", "left")
    z = F.when(F.col("median_amt").isNotNull() & (F.col("mad_amt") != 0),
               (F.col("amt") - F.col("median_amt")) / (1.4826 * F.col("mad_amt")))
    seen = lambda arr, v: F.coalesce(F.array_contains(arr, F.col(v)), F.lit(False))
    online = F.col("channel") == "online"
    differs = F.col("addr1").isNotNull() & F.col("home_addr1").isNotNull() & (F.col("addr1") != F.col("home_addr1"))
    return j.select(
        "txn_id", z.alias("amt_z"),
        (online & F.col("device_profile").isNotNull() & ~seen("devices_seen", "device_profile")).alias("is_new_device"),
        differs.alias("is_out_of_home"),
        (F.col("product_cd").isNotNull() & ~seen("products_seen", "product_cd")).alias("is_unseen_product"),
        (online & F.col("p_email").isNotNull() & ~seen("emails_seen", "p_email")).alias("is_unseen_email"))


def device_family(identity: DataFrame) -> DataFrame:
    """Coarse device key: device model and browser, without system and screen."""
    part = lambda c: F.coalesce(F.col(c), F.lit("-"))
    return identity.withColumn("device_family", F.concat_ws("|", part("device_info"), part("id_31")))


def clean_note(col: str):
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"[\r\n]", " ")
