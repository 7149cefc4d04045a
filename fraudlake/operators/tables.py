"""Vertex and edge tables of the customer, card, device, region and case graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.operators import keys
from fraudlake.operators.baseline import home_region
from fraudlake.operators.pit import next_edges


def v_customer(txn: DataFrame) -> DataFrame:
    cards = txn.groupBy("customer_id", "card").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    return cards.groupBy("customer_id").agg(F.min("a").alias("first_us"), F.max("b").alias("last_us"),
                                            F.count("*").alias("n_cards"))


def v_card(txn: DataFrame, parts: list[str]) -> DataFrame:
    cmap = keys.card_map(txn)
    if not parts:
        return cmap.select("card", "card_id", "customer_id", "first_us", "last_us", "n")
    extra = txn.groupBy("card").agg(*[F.min(p).alias(p) for p in parts])
    return cmap.join(extra, "card").select("card", "card_id", "customer_id", *parts, "first_us", "last_us", "n")


def v_txn(txn: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    num = lambda c: F.coalesce(F.col(c), F.lit(-1.0)).alias(c)
    return txn.select(F.concat(F.lit("T"), F.col("txn_id").cast("string")).alias("vertex_id"), "txn_id", "ts_us",
                      *[text(c) for c in ("channel", "product_cd", "addr1", "device_profile", "id_15", "id_23",
                                          "p_email", "r_email")], num("amt"), num("risk_score"))


def v_device(txn: DataFrame) -> DataFrame:
    return txn.where(F.col("device_profile").isNotNull()).groupBy("device_profile").agg(
        F.count("*").alias("n_seen"), F.min("id_23").alias("proxy_hint"))


def v_email(txn: DataFrame) -> DataFrame:
    d = txn.select(F.explode(F.array("p_email", "r_email")).alias("domain"))
    return d.where(F.col("domain").isNotNull()).distinct()


def v_region(txn: DataFrame) -> DataFrame:
    return txn.where(F.col("addr1").isNotNull()).groupBy("addr1").agg(F.count("*").alias("n_seen"))


def v_product(txn: DataFrame) -> DataFrame:
    return txn.select("product_cd").where(F.col("product_cd").isNotNull()).distinct()


def v_case(cj: DataFrame) -> DataFrame:
    return cj.select("case_id", "customer_id", "card", F.unix_micros("opened_at").alias("opened_us"), "closed_us",
                     "outcome", "pattern", F.col("exposure_usd").cast("double").alias("exposure_usd"),
                     (F.col("report_filed") == "Yes").alias("report_filed"), keys.clean_note("analyst_notes").alias("notes"))


def e_owns(txn: DataFrame) -> DataFrame:
    return txn.select("customer_id", "card").distinct()


def edge(txn: DataFrame, src: str, dst: str) -> DataFrame:
    """Edge projection with a non-null target."""
    return txn.where(F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"))


def e_home_region(txn: DataFrame) -> DataFrame:
    return home_region(txn).select(F.col("card").alias("src"), F.col("home_addr1").alias("dst"), "n_home")


def known_device(txn: DataFrame) -> DataFrame:
    return (txn.where(F.col("device_profile").isNotNull()).groupBy("card", "device_profile")
            .agg(F.count("*").alias("n_seen"), F.min("ts_us").alias("first_us")))


def device_degree(known: DataFrame) -> DataFrame:
    return known.groupBy("device_profile").agg(F.count("*").alias("degree"))


def e_cc_involves(cases: DataFrame) -> DataFrame:
    return keys.explode_ids(cases)


def e_cc_on_card(cases: DataFrame, txn: DataFrame) -> DataFrame:
    first = txn.select(F.col("txn_id").alias("first_fraud_txn_id"), F.col("card").alias("_c"))
    return cases.join(first, "first_fraud_txn_id").select("case_id", F.col("_c").alias("card"))


def e_cc_connected(cases: DataFrame, cmap: DataFrame) -> DataFrame:
    """Connected cards by display id; ids no card carries drop out."""
    ids = keys.explode_ids(cases, "connected_card_ids", "card_id", numeric=False)
    return ids.join(cmap.select("card_id", "card"), "card_id").select("case_id", "card").distinct()


def e_cc_on_device(cases: DataFrame, txn: DataFrame) -> DataFrame:
    t = txn.where(F.col("device_profile").isNotNull()).select("txn_id", "device_profile")
    return keys.explode_ids(cases).join(t, "txn_id").select("case_id", "device_profile").distinct()


# Edge kinds of an investigated case and the array column each comes from.
MEMORY_EDGES = [
    ("C_ON_CARD", "cards"), ("C_ON_CUSTOMER", "customers"), ("C_INVOLVES", "txns"), ("C_CONNECTED_TO", "connected"),
    ("C_ON_DEVICE", "devices"), ("C_IN_REGION", "regions"), ("C_SIMILAR_TO_CLOSED", "similar"),
]


def memory_edges(cases: DataFrame) -> DataFrame:
    """One edge row for each target of each of the seven edge kinds; similarity edges score 1."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("array<string>").alias("dst"))
                      for k, c in MEMORY_EDGES])
    x = cases.select("case_id", F.explode(kinds).alias("e")).select("case_id", "e.kind", F.explode("e.dst").alias("dst"))
    score = F.when(F.col("kind") == "C_SIMILAR_TO_CLOSED", 1.0)
    return x.where(F.col("dst").isNotNull()).distinct().withColumn("score", score)


def graph_tables(txn: DataFrame, cases: DataFrame) -> dict[str, DataFrame]:
    """All vertex and edge tables; each is written by its own scan of its source."""
    cj = keys.case_join(cases, txn)
    out = {
        "v_customer": v_customer(txn), "v_txn": v_txn(txn), "v_device": v_device(txn), "v_email": v_email(txn),
        "v_region": v_region(txn), "v_product": v_product(txn), "v_card": v_card(txn, []), "v_case": v_case(cj),
        "e_owns": e_owns(txn), "e_made": edge(txn, "card", "txn_id"), "e_from_device": edge(txn, "txn_id", "device_profile"),
        "e_p_email": edge(txn, "txn_id", "p_email"), "e_r_email": edge(txn, "txn_id", "r_email"),
        "e_billed_in": edge(txn, "txn_id", "addr1"), "e_in_product": edge(txn, "txn_id", "product_cd"),
        "e_next": next_edges(txn), "e_home_region": e_home_region(txn), "e_known_device": known_device(txn),
        "e_cc_involves": e_cc_involves(cases), "e_cc_on_card": e_cc_on_card(cases, txn),
        "e_cc_on_customer": cases.select("case_id", "customer_id"), "e_cc_on_device": e_cc_on_device(cases, txn),
    }
    if "connected_card_ids" in cases.columns:
        out["e_cc_connected"] = e_cc_connected(cases, keys.card_map(txn))
    return out
