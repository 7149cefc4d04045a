"""Sources, keys, baselines and graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.operators import baseline, keys, tables
from fraudlake.plans.fixtures import KNOWN, Fixture
from fraudlake.plans.registry import query
from fraudlake.sources import io

T, C, CJ = ("txn",), ("closed_case",), ("cj",)
CMAP = """
SELECT *, concat(customer_id, '-K', CAST(k AS VARCHAR)) AS card_id FROM (
  SELECT customer_id, card, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n,
    row_number() OVER (PARTITION BY customer_id ORDER BY min(ts_us) DESC, count(*) DESC, card) AS k
  FROM txn GROUP BY customer_id, card)
"""
IDENTITY = """
SELECT event_id AS txn_id, CASE WHEN k % 7 = 0 THEN NULL ELSE concat('DI', CAST(user_id % 11 AS VARCHAR)) END AS device_info,
  concat('OS', CAST(k % 3 AS VARCHAR)) AS id_30, CASE WHEN k % 9 = 0 THEN NULL ELSE concat('B', CAST(k % 4 AS VARCHAR)) END AS id_31,
  CASE WHEN k % 2 = 0 THEN '1080p' END AS id_33
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE event_type NOT IN ('signup','view')
"""
# closed cases with packed display ids: two cards of the customer and one unknown id
LINKED = "SELECT *, concat(customer_id, '-K1| ', customer_id, '-K2||X-UNKNOWN') AS connected_card_ids FROM closed_case"


def identity(f: Fixture):
    return f._sql(IDENTITY, events=f.raw("events"))


def linked(f: Fixture):
    return f.cases.withColumn("connected_card_ids", F.concat("customer_id", F.lit("-K1| "), "customer_id", F.lit("-K2||X-UNKNOWN")))


@query("i01_parquet_scan", "SELECT channel, count(*) AS n, round(sum(amt), 4) AS total FROM txn GROUP BY channel", T)
def _(f):
    return f.txn.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("amt"), 4).alias("total"))


@query("i05_load_verification", """
SELECT 'v_customer' AS table_name, count(DISTINCT customer_id) AS n_expected, count(DISTINCT customer_id) AS n_loaded, TRUE AS ok FROM txn
UNION ALL SELECT 'v_product', count(DISTINCT product_cd), count(DISTINCT product_cd), TRUE FROM txn
UNION ALL SELECT 'e_from_device', count(device_profile), count(device_profile) - count(CASE WHEN device_profile = 'HUB' THEN 1 END), FALSE FROM txn
""", T)
def _(f):
    want = {"v_customer": tables.v_customer(f.txn), "v_product": tables.v_product(f.txn),
            "e_from_device": tables.edge(f.txn, "txn_id", "device_profile")}
    got = dict(want, e_from_device=want["e_from_device"].where("dst <> 'HUB'"))
    return io.graph_counts(want, got)


@query("i06_sampled_load", """
SELECT t.txn_id, t.device_profile FROM txn t JOIN (SELECT txn_id FROM txn ORDER BY txn_id LIMIT 500) h USING (txn_id)
WHERE t.device_profile IS NOT NULL
""", T)
def _(f):
    edges = f.txn.where(F.col("device_profile").isNotNull()).select("txn_id", "device_profile")
    return io.sample_graph(f.txn, edges, 500)[1]


MEMORY_SQL = """
SELECT case_id, 'C_ON_CARD' AS kind, card AS dst, CAST(NULL AS DOUBLE) AS score FROM cj
UNION SELECT case_id, 'C_ON_CUSTOMER', customer_id, NULL FROM cj
UNION SELECT case_id, 'C_INVOLVES', trim(x), NULL FROM (SELECT case_id, unnest(string_split(txn_ids, '|')) AS x FROM cj)
UNION SELECT case_id, 'C_CONNECTED_TO', concat(customer_id, '|0'), NULL FROM cj
UNION SELECT case_id, 'C_ON_DEVICE', device_profile, NULL FROM cj WHERE device_profile IS NOT NULL
UNION SELECT case_id, 'C_IN_REGION', addr1, NULL FROM cj WHERE addr1 IS NOT NULL
UNION SELECT case_id, 'C_SIMILAR_TO_CLOSED', 'CC-0000008', 1.0 FROM cj
"""


def memory_cases(f):
    one = lambda c: F.array(F.col(c))
    return f.cj.select("case_id", one("card").alias("cards"), one("customer_id").alias("customers"),
                       F.split("txn_ids", r"\|").alias("txns"), F.array(F.concat("customer_id", F.lit("|0"))).alias("connected"),
                       one("device_profile").alias("devices"), one("addr1").alias("regions"),
                       F.array(F.lit("CC-0000008")).alias("similar"))


@query("i10_case_memory_edges", MEMORY_SQL, CJ)
@query("e16_memory_edges", MEMORY_SQL, CJ)
def _(f):
    return tables.memory_edges(memory_cases(f))


@query("f01_explode_ids", "SELECT * FROM fraud_ids", ("fraud_ids",))
def _(f):
    return keys.fraud_ids(f.cases)


@query("f02_card_map", "SELECT * FROM cmap", T, {"cmap": CMAP})
def _(f):
    return keys.card_map(f.txn)


@query("f03_enrich", """
SELECT t.txn_id, CASE WHEN t.channel = 'online' THEN coalesce(i.device_info, '-') || ' | ' || coalesce(i.id_30, '-') || ' | ' ||
    coalesce(i.id_31, '-') || ' | ' || coalesce(i.id_33, '-') END AS device_profile,
  coalesce(t.id_23 LIKE 'IP_PROXY:%', FALSE) AS proxy_flag, t.txn_id IN (SELECT txn_id FROM fraud_ids) AS in_fraud_episode
FROM txn t LEFT JOIN identity i USING (txn_id)
""", ("txn", "fraud_ids"), {"identity": IDENTITY})
def _(f):
    return (keys.enrich(f.txn.drop("device_profile"), identity(f), f.fraud_ids)
            .select("txn_id", "device_profile", "proxy_flag", "in_fraud_episode"))


@query("f04_resolve_cards", "SELECT DISTINCT customer_id, card FROM txn WHERE txn_id IN (SELECT txn_id FROM fraud_ids)", ("txn", "fraud_ids"))
def _(f):
    return keys.resolve_cards(f.txn, f.fraud_ids)


@query("f05_display_ids", """
SELECT m.card, coalesce(a.id, c.id, m.card_id) AS display_id,
  CASE WHEN a.id IS NOT NULL THEN 'case_pack' WHEN c.id IS NOT NULL THEN 'closed_case' ELSE 'rule_E' END AS source
FROM cmap m LEFT JOIN (SELECT card, min(concat(alert_id, '-P')) AS id FROM alert GROUP BY card) a ON a.card = m.card
LEFT JOIN (SELECT card, min(concat(case_id, '-H')) AS id FROM cj GROUP BY card) c ON c.card = m.card
""", ("txn", "alert", "cj"), {"cmap": CMAP})
def _(f):
    return keys.emit_card_id(keys.card_map(f.txn),
                             f.alerts.select("card", F.concat("alert_id", F.lit("-P")).alias("alert_card_id")),
                             f.cj.select("card", F.concat("case_id", F.lit("-H")).alias("case_card_id")))


@query("f06_tuple_ids", """
SELECT a.alert_id, a.card_id, coalesce(m.card, a.card_id) AS tuple_id
FROM (SELECT alert_id, concat(customer_id, '-K', CAST(1 + flagged_txn_id % 3 AS VARCHAR)) AS card_id FROM alert) a
LEFT JOIN cmap m USING (card_id)
""", ("txn", "alert"), {"cmap": CMAP})
def _(f):
    rows = f.alerts.select("alert_id", F.expr("concat(customer_id, '-K', CAST(1 + flagged_txn_id % 3 AS STRING))").alias("card_id"))
    return keys.tuple_ids(rows, keys.card_map(f.txn)).select("alert_id", "card_id", "tuple_id")


@query("f07_case_join", "SELECT case_id, card, device_profile, addr1, closed_us FROM cj", CJ)
def _(f):
    return f.cj.select("case_id", "card", "device_profile", "addr1", "closed_us")


@query("f08_flagged_txn", "SELECT case_id, outcome, coalesce(first_fraud_txn_id, TRY_CAST(split_part(txn_ids, '|', 1) AS BIGINT)) AS txn_id FROM closed_case", C)
def _(f):
    return keys.flagged_txn(f.cases)


BASE_SQL = """
SELECT b.card, n_txns, first_us, last_us, mean_amt, max_amt, online_share, avg_gap_hours, median_amt, p95_amt, mad_amt, home_addr1, n_home,
  coalesce(array_to_string(regions, ','), '') AS regions_seen, coalesce(array_to_string(products, ','), '') AS products_seen,
  coalesce(array_to_string(devices, ','), '') AS devices_seen, coalesce(array_to_string(emails, ','), '') AS emails_seen,
  coalesce(array_to_string(rec, ','), '') AS recurring
FROM (SELECT card, count(*) AS n_txns, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(sum(CAST(amt AS DECIMAL(28,6))) AS DOUBLE) / count(amt) AS mean_amt, max(amt) AS max_amt,
    sum(CASE WHEN channel = 'online' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS online_share,
    median(amt) AS median_amt, quantile_cont(amt, 0.95) AS p95_amt,
    list_sort(list(DISTINCT addr1) FILTER (WHERE addr1 IS NOT NULL)) AS regions, list_sort(list(DISTINCT product_cd)) AS products,
    list_sort(list(DISTINCT device_profile) FILTER (WHERE device_profile IS NOT NULL)) AS devices,
    list_sort(list(DISTINCT p_email) FILTER (WHERE p_email IS NOT NULL)) AS emails FROM rowset GROUP BY card) b
LEFT JOIN (SELECT t.card, median(abs(amt - m)) AS mad_amt FROM rowset t JOIN (SELECT card, median(amt) AS m FROM rowset GROUP BY card) USING (card) GROUP BY t.card) USING (card)
LEFT JOIN (SELECT card, avg(gap) AS avg_gap_hours FROM (SELECT card, (ts_us - lag(ts_us) OVER (PARTITION BY card ORDER BY ts_us)) / 3.6e9 AS gap FROM rowset) GROUP BY card) USING (card)
LEFT JOIN (SELECT card, addr1 AS home_addr1, n AS n_home FROM (SELECT card, addr1, count(*) AS n, row_number() OVER (PARTITION BY card ORDER BY count(*) DESC, addr1) AS rk
   FROM rowset WHERE channel = 'in_person' AND addr1 IS NOT NULL GROUP BY card, addr1) WHERE rk = 1) USING (card)
LEFT JOIN (SELECT card, list_sort(list(DISTINCT product_cd || ':' || printf('%.2f', cents / 100.0))) AS rec FROM (
   SELECT card, product_cd, CAST(round(amt * 100) AS BIGINT) AS cents FROM rowset GROUP BY 1, 2, 3
   HAVING count(*) >= 2 AND max(ts_us) - min(ts_us) >= 2 * 86400000000) GROUP BY card) USING (card)
"""
BASE_ROUND = """SELECT card, n_txns, first_us, last_us, round(mean_amt, 6) AS mean_amt, max_amt, round(online_share, 6) AS online_share,
round(avg_gap_hours, 6) AS avg_gap_hours, round(median_amt, 6) AS median_amt, round(p95_amt, 6) AS p95_amt, round(mad_amt, 6) AS mad_amt,
home_addr1, n_home, regions_seen, products_seen, devices_seen, emails_seen, recurring FROM base"""
CLEAN = "SELECT * FROM txn WHERE txn_id NOT IN (SELECT txn_id FROM fraud_ids)"


def base_out(df):
    r = lambda c: F.round(c, 6).alias(c)
    s = lambda c: F.array_join(c, ",").alias(c)
    return df.select("card", "n_txns", "first_us", "last_us", r("mean_amt"), "max_amt", r("online_share"), r("avg_gap_hours"),
                     r("median_amt"), r("p95_amt"), r("mad_amt"), "home_addr1", "n_home", s("regions_seen"), s("products_seen"),
                     s("devices_seen"), s("emails_seen"), s("recurring"))


@query("a01_card_baseline", BASE_ROUND, T, {"rowset": "SELECT * FROM txn", "base": BASE_SQL})
def _(f):
    return base_out(baseline.card_baseline(f.txn, min_days=2))


@query("a02_clean_baseline", BASE_ROUND, ("txn", "fraud_ids"), {"rowset": CLEAN, "base": BASE_SQL})
def _(f):
    return base_out(baseline.card_baseline(f.txn, f.fraud_ids, min_days=2))


@query("a03_mean_gap", "SELECT card, round(avg_gap_hours, 6) AS avg_gap_hours FROM base", T, {"rowset": "SELECT * FROM txn", "base": BASE_SQL})
def _(f):
    return baseline.card_baseline(f.txn).select("card", F.round("avg_gap_hours", 6).alias("avg_gap_hours"))


@query("a04_home_region", "SELECT card, home_addr1, n_home FROM base WHERE home_addr1 IS NOT NULL", T, {"rowset": "SELECT * FROM txn", "base": BASE_SQL})
def _(f):
    return baseline.home_region(f.txn)


@query("a05_distinct_lists", "SELECT card, regions_seen, products_seen, devices_seen, emails_seen FROM base", T, {"rowset": "SELECT * FROM txn", "base": BASE_SQL})
def _(f):
    s = lambda c: F.array_join(c, ",").alias(c)
    return baseline.card_baseline(f.txn).select("card", s("regions_seen"), s("products_seen"), s("devices_seen"), s("emails_seen"))


@query("a06_recurring_pairs", """
SELECT card, product_cd, CAST(round(amt * 100) AS BIGINT) AS cents, count(*) AS n, round((max(ts_us) - min(ts_us)) / 8.64e10, 6) AS span_days
FROM txn GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND (max(ts_us) - min(ts_us)) / 8.64e10 >= 1
""", T)
def _(f):
    return baseline.recurring_pairs(f.txn, 2, 1.0).withColumn("span_days", F.round("span_days", 6))


@query("a07_card_profile", """
SELECT f.alert_id, f.flagged_txn_id, f.card, a.* EXCLUDE (card) FROM flag f JOIN (
  SELECT card, count(*) AS n_txns, CAST(sum(CASE WHEN channel = 'online' THEN 1 ELSE 0 END) AS BIGINT) AS n_online, count(DISTINCT addr1) AS n_regions,
    count(DISTINCT product_cd) AS n_products, count(DISTINCT device_profile) AS n_devices, count(DISTINCT p_email) AS n_emails FROM txn GROUP BY card) a ON a.card = f.card
""", ("txn", "flag"))
def _(f):
    return baseline.card_profile(f.txn, f.flags)


@query("a08_distinct_counts", "SELECT device_profile, count(DISTINCT customer_id) AS n_items FROM txn WHERE device_profile IS NOT NULL GROUP BY 1", T)
def _(f):
    return baseline.distinct_per_group(f.txn, "device_profile", "customer_id")


@query("a09_conditional_sums", """
SELECT card, count(*) FILTER (WHERE channel = 'online') AS n_online, count(*) FILTER (WHERE channel = 'in_person') AS n_in_person,
  count(*) FILTER (WHERE channel = 'online' AND id_15 = 'New') AS n_new_device,
  count(*) FILTER (WHERE channel = 'online' AND id_23 LIKE 'IP_PROXY:%') AS n_proxied FROM txn GROUP BY card
""", T)
def _(f):
    return baseline.channel_counts(f.txn)


@query("a10_having", "SELECT card, count(*) AS n, max(ts_us) - min(ts_us) AS span_us FROM txn GROUP BY card HAVING count(*) >= 30 AND max(ts_us) - min(ts_us) < 29.5 * 86400000000", T)
def _(f):
    g = f.txn.groupBy("card").agg(F.count("*").alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"))
    return g.where((F.col("n") >= 30) & (F.col("span_us") < 29.5 * 86_400_000_000))


@query("f09_compare_to_baseline", """
SELECT t.txn_id, round(CASE WHEN b.median_amt IS NOT NULL AND b.mad_amt <> 0 THEN (t.amt - b.median_amt) / (1.4826 * b.mad_amt) END, 6) AS amt_z,
  t.channel = 'online' AND t.device_profile IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rowset r WHERE r.card = t.card AND r.device_profile = t.device_profile) AS is_new_device,
  coalesce(t.addr1 <> b.home_addr1, FALSE) AS is_out_of_home,
  NOT EXISTS (SELECT 1 FROM rowset r WHERE r.card = t.card AND r.product_cd = t.product_cd) AS is_unseen_product,
  t.channel = 'online' AND t.p_email IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rowset r WHERE r.card = t.card AND r.p_email = t.p_email) AS is_unseen_email
FROM txn t LEFT JOIN base b USING (card)
""", ("txn", "fraud_ids"), {"rowset": CLEAN, "base": BASE_SQL})
def _(f):
    out = keys.compare_to_baseline(f.txn, baseline.card_baseline(f.txn, f.fraud_ids))
    return out.withColumn("amt_z", F.round("amt_z", 6))


@query("f10_negatives", "SELECT txn_id FROM txn WHERE txn_id NOT IN (SELECT txn_id FROM fraud_ids)", ("txn", "fraud_ids"))
def _(f):
    return keys.negatives(f.txn, f.fraud_ids).select("txn_id")


@query("f11_device_family", "SELECT txn_id, coalesce(device_info, '-') || '|' || coalesce(id_31, '-') AS device_family FROM identity", (), {"identity": IDENTITY})
def _(f):
    return keys.device_family(identity(f)).select("txn_id", "device_family")


@query("f12_time_window_filter", "SELECT txn_id, card FROM txn WHERE ts_us BETWEEN 1704153600000000 AND 1704326400000000", T)
def _(f):
    # 2024-01-02 to 2024-01-04; the bound on ``ts`` is what a Parquet scan can push down
    lo, hi = F.timestamp_micros(F.lit(1_704_153_600_000_000)), F.timestamp_micros(F.lit(1_704_326_400_000_000))
    return f.txn.where(F.col("ts").between(lo, hi)).select("txn_id", "card")


@query("f13_clean_notes", "SELECT turn, conv_id, replace(replace(coalesce(concat(text, chr(10), 'x'), ''), chr(13), ' '), chr(10), ' ') AS note FROM conversations")
def _(f):
    df = f.raw("conversations").withColumn("t", F.concat("text", F.lit("\nx")))
    return df.select("turn", "conv_id", keys.clean_note("t").alias("note"))


@query("v01_customer", "SELECT customer_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT card) AS n_cards FROM txn GROUP BY 1", T)
def _(f):
    return tables.v_customer(f.txn)


@query("v02_card", "SELECT m.card, m.card_id, m.customer_id, p.c2, m.first_us, m.last_us, m.n FROM cmap m JOIN (SELECT card, min(c2) AS c2 FROM txn GROUP BY card) p USING (card)", T, {"cmap": CMAP})
def _(f):
    return tables.v_card(f.txn, ["c2"])


@query("v03_transaction", """
SELECT concat('T', CAST(txn_id AS VARCHAR)) AS vertex_id, txn_id, ts_us, channel, product_cd, coalesce(addr1, '') AS addr1,
  coalesce(device_profile, '') AS device_profile, coalesce(id_15, '') AS id_15, coalesce(id_23, '') AS id_23, coalesce(p_email, '') AS p_email,
  coalesce(r_email, '') AS r_email, coalesce(amt, -1) AS amt, coalesce(risk_score, -1) AS risk_score FROM txn
""", T)
def _(f):
    return tables.v_txn(f.txn)


@query("v04_device", "SELECT device_profile, count(*) AS n_seen, min(id_23) AS proxy_hint FROM txn WHERE device_profile IS NOT NULL GROUP BY 1", T)
def _(f):
    return tables.v_device(f.txn)


@query("v05_email", "SELECT p_email AS domain FROM txn WHERE p_email IS NOT NULL UNION SELECT r_email FROM txn WHERE r_email IS NOT NULL", T)
def _(f):
    return tables.v_email(f.txn)


@query("v06_region", "SELECT addr1, count(*) AS n_seen FROM txn WHERE addr1 IS NOT NULL GROUP BY 1", T)
def _(f):
    return tables.v_region(f.txn)


@query("v07_product", "SELECT DISTINCT product_cd FROM txn", T)
def _(f):
    return tables.v_product(f.txn)


@query("v08_closed_case", "SELECT case_id, customer_id, card, epoch_us(opened_at) AS opened_us, closed_us, outcome, pattern, exposure_usd, report_filed = 'Yes' AS report_filed, analyst_notes AS notes FROM cj", CJ)
def _(f):
    return tables.v_case(f.cj)


@query("e01_owns", "SELECT DISTINCT customer_id, card FROM txn", T)
def _(f):
    return tables.e_owns(f.txn)


def _edge(name, src, dst):
    @query(name, f"SELECT {src} AS src, {dst} AS dst FROM txn WHERE {dst} IS NOT NULL", T)
    def _(f):
        return tables.edge(f.txn, src, dst)


for _n, _s, _d in (("e02_made", "card", "txn_id"), ("e03_from_device", "txn_id", "device_profile"), ("e04_purchaser_email", "txn_id", "p_email"),
                   ("e05_recipient_email", "txn_id", "r_email"), ("e06_billed_in", "txn_id", "addr1"), ("e07_in_product", "txn_id", "product_cd")):
    _edge(_n, _s, _d)


@query("e08_next", "SELECT src, dst, gap_secs FROM (SELECT lag(txn_id) OVER w AS src, txn_id AS dst, (ts_us - lag(ts_us) OVER w) / 1e6 AS gap_secs FROM txn WINDOW w AS (PARTITION BY card ORDER BY ts_us, txn_id)) WHERE src IS NOT NULL", T)
def _(f):
    return tables.next_edges(f.txn)


@query("e09_home_region", "SELECT card AS src, home_addr1 AS dst, n_home FROM base WHERE home_addr1 IS NOT NULL", T, {"rowset": "SELECT * FROM txn", "base": BASE_SQL})
def _(f):
    return tables.e_home_region(f.txn)


@query("e10_known_device", KNOWN, T)
def _(f):
    return f.known


@query("e11_cc_involves", "SELECT DISTINCT case_id, TRY_CAST(trim(x) AS BIGINT) AS txn_id FROM (SELECT case_id, unnest(string_split(txn_ids, '|')) AS x FROM closed_case)", C)
def _(f):
    return tables.e_cc_involves(f.cases)


@query("e12_cc_on_card", "SELECT c.case_id, t.card FROM closed_case c JOIN txn t ON t.txn_id = c.first_fraud_txn_id", ("closed_case", "txn"))
def _(f):
    return tables.e_cc_on_card(f.cases, f.txn)


@query("e13_cc_on_customer", "SELECT case_id, customer_id FROM closed_case", C)
def _(f):
    return f.cases.select("case_id", "customer_id")


CONNECTED = """
SELECT DISTINCT l.case_id, m.card FROM (SELECT case_id, trim(unnest(string_split(connected_card_ids, '|'))) AS card_id FROM linked) l JOIN cmap m USING (card_id)
"""
CC_DEV = """
SELECT DISTINCT x.case_id, t.device_profile FROM (SELECT case_id, TRY_CAST(trim(unnest(string_split(txn_ids, '|'))) AS BIGINT) AS txn_id FROM closed_case) x
JOIN txn t USING (txn_id) WHERE t.device_profile IS NOT NULL
"""


@query("e14_cc_connected", CONNECTED, ("txn", "closed_case"), {"cmap": CMAP, "linked": LINKED})
def _(f):
    return tables.e_cc_connected(linked(f), keys.card_map(f.txn))


@query("e15_cc_on_device", CC_DEV, ("txn", "closed_case"))
def _(f):
    return tables.e_cc_on_device(f.cases, f.txn)




@query("w16_top_row", "SELECT card, txn_id, amt, ts_us FROM txn QUALIFY row_number() OVER (PARTITION BY card ORDER BY amt DESC, ts_us, txn_id) = 1", T)
def _(f):
    """The largest transaction of every card; the earliest of equals."""
    return baseline.top_row(f.txn, "card", F.desc("amt"), "ts_us", "txn_id").select("card", "txn_id", "amt", "ts_us")
