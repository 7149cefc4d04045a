"""Neighbourhood, ring and component queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, HOUR_US
from fraudlake.operators import baseline, components, keys, neighbors, rings, tables
from fraudlake.plans.base_queries import BASE_SQL, CC_DEV, CMAP, CONNECTED, LINKED, linked
from fraudlake.plans.registry import query

H48, D14 = 48 * HOUR_US, 14 * DAY_US
TF = ("txn", "flag")
# one time span inside the data for the population-wide queries: 2024-01-05 to 2024-01-25
LO, HI = 1_704_412_800_000_000, 1_706_140_800_000_000


def cc_dev(f):
    return f.stored("cc_dev", lambda: tables.e_cc_on_device(f.cases, f.txn))


def cc_card(f):
    return f.stored("cc_card", lambda: tables.e_cc_on_card(f.cases, f.txn))


def cc_conn(f):
    return f.stored("cc_conn", lambda: tables.e_cc_connected(linked(f), keys.card_map(f.txn)))


def home(f):
    return f.stored("home", lambda: baseline.home_region(f.txn))


def verdicts(f):
    """A verdict and pattern for every alert, from its number; stands in for the decision stage."""
    v = F.expr("CASE flagged_txn_id % 4 WHEN 0 THEN 'fraud' WHEN 1 THEN 'legitimate' WHEN 2 THEN 'uncertain' ELSE 'fraud' END")
    p = F.expr("CASE flagged_txn_id % 5 WHEN 0 THEN 'undocumented' WHEN 1 THEN 'out_of_region_use' WHEN 2 THEN 'card_testing' "
               "WHEN 3 THEN 'card_not_present_new_device' ELSE 'none' END")
    return f.flags.withColumn("verdict", v).withColumn("pattern", p)


VERDICT_SQL = """SELECT *, CASE flagged_txn_id % 4 WHEN 0 THEN 'fraud' WHEN 1 THEN 'legitimate' WHEN 2 THEN 'uncertain' ELSE 'fraud' END AS verdict,
  CASE flagged_txn_id % 5 WHEN 0 THEN 'undocumented' WHEN 1 THEN 'out_of_region_use' WHEN 2 THEN 'card_testing' WHEN 3 THEN 'card_not_present_new_device' ELSE 'none' END AS pattern FROM flag"""


@query("g01_card_window", "SELECT f.alert_id, t.txn_id, t.amt FROM flag f JOIN txn t ON t.card = f.card AND t.ts_us BETWEEN f.lo_us AND f.hi_us", TF)
def _(f):
    return neighbors.card_window(f.flags, f.txn).select("alert_id", "txn_id", "amt")


@query("g02_burst_48h", f"""
SELECT f.alert_id, count(t.txn_id) AS n_online, count(t.txn_id) >= 2 AS fires FROM flag f
LEFT JOIN txn t ON t.card = f.card AND t.channel = 'online' AND t.ts_us BETWEEN f.opened_us - {H48} AND f.opened_us GROUP BY 1
""", TF)
def _(f):
    return neighbors.burst(f.flags, f.txn)


@query("g02_burst_members", f"SELECT f.alert_id, t.txn_id FROM flag f JOIN txn t ON t.card = f.card AND t.channel = 'online' AND t.ts_us BETWEEN f.opened_us - {H48} AND f.opened_us", TF)
def _(f):
    return neighbors.burst_members(f.flags, f.txn)


@query("g03_testing_sequence", """
SELECT alert_id, n_small, n_large, n_small >= 3 AND n_large >= 1 AS fires FROM (
SELECT f.alert_id, count(*) FILTER (WHERE t.channel = 'online' AND t.amt < 20) AS n_small, count(*) FILTER (WHERE t.channel = 'online' AND t.amt > 60) AS n_large
FROM flag f LEFT JOIN txn t ON t.card = f.card AND t.ts_us BETWEEN f.lo_us AND f.hi_us GROUP BY 1)
""", TF)
def _(f):
    return neighbors.testing_sequence(f.flags, f.txn, small=20.0, large=60.0)


@query("g03_testing_members", """
SELECT f.alert_id, t.txn_id, CASE WHEN t.amt < 5 THEN 'small' ELSE 'large' END AS kind FROM flag f
JOIN txn t ON t.card = f.card AND t.channel = 'online' AND t.ts_us BETWEEN f.lo_us AND f.hi_us AND (t.amt < 5 OR t.amt > 100)
""", TF)
def _(f):
    return neighbors.testing_members(f.flags, f.txn)


@query("g04_testing_ordered", f"""
SELECT l.txn_id, count(*) AS n_small FROM txn l JOIN txn s ON s.card = l.card AND s.channel = 'online' AND s.amt < 20
  AND s.ts_us < l.ts_us AND s.ts_us >= l.ts_us - {72 * HOUR_US}
WHERE l.channel = 'online' AND l.amt > 60 GROUP BY 1 HAVING count(*) >= 3
""", ("txn",))
def _(f):
    return neighbors.testing_sequence_ordered(f.txn, small=20.0, large=60.0, k=3, hours=72)


DN_SQL = """
SELECT f.alert_id, coalesce(d.degree, 0) AS degree, coalesce(n_txns, 0) AS n_txns, coalesce(n_cards, 0) AS n_cards,
  coalesce(n_other_cards, 0) AS n_other_cards, CASE WHEN d.degree <= 100 THEN coalesce(n_cases, 0) ELSE 0 END AS n_cases
FROM flag f LEFT JOIN deg d ON d.device_profile = f.device_profile
LEFT JOIN (SELECT g.alert_id, count(*) AS n_txns, count(DISTINCT t.card) AS n_cards, count(DISTINCT CASE WHEN t.card <> g.card THEN t.card END) AS n_other_cards
  FROM flag g JOIN deg h ON h.device_profile = g.device_profile AND h.degree <= 100
  JOIN txn t ON t.device_profile = g.device_profile AND t.ts_us BETWEEN g.lo_us AND g.hi_us GROUP BY 1) n USING (alert_id)
LEFT JOIN (SELECT device_profile, count(DISTINCT case_id) AS n_cases FROM ccdev GROUP BY 1) c ON c.device_profile = f.device_profile
WHERE f.device_profile IS NOT NULL
"""
TFD = ("txn", "flag", "deg", "closed_case")


@query("g05_device_neighbors", DN_SQL, TFD, {"ccdev": CC_DEV})
def _(f):
    return neighbors.device_neighbors(f.flags, f.txn, cc_dev(f), known=f.known)


PEERS_SQL = """SELECT DISTINCT g.alert_id, t.card FROM flag g JOIN deg h ON h.device_profile = g.device_profile AND h.degree <= 100
JOIN txn t ON t.device_profile = g.device_profile AND t.ts_us BETWEEN g.lo_us AND g.hi_us AND t.card <> g.card"""


@query("g05_device_peers", PEERS_SQL, TFD)
def _(f):
    return neighbors.device_peers(f.flags, f.txn, known=f.known)


BASE = {"rowset": "SELECT * FROM txn", "base": BASE_SQL}
RH_SQL = """
SELECT f.alert_id, b.home_addr1, (SELECT count(*) FROM txn t WHERE t.card = f.card AND t.addr1 = f.addr1) AS n_in_region_ever,
  (SELECT count(*) FROM txn t WHERE t.card = f.card AND t.channel = 'in_person' AND t.addr1 = b.home_addr1 AND t.ts_us BETWEEN f.lo_us AND f.hi_us) AS n_home_in_window,
  (SELECT count(*) FROM txn t WHERE t.card = f.card AND t.addr1 = f.addr1) > 0 AS had_prior_txn_in_region
FROM flag f LEFT JOIN base b ON b.card = f.card
"""


@query("g06_region_history", RH_SQL, TF, BASE)
def _(f):
    return neighbors.region_history(f.flags, f.txn, home(f))


def cluster_sql(key):
    return f"""
SELECT f.alert_id, count(t.txn_id) AS n_txns, count(DISTINCT CASE WHEN t.card <> f.card THEN t.card END) AS n_other_cards
FROM flag f LEFT JOIN txn t ON t.{key} = f.{key} AND t.ts_us BETWEEN f.lo_us AND f.hi_us WHERE f.{key} IS NOT NULL GROUP BY 1
"""


@query("g07_region_cluster", cluster_sql("addr1"), TF)
def _(f):
    return neighbors.region_cluster(f.flags, f.txn)


@query("g08_recipient_cluster", cluster_sql("r_email"), TF)
def _(f):
    return neighbors.recipient_cluster(f.flags, f.txn)


REC_SQL = """
SELECT alert_id, n, first_us, last_us, n_regions, round(CASE WHEN n >= 2 THEN span / 86400 ELSE 0 END, 6) AS span_days,
  round(CASE WHEN n >= 2 AND span > 0 THEN sd / mean_gap ELSE -1 END, 6) AS cadence_cv,
  CAST(CASE WHEN n >= 2 THEN floor(span / 2629800) ELSE 0 END AS BIGINT) AS expected_slots,
  CAST(CASE WHEN n >= 2 THEN greatest(0, floor(span / 2629800) + 1 - n) ELSE 0 END AS BIGINT) AS missed_slots,
  n >= 2 AND span >= 20 * 86400 AS fires
FROM (SELECT alert_id, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT addr1) AS n_regions,
    (max(ts_us) - min(ts_us)) / 1e6 AS span, stddev_pop(gap) AS sd, avg(gap) AS mean_gap
  FROM (SELECT f.alert_id, t.ts_us, t.addr1, (t.ts_us - lag(t.ts_us) OVER (PARTITION BY f.alert_id ORDER BY t.ts_us)) / 1e6 AS gap
    FROM flag f JOIN txn t ON t.card = f.card AND t.product_cd = f.product_cd AND abs(t.amt - f.amt) <= 2.5 + 0.0001) GROUP BY 1)
"""


@query("g09_recurring_match", REC_SQL, TF)
def _(f):
    out = neighbors.recurring_match(f.flags, f.txn, tol=2.5)
    return out.withColumn("span_days", F.round("span_days", 6)).withColumn("cadence_cv", F.round("cadence_cv", 6))


@query("g10_recurring_prior", """
SELECT t.txn_id, count(p.txn_id) AS n_prior_same, count(p.txn_id) >= 3 AS recurring_ge3 FROM txn t
LEFT JOIN txn p ON p.customer_id = t.customer_id AND p.product_cd = t.product_cd AND abs(p.amt - t.amt) < 2.5 AND p.ts_us < t.ts_us GROUP BY 1
""", ("txn",))
def _(f):
    return neighbors.recurring_prior(f.txn, tol=2.5)


TOUCH_SQL = """
SELECT f.alert_id, c.case_id, 'card' AS leg FROM flag f JOIN closed_case c ON c.card = f.card
UNION SELECT f.alert_id, d.case_id, 'device' FROM flag f JOIN ccdev d ON d.device_profile = f.device_profile
UNION SELECT f.alert_id, x.case_id, 'region' FROM flag f JOIN txn t ON t.addr1 = f.addr1 AND t.ts_us BETWEEN f.lo_us AND f.hi_us JOIN cctxn x ON x.txn_id = t.txn_id
"""
# the same without the regions of more than 1,300 rows
TOUCH_CAPPED = """
SELECT f.alert_id, c.case_id, 'card' AS leg FROM flag f JOIN closed_case c ON c.card = f.card
UNION SELECT f.alert_id, d.case_id, 'device' FROM flag f JOIN ccdev d ON d.device_profile = f.device_profile
UNION SELECT f.alert_id, x.case_id, 'region' FROM flag f JOIN (SELECT addr1 FROM txn GROUP BY addr1 HAVING count(*) <= 1300) r ON r.addr1 = f.addr1
  JOIN txn t ON t.addr1 = f.addr1 AND t.ts_us BETWEEN f.lo_us AND f.hi_us JOIN cctxn x ON x.txn_id = t.txn_id
"""
CC_TXN = "SELECT DISTINCT case_id, TRY_CAST(trim(x) AS BIGINT) AS txn_id FROM (SELECT case_id, unnest(string_split(txn_ids, '|')) AS x FROM closed_case)"


def touching(f):
    return neighbors.cases_touching(f.flags, f.txn, cc_card(f), cc_dev(f), keys.explode_ids(f.cases))


@query("g11_cases_touching", TOUCH_SQL, ("flag", "txn", "closed_case"), {"ccdev": CC_DEV, "cctxn": CC_TXN})
def _(f):
    return touching(f)


@query("g12_near_threshold", """
SELECT f.alert_id, count(t.txn_id) AS n, count(t.txn_id) >= 2 AS fires FROM flag f
LEFT JOIN txn t ON t.card = f.card AND t.channel = 'online' AND t.amt < 60 AND t.amt >= 60 * 0.95 AND t.ts_us BETWEEN f.lo_us AND f.hi_us GROUP BY 1
""", TF)
def _(f):
    return neighbors.near_threshold(f.flags, f.txn, 60.0, 2)


RINGS_SQL = f"""
SELECT t.device_profile, count(DISTINCT t.card) AS n_cards, count(*) FILTER (WHERE t.id_23 LIKE 'IP_PROXY:%') AS n_proxied, count(*) AS n_txns,
  any_value(d.degree) AS degree, count(DISTINCT t.card) >= 3 AS passes_threshold
FROM txn t JOIN deg d ON d.device_profile = t.device_profile AND d.degree <= 100
WHERE t.ts_us BETWEEN {LO} AND {HI} GROUP BY 1 HAVING count(*) FILTER (WHERE t.id_23 LIKE 'IP_PROXY:%') > 0
"""


@query("g13_proxy_rings", RINGS_SQL, ("txn", "deg"))
def _(f):
    return rings.proxy_rings(f.txn, f.known, LO, HI)


@query("g13_proxy_ring_counts", f"""
SELECT count(*) AS n_candidates, count(*) FILTER (WHERE degree <= 100) AS n_narrow, count(*) FILTER (WHERE degree <= 100 AND n_cards >= 3) AS n_passing
FROM (SELECT t.device_profile, any_value(d.degree) AS degree, count(DISTINCT t.card) AS n_cards FROM txn t JOIN deg d USING (device_profile)
  WHERE t.ts_us BETWEEN {LO} AND {HI} GROUP BY 1 HAVING count(*) FILTER (WHERE t.id_23 LIKE 'IP_PROXY:%') > 0)
""", ("txn", "deg"))
def _(f):
    return rings.proxy_ring_counts(f.txn, f.known, LO, HI)


FAMILY_SQL = "SELECT DISTINCT device_profile, concat('F', right(device_profile, 2)) AS device_family FROM known"


def families(f):
    return f.known.select("device_profile", F.expr("concat('F', right(device_profile, 2))").alias("device_family")).distinct()


USED_SQL = """SELECT DISTINCT f.alert_id, t.device_profile FROM flag f JOIN txn t ON t.card = f.card AND t.ts_us BETWEEN f.lo_us AND f.hi_us
JOIN deg d ON d.device_profile = t.device_profile AND d.degree <= {cap}"""
FAM_HOP = """SELECT * FROM used UNION SELECT DISTINCT u.alert_id, g.device_profile FROM used u JOIN fam a USING (device_profile) JOIN fam g ON g.device_family = a.device_family
JOIN (SELECT device_family FROM fam JOIN deg USING (device_profile) GROUP BY 1 HAVING sum(degree) <= {cap}) k ON k.device_family = g.device_family"""
RING_CASES_SQL = """SELECT DISTINCT r.alert_id, c.case_id, c.exposure_usd FROM ring_dev r JOIN ccdev USING (device_profile) JOIN closed_case c USING (case_id) WHERE c.outcome = 'confirmed_fraud'"""
RING_CARDS_SQL = """SELECT alert_id, card FROM flag UNION SELECT r.alert_id, k.card FROM ring_dev r JOIN known k USING (device_profile)
UNION SELECT r.alert_id, c.card FROM ring_cases r JOIN ccconn c USING (case_id) UNION SELECT r.alert_id, c.card FROM ring_cases r JOIN closed_case c USING (case_id)"""
RING_SQL = """
SELECT f.alert_id, coalesce(s.n_cards, 0) AS n_cards, coalesce(d.n_devices, 0) AS n_devices, coalesce(a.n_new, 0) AS n_new_device_cards,
  coalesce(a.n_prox, 0) AS n_proxied_cards, coalesce(a.n_txns, 0) AS n_ring_txns, round(coalesce(a.amt, 0), 2) AS ring_txn_exposure,
  coalesce(p.k, 0) AS n_closed_cases, round(coalesce(p.e, 0), 2) AS prior_fraud_exposure, coalesce(c.k, 0) AS n_ring_cases,
  round(coalesce(c.e, 0), 2) AS ring_case_exposure, round(coalesce(a.amt, 0) + coalesce(c.e, 0), 2) AS ring_exposure
FROM flag f LEFT JOIN (SELECT alert_id, count(*) AS n_cards FROM ring_cards GROUP BY 1) s USING (alert_id)
LEFT JOIN (SELECT alert_id, count(*) AS n_devices FROM ring_dev GROUP BY 1) d USING (alert_id)
LEFT JOIN (SELECT g.alert_id, count(DISTINCT CASE WHEN t.id_15 = 'New' THEN t.card END) AS n_new, count(DISTINCT CASE WHEN t.id_23 LIKE 'IP_PROXY:%' THEN t.card END) AS n_prox,
   count(*) AS n_txns, sum(t.amt) AS amt FROM flag g JOIN ring_dev r USING (alert_id) JOIN txn t ON t.device_profile = r.device_profile AND t.ts_us BETWEEN g.lo_us AND g.hi_us GROUP BY 1) a USING (alert_id)
LEFT JOIN (SELECT r.alert_id, count(*) AS k, sum(exposure_usd) AS e FROM ring_cards r JOIN closed_case c ON c.card = r.card AND c.outcome = 'confirmed_fraud' GROUP BY 1) p USING (alert_id)
LEFT JOIN (SELECT alert_id, count(*) AS k, sum(exposure_usd) AS e FROM ring_cases GROUP BY 1) c USING (alert_id)
"""
RV = ("txn", "flag", "deg", "known", "closed_case")


def ring_ctes(cap, fam=False):
    out = {"ccdev": CC_DEV, "cmap": CMAP, "linked": LINKED, "ccconn": CONNECTED, "fam": FAMILY_SQL, "used": USED_SQL.format(cap=cap)}
    out["ring_dev"] = FAM_HOP.format(cap=cap) if fam else "SELECT * FROM used"
    return {**out, "ring_cases": RING_CASES_SQL, "ring_cards": RING_CARDS_SQL}


def ring_out(df):
    for c in ("ring_txn_exposure", "prior_fraud_exposure", "ring_case_exposure", "ring_exposure"):
        df = df.withColumn(c, F.round(c, 2))
    return df


@query("g14_ring_components", RING_SQL, RV, ring_ctes(100))
def _(f):
    return ring_out(rings.ring_components(f.flags, f.txn, f.known, f.cj, cc_dev(f), cc_conn(f), cc_card(f)))


@query("g15_ring_family", RING_SQL, RV, ring_ctes(30, True))
def _(f):
    return ring_out(rings.ring_components(f.flags, f.txn, f.known, f.cj, cc_dev(f), cc_conn(f), cc_card(f), 30, families(f)))


@query("g16_device_degree", "SELECT device_profile, degree FROM deg", ("deg",))
def _(f):
    return tables.device_degree(f.known)


BFS = {
    "ne": "SELECT card, device_profile FROM known JOIN deg USING (device_profile) WHERE degree <= 4",
    "cc": "SELECT DISTINCT a.card AS x, b.card AS y FROM ne a JOIN ne b USING (device_profile)",
}
WCC_TXN_SQL = """
SELECT f.alert_id, r.size, coalesce(d.n_devices, 0) AS n_devices, least(r.lev + 1, 8) AS iterations,
  (SELECT count(*) FROM txn t JOIN dist q ON q.seed = f.card AND q.card = t.card WHERE t.ts_us BETWEEN f.lo_us AND f.hi_us) AS component_n_txns,
  round(coalesce((SELECT sum(t.amt) FROM txn t JOIN dist q ON q.seed = f.card AND q.card = t.card WHERE t.ts_us BETWEEN f.lo_us AND f.hi_us), 0), 2) AS component_exposure
FROM flag f JOIN (SELECT seed, count(*) AS size, max(lev) AS lev FROM dist GROUP BY 1) r ON r.seed = f.card
LEFT JOIN (SELECT seed, count(DISTINCT device_profile) AS n_devices FROM dist JOIN ne USING (card) WHERE lev < 8 GROUP BY 1) d ON d.seed = f.card
"""
BFS_VIEWS = ("txn", "flag", "known", "deg")
DIST = """SELECT seed, card, min(lev) AS lev FROM (WITH RECURSIVE reach(seed, card, lev) AS (
  SELECT DISTINCT card, card, 0 FROM flag UNION SELECT r.seed, c.y, r.lev + 1 FROM reach r JOIN cc c ON c.x = r.card WHERE r.lev < 8)
  SELECT * FROM reach) GROUP BY 1, 2"""


@query("g17_ring_wcc", WCC_TXN_SQL, BFS_VIEWS, {**BFS, "dist": DIST})
def _(f):
    return components.ring_wcc(f.flags, f.known, f.txn, cap=4).withColumn("component_exposure", F.round("component_exposure", 2))


# customers and parts bought at least twice
PAIRS = "SELECT o_custkey AS card, l_partkey AS device_profile FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) >= 2"
WCC_SQL = """
SELECT concat('c:', CAST(card AS VARCHAR)) AS node, min(lab) AS label FROM (SELECT x AS card, n AS lab FROM reach) GROUP BY 1
"""


def purchase_edges(f):
    o = f.raw("orders").select("o_orderkey", "o_custkey")
    li = f.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return (o.join(li, "o_orderkey").groupBy(F.col("o_custkey").alias("card"), F.col("l_partkey").alias("device_profile"))
            .agg(F.count("*").alias("n")).where("n >= 2").select("card", "device_profile"))


REACH = {
    "pairs": PAIRS,
    "steps": "SELECT DISTINCT a.card AS x, b.card AS y FROM pairs a JOIN pairs b USING (device_profile)",
    "near": """WITH RECURSIVE r(x, y) AS (SELECT x, y FROM steps UNION SELECT r.x, s.y FROM r JOIN steps s ON s.x = r.y) SELECT x, y FROM r""",
}


@query("g18_global_wcc", "SELECT concat('c:', CAST(x AS VARCHAR)) AS node, min(concat('c:', CAST(y AS VARCHAR))) AS label FROM near GROUP BY 1", (), REACH)
def _(f):
    labels = components.wcc(purchase_edges(f))
    return labels.where(F.col("node").startswith("c:"))


@query("g18_component_sizes", """
SELECT label, count(*) AS n_cards, CAST(any_value(n_dev) AS BIGINT) AS n_devices FROM (
 SELECT x, min(concat('c:', CAST(y AS VARCHAR))) AS label FROM near GROUP BY 1) l
JOIN (SELECT label, count(DISTINCT device_profile) AS n_dev FROM (SELECT x, min(concat('c:', CAST(y AS VARCHAR))) AS label FROM near GROUP BY 1) q JOIN pairs ON pairs.card = q.x GROUP BY 1) d USING (label)
GROUP BY label
""", (), REACH)
def _(f):
    return components.component_sizes(components.wcc(purchase_edges(f)))


@query("g18_alert_components", """
SELECT f.alert_id, greatest(coalesce(s.n_cards, 1), 1) AS n_cards, coalesce(s.n_devices, 0) AS n_devices FROM flag f
LEFT JOIN (SELECT DISTINCT x, label FROM lab) l ON l.x = f.card
LEFT JOIN (SELECT label, count(DISTINCT x) AS n_cards, count(DISTINCT device_profile) AS n_devices FROM lab JOIN wide ON wide.card = lab.x GROUP BY 1) s USING (label)
""", ("txn", "flag", "known", "deg"), {
    "wide": "SELECT card, device_profile FROM known JOIN deg USING (device_profile) WHERE degree <= 100",
    "steps": "SELECT DISTINCT a.card AS x, b.card AS y FROM wide a JOIN wide b USING (device_profile)",
    # the smallest card of each component, by passing labels on until none changes
    "lab": """WITH RECURSIVE r(x, y) AS (SELECT x, min(y) FROM steps GROUP BY 1 UNION SELECT s.y, r.y FROM r JOIN steps s ON s.x = r.x WHERE r.y < s.y)
      SELECT x, min(y) AS label FROM r GROUP BY 1"""})
def _(f):
    return components.alert_components(f.flags, components.wcc(components.narrow_edges(f.known, 100)))


PF_SQL = "SELECT f.alert_id, count(DISTINCT c.case_id) AS n_prior_fraud FROM flag f LEFT JOIN cj c ON c.device_profile = f.device_profile AND c.outcome = 'confirmed_fraud' AND c.closed_us < f.opened_us GROUP BY 1"
NP_SQL = f"""SELECT f.alert_id, count(DISTINCT t.customer_id) AS n_other_new_or_proxied FROM flag f LEFT JOIN txn t ON t.device_profile = f.device_profile AND t.customer_id <> f.customer_id
AND t.ts_us BETWEEN f.opened_us - {D14} AND f.opened_us + {D14} AND (t.id_15 = 'New' OR t.id_23 LIKE 'IP_PROXY:%') GROUP BY 1"""
OF_SQL = "SELECT f.alert_id, count(DISTINCT c.customer_id) AS n_other_fraud FROM flag f LEFT JOIN cj c ON c.device_profile = f.device_profile AND c.customer_id <> f.customer_id AND c.outcome = 'confirmed_fraud' AND c.closed_us < f.opened_us GROUP BY 1"
TFC = ("txn", "flag", "cj", "deg")


@query("g19_device_prior_fraud", PF_SQL, TFC)
def _(f):
    return neighbors.device_prior_fraud(f.flags, f.cj)


@query("g20_device_other_new_or_proxied", NP_SQL, TFC)
def _(f):
    return neighbors.device_other_new_or_proxied(f.flags, f.txn)


@query("g21_device_other_fraud", OF_SQL, TFC)
def _(f):
    return neighbors.device_other_fraud(f.flags, f.cj)


TIER_SQL = """
SELECT f.alert_id, coalesce(d.degree, 0) AS degree,
  CASE WHEN d.degree <= 5 THEN 'le5' WHEN d.degree <= 20 THEN '6-20' WHEN d.degree <= 100 THEN '21-100' END AS bucket,
  CASE WHEN n_prior_fraud = 0 OR d.degree IS NULL OR d.degree > 100 THEN NULL WHEN n_other_fraud >= 2 THEN 'T4'
    WHEN coalesce(f.id_23 LIKE 'IP_PROXY:%', FALSE) AND n_other_new_or_proxied >= 2 THEN 'T3' WHEN coalesce(f.id_23 LIKE 'IP_PROXY:%', FALSE) THEN 'T2' ELSE 'T1' END AS tier,
  coalesce(d.degree, 0) > 100 AS is_hub, coalesce(f.id_23 LIKE 'IP_PROXY:%', FALSE) AS proxy_flag, n_prior_fraud, n_other_new_or_proxied, n_other_fraud
FROM flag f LEFT JOIN deg d ON d.device_profile = f.device_profile JOIN pf USING (alert_id) JOIN np USING (alert_id) JOIN off USING (alert_id)
"""
TIERS = {"pf": PF_SQL, "np": NP_SQL, "off": OF_SQL, "tiers": TIER_SQL}


@query("g22_device_tiers", "SELECT * FROM tiers", TFC, TIERS)
def _(f):
    return neighbors.all_device_tiers(f.flags, f.txn, f.cj, f.known)


RISK_SQL = """SELECT DISTINCT g.alert_id, t.card FROM flag g JOIN ring_dev r USING (alert_id) JOIN txn t ON t.device_profile = r.device_profile AND t.ts_us BETWEEN g.lo_us AND g.hi_us
  WHERE t.id_15 = 'New' OR t.id_23 LIKE 'IP_PROXY:%' UNION SELECT r.alert_id, c.card FROM ring_cases r JOIN ccconn c USING (case_id)"""
REGPEER_SQL = "SELECT DISTINCT f.alert_id, t.card FROM flag f JOIN txn t ON t.addr1 = f.addr1 AND t.ts_us BETWEEN f.lo_us AND f.hi_us AND t.card <> f.card"
CONN_SQL = """
SELECT alert_id, card, leg, rank FROM (SELECT alert_id, card, leg, row_number() OVER (PARTITION BY alert_id ORDER BY leg, card) AS rank FROM (
  SELECT e.alert_id, e.card, CAST(min(leg) AS INT) AS leg FROM (
    SELECT r.alert_id, r.card, 1 AS leg FROM risk r JOIN flag f USING (alert_id) JOIN deg d ON d.device_profile = f.device_profile AND d.degree <= 100
    UNION ALL SELECT p.*, 2 FROM peers p WHERE alert_id IN (SELECT alert_id FROM peers GROUP BY 1 HAVING count(*) >= 2)
    UNION ALL SELECT q.*, 3 FROM regpeer q WHERE alert_id IN (SELECT alert_id FROM regpeer GROUP BY 1 HAVING count(*) >= 2)) e
  JOIN flag f USING (alert_id) WHERE e.card <> f.card GROUP BY 1, 2)) WHERE rank <= 25
"""
CONN = {**ring_ctes(100), "risk": RISK_SQL, "peers": PEERS_SQL, "regpeer": REGPEER_SQL, "conn": CONN_SQL}


def connected(f):
    return f.stored("connected", lambda: _connected(f))


def _connected(f):
    risk = rings.ring_risk_cards(f.flags, f.txn, f.known, f.cj, cc_dev(f), cc_conn(f), cc_card(f))
    return rings.connected_cards(f.flags, risk, tables.device_degree(f.known), neighbors.device_peers(f.flags, f.txn, known=f.known),
                                 rings.region_peers(f.flags, f.txn))


@query("g23_connected_cards", "SELECT * FROM conn", RV, CONN)
def _(f):
    return connected(f)


@query("g24_shared_element", """
SELECT f.alert_id, coalesce(c.n, 0) AS n_connected, CASE WHEN coalesce(c.n, 0) >= 2 OR (t.n_prior_fraud > 0 AND t.degree <= 100) THEN 'device'
  WHEN r.n_other_cards >= 2 THEN 'region' WHEN m.n_other_cards >= 2 THEN 'recipient' END AS shared_element
FROM flag f LEFT JOIN (SELECT alert_id, count(*) AS n FROM conn GROUP BY 1) c USING (alert_id) LEFT JOIN tiers t USING (alert_id)
LEFT JOIN reg r USING (alert_id) LEFT JOIN rec m USING (alert_id)
""", (*RV, "cj"), {**CONN, **TIERS, "reg": cluster_sql("addr1"), "rec": cluster_sql("r_email")})
def _(f):
    return rings.shared_element(f.flags, connected(f), tier_table(f),
                                neighbors.region_cluster(f.flags, f.txn), neighbors.recipient_cluster(f.flags, f.txn))


@query("g25_prior_fraud_cards", """
SELECT alert_id, n_fraud_cards, n_fraud_cards >= 2 AS two_cards FROM (
  SELECT v.alert_id, count(DISTINCT c.card) + CASE WHEN v.verdict = 'fraud' AND NOT bool_or(coalesce(c.card = v.card, FALSE)) THEN 1 ELSE 0 END AS n_fraud_cards
  FROM v LEFT JOIN cj c ON c.customer_id = v.customer_id AND c.outcome = 'confirmed_fraud' AND c.closed_us < v.opened_us GROUP BY v.alert_id, v.verdict)
""", ("flag", "cj"), {"v": VERDICT_SQL})
def _(f):
    return neighbors.prior_fraud_cards(f.flags, f.cj, verdicts(f))


@query("g26_neighborhood", """
SELECT f.alert_id, 'alert' AS parent, CASE WHEN d.degree > 100 THEN 'hub' ELSE 'device' END AS kind, f.device_profile AS node, 1 AS n_total FROM flag f JOIN deg d ON d.device_profile = f.device_profile
UNION ALL SELECT alert_id, 'device', 'card', card, n FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY card) AS rk, count(*) OVER (PARTITION BY alert_id) AS n FROM peers) WHERE rk <= 40
UNION ALL SELECT alert_id, 'device', 'closed_case', case_id, n FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY case_id) AS rk, count(*) OVER (PARTITION BY alert_id) AS n FROM (
  SELECT DISTINCT f.alert_id, x.case_id FROM flag f JOIN deg d ON d.device_profile = f.device_profile AND d.degree <= 100 JOIN ccdev x ON x.device_profile = f.device_profile
  JOIN closed_case c ON c.case_id = x.case_id AND c.outcome = 'confirmed_fraud')) WHERE rk <= 8
""", RV, {"ccdev": CC_DEV, "peers": PEERS_SQL})
def _(f):
    return rings.neighborhood(f.flags, f.txn, f.known, f.cj, cc_dev(f))


def ring_table(f):
    return f.stored("rings", lambda: rings.ring_components(f.flags, f.txn, f.known, f.cj, cc_dev(f), cc_conn(f), cc_card(f)))


def tier_table(f):
    return f.stored("tiers", lambda: neighbors.all_device_tiers(f.flags, f.txn, f.cj, f.known))
