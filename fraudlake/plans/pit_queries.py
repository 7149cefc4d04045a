"""Window and point-in-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, HOUR_US
from fraudlake.operators import pit, sweeps
from fraudlake.operators.rolling import rolling_median
from fraudlake.plans.registry import query

ROWS = "(PARTITION BY card ORDER BY ts_us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def rng(us: int) -> str:
    return f"(PARTITION BY card ORDER BY ts_us RANGE BETWEEN {us} PRECEDING AND 1000000 PRECEDING)"


W90, W48, W24 = rng(90 * DAY_US), rng(48 * HOUR_US), rng(24 * HOUR_US)
# The reference point-in-time row, written as plain SQL. Home region: running mode, earliest first seen wins.
PIT_SQL = f"""
SELECT b.*,
  CASE WHEN n_prior >= 5 AND channel = 'online' AND device_profile IS NOT NULL THEN rn_dev = 1 END AS is_new_device,
  CASE WHEN n_prior >= 5 THEN rn_prod = 1 END AS unseen_product,
  CASE WHEN n_prior >= 5 AND channel = 'online' AND p_email IS NOT NULL THEN rn_mail = 1 END AS unseen_email,
  CASE WHEN n_prior_90d < 5 OR prior_mad IS NULL OR prior_mad = 0 THEN NULL
       ELSE (amt - prior_median) / (1.4826 * prior_mad) END AS amt_z,
  n_online_24h > 0 AND n_in_person_24h > 0 AS mixed_24h,
  CASE WHEN n_online_48h >= 5 THEN '5+' WHEN n_online_48h >= 2 THEN '2-4' WHEN n_online_48h = 1 THEN '1' ELSE '0' END AS burst_bucket,
  coalesce(id_23 LIKE 'IP_PROXY:%', FALSE) AS proxy_flag
FROM (
  SELECT w.*, median(abs(amt - prior_median)) OVER {W90} AS prior_mad
  FROM (
    SELECT t.*, count(*) OVER {ROWS} AS n_prior, count(*) OVER {W90} AS n_prior_90d,
      median(amt) OVER {W90} AS prior_median,
      count(*) FILTER (WHERE channel = 'online') OVER {W48} AS n_online_48h,
      count(*) FILTER (WHERE channel = 'online') OVER {W24} AS n_online_24h,
      count(*) FILTER (WHERE channel = 'in_person') OVER {W24} AS n_in_person_24h,
      max(amt) OVER {ROWS} AS prior_max_amt,
      lag(txn_id) OVER (PARTITION BY card ORDER BY ts_us, txn_id) AS prev_txn_id,
      (ts_us - lag(ts_us) OVER (PARTITION BY card ORDER BY ts_us, txn_id)) / 1e6 AS gap_secs,
      row_number() OVER (PARTITION BY card, device_profile ORDER BY ts_us, txn_id) AS rn_dev,
      row_number() OVER (PARTITION BY card, product_cd ORDER BY ts_us, txn_id) AS rn_prod,
      row_number() OVER (PARTITION BY card, p_email ORDER BY ts_us, txn_id) AS rn_mail
    FROM txn t) w) b
"""
# Quadratic but plain: for every row, count the prior in-person regions of its card.
HOME_SQL = """
SELECT txn_id, addr1 AS home_addr1 FROM (
  SELECT r.txn_id, p.addr1, row_number() OVER (PARTITION BY r.txn_id ORDER BY count(*) DESC, min(p.ts_us) ASC, min(p.txn_id) ASC) AS rk
  FROM txn r JOIN txn p ON p.card = r.card AND (p.ts_us < r.ts_us OR (p.ts_us = r.ts_us AND p.txn_id < r.txn_id))
  WHERE p.channel = 'in_person' AND p.addr1 IS NOT NULL GROUP BY r.txn_id, p.addr1)
WHERE rk = 1
"""
DEC_SQL = "SELECT txn_id, CAST(ntile(10) OVER (ORDER BY risk_score, txn_id) AS INT) AS risk_decile FROM txn"
PRIOR_SQL = """
SELECT t.txn_id,
  EXISTS (SELECT 1 FROM cj e WHERE e.outcome = 'confirmed_fraud' AND e.card = t.card AND e.closed_us < t.ts_us) AS prior_fraud_card,
  EXISTS (SELECT 1 FROM cj e WHERE e.outcome = 'confirmed_fraud' AND e.customer_id = t.customer_id AND e.closed_us < t.ts_us) AS prior_fraud_customer,
  EXISTS (SELECT 1 FROM cj e WHERE e.outcome = 'cleared' AND e.card = t.card AND e.closed_us < t.ts_us AND e.analyst_notes ILIKE '%confirmed travel%') AS prior_cleared_travel,
  EXISTS (SELECT 1 FROM cj e WHERE e.outcome = 'cleared' AND e.card = t.card AND e.closed_us < t.ts_us AND e.analyst_notes ILIKE '%new phone%') AS prior_cleared_phone
FROM txn t
"""
FEATURES_SQL = """
SELECT p.* EXCLUDE (rn_dev, rn_prod, rn_mail), h.home_addr1,
  CASE WHEN p.n_prior >= 5 AND p.channel = 'in_person' AND p.addr1 IS NOT NULL AND h.home_addr1 IS NOT NULL
       THEN p.addr1 <> h.home_addr1 END AS out_of_home,
  d.risk_decile, f.prior_fraud_card, f.prior_fraud_customer, f.prior_cleared_travel, f.prior_cleared_phone
FROM pit p LEFT JOIN home h USING (txn_id) JOIN dec d USING (txn_id) JOIN prior f USING (txn_id)
"""
PIT = {"pit": PIT_SQL}
FEATS = {"pit": PIT_SQL, "home": HOME_SQL, "dec": DEC_SQL, "prior": PRIOR_SQL, "feat": FEATURES_SQL}


@query("w01_prior_count", "SELECT txn_id, n_prior FROM pit", ("txn",), PIT)
def _(f):
    return pit.pit_base(f.txn).select("txn_id", "n_prior")


@query("w02_rolling_count_90d", "SELECT txn_id, n_prior_90d FROM pit", ("txn",), PIT)
def _(f):
    return pit.pit_base(f.txn).select("txn_id", "n_prior_90d")


@query("w03_rolling_channel_counts", "SELECT txn_id, n_online_48h, n_online_24h, n_in_person_24h FROM pit", ("txn",), PIT)
def _(f):
    return pit.pit_base(f.txn).select("txn_id", "n_online_48h", "n_online_24h", "n_in_person_24h")


@query("w04_rolling_median", "SELECT txn_id, prior_median FROM pit", ("txn",), PIT)
def _(f):
    return rolling_median(f.txn, "amt", 90 * DAY_US, "prior_median").select("txn_id", "prior_median")


@query("w04_rolling_median_7d", f"SELECT txn_id, median(amt) OVER {rng(7 * DAY_US)} AS prior_median FROM txn", ("txn",))
def _(f):
    return rolling_median(f.txn, "amt", 7 * DAY_US, "prior_median").select("txn_id", "prior_median")


@query("w05_rolling_mad", "SELECT txn_id, prior_median, prior_mad FROM pit", ("txn",), PIT)
def _(f):
    return pit.pit_amount(f.txn).select("txn_id", "prior_median", "prior_mad")


@query("w06_amount_z", "SELECT txn_id, round(amt_z, 6) AS amt_z FROM pit", ("txn",), PIT)
def _(f):
    df = pit.pit_amount(pit.pit_base(f.txn))
    return df.select("txn_id", F.round(pit.amount_z(), 6).alias("amt_z"))


@query("w07_risk_decile", DEC_SQL, ("txn",))
def _(f):
    return pit.risk_decile(f.txn).select("txn_id", "risk_decile")


@query("w08_first_seen_flags", "SELECT txn_id, is_new_device, unseen_product, unseen_email FROM pit", ("txn",), PIT)
def _(f):
    flags = pit.flag_columns()
    return pit.pit_base(f.txn).select("txn_id", *[flags[n].alias(n) for n in ("is_new_device", "unseen_product", "unseen_email")])


@query("w09_home_asof", "SELECT txn_id, home_addr1, out_of_home FROM feat", ("txn", "cj"), FEATS)
def _(f):
    return pit.pit_base(f.txn).select("txn_id", "home_addr1", pit.flag_columns()["out_of_home"].alias("out_of_home"))


@query("w10_mixed_channel", "SELECT txn_id, mixed_24h FROM pit", ("txn",), PIT)
def _(f):
    return pit.pit_base(f.txn).select("txn_id", pit.mixed_channel().alias("mixed_24h"))


@query("w11_burst_bucket", "SELECT txn_id, burst_bucket FROM pit", ("txn",), PIT)
def _(f):
    return pit.pit_base(f.txn).select("txn_id", pit.burst_bucket().alias("burst_bucket"))


@query("w12_prior_case_flags", PRIOR_SQL, ("txn", "cj"))
def _(f):
    return pit.prior_case_flags(f.txn, f.cj).select(
        "txn_id", "prior_fraud_card", "prior_fraud_customer", "prior_cleared_travel", "prior_cleared_phone")


@query("w13_next_edges", "SELECT prev_txn_id AS src, txn_id AS dst, gap_secs FROM pit WHERE prev_txn_id IS NOT NULL", ("txn",), PIT)
def _(f):
    return pit.next_edges(f.txn)


FEATURE_COLS = """txn_id customer_id card ts_us channel product_cd amt risk_score addr1 device_profile id_15 id_23
n_prior n_prior_90d n_online_48h n_online_24h n_in_person_24h prior_median prior_mad home_addr1 is_new_device
unseen_product unseen_email out_of_home mixed_24h burst_bucket proxy_flag risk_decile prior_fraud_card
prior_fraud_customer prior_cleared_travel prior_cleared_phone""".split()


@query("w14_pit_features", f"SELECT {', '.join(FEATURE_COLS)}, round(amt_z, 6) AS amt_z FROM feat", ("txn", "cj"), FEATS)
def _(f):
    return pit.pit_features(f.txn, f.cj).select(*FEATURE_COLS, F.round("amt_z", 6).alias("amt_z"))


@query("w15_device_first_seen", "SELECT card, device_profile, first_us, n_seen FROM known", ("known",))
def _(f):
    return pit.device_first_seen(f.txn)


@query("slice_new_device_burst", """
SELECT p.txn_id, p.card, p.risk_score, CAST(p.n_online_48h AS BIGINT) AS n_online_48h,
  'card_not_present_new_device' AS pattern
FROM pit p
WHERE p.risk_score >= 0.9 AND p.is_new_device AND p.n_online_48h >= 2
""", ("txn",), PIT)
def _(f):
    return sweeps.new_device_bursts(f.txn)
