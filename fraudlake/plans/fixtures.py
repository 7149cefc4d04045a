"""Domain views over the star-schema test tables, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fraudlake.cols import DAY_US
from fraudlake.operators import keys, pit, tables
from fraudlake.session import cut, size_shuffles, tune

TXN = """
SELECT event_id AS txn_id,
  concat('C', lpad(CAST(user_id AS VARCHAR), 5, '0')) AS customer_id,
  COALESCE(CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(k % 2 AS VARCHAR) END, '_') AS c2,
  concat('C', lpad(CAST(user_id AS VARCHAR), 5, '0'), '|', COALESCE(CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(k % 2 AS VARCHAR) END, '_')) AS card,
  ts AS ts, epoch_us(ts) AS ts_us,
  CASE WHEN event_type IN ('signup','view') THEN 'in_person' ELSE 'online' END AS channel,
  event_type AS product_cd, value AS amt,
  (event_id * 7919 % 1000) / CAST(1000 AS DOUBLE) AS risk_score,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(user_id % 7 + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS addr1,
  CASE WHEN event_type IN ('signup','view') THEN NULL WHEN k % 20 = 0 THEN 'HUB'
       ELSE concat('D', CAST((user_id * 3 + k % 6) % 211 AS VARCHAR)) END AS device_profile,
  CASE WHEN event_type IN ('signup','view') THEN NULL WHEN k % 5 = 0 THEN 'New' ELSE 'Found' END AS id_15,
  CASE WHEN event_type NOT IN ('signup','view') AND k % 13 = 0 THEN 'IP_PROXY:ANONYMOUS' END AS id_23,
  concat('p', CAST(k % 8 AS VARCHAR), '.com') AS p_email,
  CASE WHEN k % 3 = 0 THEN concat('r', CAST(k % 5 AS VARCHAR), '.com') END AS r_email,
  CASE WHEN k % 17 = 0 THEN 'false' WHEN k % 17 < 9 THEN 'true' END AS "M1", CASE WHEN k % 31 = 0 THEN 'False' WHEN k % 31 < 20 THEN 'true' END AS "M9", k
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
"""
CASE = """
SELECT concat('CC-', lpad(CAST(txn_id AS VARCHAR), 7, '0')) AS case_id, customer_id, c2, card,
  ts + INTERVAL '6' HOUR AS opened_at, ts + INTERVAL 1 DAY * (1 + k % 5) AS closed_at,
  CASE WHEN txn_id % 6 = 0 THEN 'cleared' ELSE 'confirmed_fraud' END AS outcome,
  CASE WHEN txn_id % 6 = 0 THEN 'none' WHEN k % 3 = 0 THEN 'undocumented' ELSE 'card_testing' END AS pattern,
  txn_id AS first_fraud_txn_id,
  CASE WHEN nxt IS NULL THEN CAST(txn_id AS VARCHAR) ELSE concat(CAST(txn_id AS VARCHAR), '|', CAST(nxt AS VARCHAR)) END AS txn_ids,
  amt + COALESCE(nxt_amt, 0) AS exposure_usd,
  CASE WHEN txn_id % 6 <> 0 AND amt + COALESCE(nxt_amt, 0) > 100 THEN 'Yes' ELSE 'No' END AS report_filed,
  CASE WHEN txn_id % 6 <> 0 THEN 'BLOCK_CARD|CREATE_CASE' ELSE 'CLOSE_NO_FRAUD' END AS actions_taken,
  CASE WHEN txn_id % 6 <> 0 THEN 'Fraud pattern seen before in CC-0000008.'
       WHEN k % 2 = 0 THEN 'Customer Confirmed Travel for a trip.' ELSE 'Customer got a new phone.' END AS analyst_notes
FROM (SELECT *, lead(txn_id) OVER (PARTITION BY card ORDER BY ts_us, txn_id) AS nxt,
             lead(amt) OVER (PARTITION BY card ORDER BY ts_us, txn_id) AS nxt_amt FROM txn)
WHERE product_cd = 'error' AND k < 20
"""
ALERT = """
SELECT concat('AL-', lpad(CAST(txn_id AS VARCHAR), 7, '0')) AS alert_id, txn_id AS flagged_txn_id, customer_id, card,
  ts + INTERVAL '3' HOUR AS opened_at,
  CASE txn_id % 3 WHEN 0 THEN 'risk_score' WHEN 1 THEN 'customer_report' ELSE 'analyst_request' END AS trigger_type
FROM txn WHERE risk_score >= 0.95
"""
PREDICTION = """
SELECT doc_id AS case_id, quality AS y, toxic AS gt_report,
  (doc_id * 7919 % 1000) / CAST(1000 AS DOUBLE) * 0.6 + quality * 0.3 AS p,
  CASE WHEN (doc_id * 7919 % 1000) / CAST(1000 AS DOUBLE) * 0.6 + quality * 0.3 >= 0.5 THEN 1 ELSE 0 END AS pred
FROM labels
"""
# An alert with the attributes of its flagged transaction and the default look-back windows.
FLAG = f"""
SELECT a.alert_id, a.flagged_txn_id, a.customer_id, a.card, a.opened_at, a.trigger_type,
  epoch_us(a.opened_at) AS opened_us, epoch_us(a.opened_at) - {14 * DAY_US} AS lo_us, epoch_us(a.opened_at) AS hi_us,
  t.ts, t.ts_us, t.channel, t.product_cd, t.amt, t.risk_score, t.addr1, t.device_profile, t.id_15, t.id_23, t.p_email, t.r_email
FROM alert a JOIN txn t ON t.txn_id = a.flagged_txn_id
"""
# Closed cases with their first transaction (the case-transaction join).
CJ = """
SELECT c.*, epoch_us(c.closed_at) AS closed_us, t.device_profile, t.addr1
FROM closed_case c LEFT JOIN txn t ON t.txn_id = c.first_fraud_txn_id
"""
FRAUD_IDS = """
SELECT DISTINCT TRY_CAST(trim(x) AS BIGINT) AS txn_id
FROM (SELECT unnest(string_split(txn_ids, '|')) AS x FROM closed_case WHERE outcome = 'confirmed_fraud')
WHERE TRY_CAST(trim(x) AS BIGINT) IS NOT NULL
"""
CLEARED_IDS = FRAUD_IDS.replace("confirmed_fraud", "cleared")
KNOWN = """
SELECT card, device_profile, count(*) AS n_seen, min(ts_us) AS first_us
FROM txn WHERE device_profile IS NOT NULL GROUP BY card, device_profile
"""
DEG = "SELECT device_profile, count(*) AS degree FROM known GROUP BY device_profile"

VIEWS = {"txn": TXN, "closed_case": CASE, "alert": ALERT, "prediction": PREDICTION, "flag": FLAG,
         "cj": CJ, "fraud_ids": FRAUD_IDS, "cleared_ids": CLEARED_IDS, "known": KNOWN, "deg": DEG}
NEEDS = {"txn": [], "closed_case": ["txn"], "alert": ["txn"], "prediction": [], "flag": ["alert", "txn"],
         "cj": ["closed_case", "txn"], "fraud_ids": ["closed_case"], "cleared_ids": ["closed_case"],
         "known": ["txn"], "deg": ["known"]}


def with_views(sql: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Put the named views, and those they need, before ``sql`` as common table expressions."""
    order: list[str] = []

    def add(v):
        for n in NEEDS[v]:
            add(n)
        if v not in order:
            order.append(v)
    for v in views:
        add(v)
    parts = [f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order]
    parts += [f"{n} AS MATERIALIZED ({q})" for n, q in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {sql}"


def _to_spark(sql: str) -> str:
    for a, b in (('"M1"', "M1"), ('"M9"', "M9"), ("VARCHAR", "STRING"), ("epoch_us(ts)", "unix_micros(CAST(ts AS TIMESTAMP))"),
                 ("ts AS ts,", "CAST(ts AS TIMESTAMP) AS ts,"), ("json_extract_string", "get_json_object"),
                 ("INTERVAL 1 DAY * (1 + k % 5)", "make_dt_interval(1 + k % 5)")):
        sql = sql.replace(a, b)
    return sql


_STORE: dict[tuple, DataFrame] = {}
_ROWS: dict[tuple, int] = {}


class Fixture:
    """Domain tables for one data folder: ingested transactions and derived tables, each written once.

    The derived tables (cases, alerts with context, device use and case edges) are the stored
    graph and feature tables of a real deployment; every session builds its own from the input.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _STORE:
            _STORE[key] = cut(make())
        return _STORE[key]

    def _sql(self, sql: str, **tables: DataFrame) -> DataFrame:
        for n, df in tables.items():
            sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
        return self.spark.sql(_to_spark(sql), **tables)

    @property
    def txn(self) -> DataFrame:
        t = self.stored("txn", lambda: self._sql(TXN, events=self.raw("events")))
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _ROWS:
            _ROWS[key] = t.count()
        size_shuffles(self.spark, _ROWS[key])
        return t

    @property
    def cases(self) -> DataFrame:
        return self.stored("cases", lambda: self._sql(CASE, txn=self.txn))

    @property
    def alerts(self) -> DataFrame:
        return self.stored("alerts", lambda: self._sql(ALERT, txn=self.txn))

    @property
    def predictions(self) -> DataFrame:
        return self._sql(PREDICTION, labels=self.raw("labels"))

    @property
    def flags(self) -> DataFrame:
        return self.stored("flags", lambda: keys.alert_context(self.alerts, self.txn))

    @property
    def cj(self) -> DataFrame:
        return self.stored("cj", lambda: keys.case_join(self.cases, self.txn))

    @property
    def fraud_ids(self) -> DataFrame:
        return self.stored("fraud_ids", lambda: keys.fraud_ids(self.cases))

    @property
    def cleared_ids(self) -> DataFrame:
        return self.stored("cleared_ids", lambda: keys.fraud_ids(self.cases, "cleared"))

    @property
    def known(self) -> DataFrame:
        return self.stored("known", lambda: tables.known_device(self.txn))

    @property
    def features(self) -> DataFrame:
        return self.stored("features", lambda: pit.pit_features(self.txn, self.cj))
