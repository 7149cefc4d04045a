"""Streaming jobs run over the event file, sinks read back, and SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fraudlake.cols import DAY_US, HOUR_US
from fraudlake.functions import sqlfuncs
from fraudlake.operators import tables
from fraudlake.plans.base_queries import MEMORY_SQL, linked, memory_cases
from fraudlake.plans.decision_queries import CASES_SQL, finished
from fraudlake.plans.fixtures import TXN
from fraudlake.plans.pit_queries import FEATS, PRIOR_SQL
from fraudlake.plans.registry import query
from fraudlake.session import cut, ensure_checkpoint_dir
from fraudlake.sources import io
from fraudlake.streaming import jobs

T = ("txn",)
H = HOUR_US
# append mode emits what the watermark (newest time less one hour) has passed
MARK = f"(SELECT max(ts_us) - {H} FROM txn)"
MARK_ON = f"(SELECT max(ts_us) - {H} FROM txn WHERE channel = 'online')"


def stream(f):
    """The event file as a stream of transactions."""
    raw = (f.spark.readStream.schema(f.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(f.dir))
    return f._sql(TXN, events=raw)


def temp(f, name):
    return f"{ensure_checkpoint_dir(f.spark)}/{name}-{uuid.uuid4().hex}"


@query("k01_alert_feed", "SELECT txn_id, ts_us, customer_id, card, risk_score FROM txn WHERE risk_score >= 0.9 AND txn_id NOT IN (SELECT flagged_txn_id FROM alert)", ("txn", "alert"))
def _(f):
    out = jobs.run_available(jobs.alert_feed(stream(f), f.alerts.select(F.col("flagged_txn_id").alias("txn_id"))))
    return out.select("txn_id", F.unix_micros("ts").alias("ts_us"), "customer_id", "card", "risk_score")


@query("k02_daily_counts", f"""SELECT card, ts_us // {DAY_US} * {DAY_US} AS start_us, count(*) AS n, count(*) FILTER (WHERE channel = 'online') AS n_online FROM txn
 WHERE ts_us // {DAY_US} * {DAY_US} + {DAY_US} <= {MARK} GROUP BY 1, 2""", T)
def _(f):
    return jobs.run_available(jobs.daily_counts(stream(f)))


@query("k03_sliding_bursts", f"""SELECT card, s AS start_us, count(*) AS n_online FROM (SELECT card, unnest([ts_us // {DAY_US} * {DAY_US}, ts_us // {DAY_US} * {DAY_US} - {DAY_US}]) AS s FROM txn WHERE channel = 'online')
 WHERE s + {2 * DAY_US} <= {MARK_ON} GROUP BY 1, 2 HAVING count(*) >= 2""", T)
def _(f):
    return jobs.run_available(jobs.sliding_bursts(stream(f)))


@query("k04_burst_sessions", f"""SELECT card, min(ts_us) AS start_us, count(*) AS n, CAST(sum(CAST(amt AS DECIMAL(28,6))) AS DOUBLE) AS amt FROM (
 SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {48 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY card ORDER BY ts_us, txn_id) AS sid FROM (
  SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY card ORDER BY ts_us, txn_id) AS gap FROM txn)) GROUP BY card, sid HAVING max(ts_us) + {48 * H} <= {MARK}""", T)
def _(f):
    return jobs.run_available(jobs.burst_sessions(stream(f)))


@query("k05_first_seen_state", "SELECT txn_id, is_new_device, unseen_product, unseen_email, home_addr1 FROM feat", ("txn", "cj"), FEATS)
def _(f):
    return jobs.run_available(jobs.first_seen(stream(f)))


@query("k06_testing_state", f"""SELECT l.txn_id, count(*) AS n_small FROM txn l JOIN txn s ON s.card = l.card AND s.channel = 'online' AND s.amt < 20 AND s.ts_us < l.ts_us AND s.ts_us >= l.ts_us - {72 * H}
 WHERE l.channel = 'online' AND l.amt > 60 GROUP BY 1 HAVING count(*) >= 3""", T)
def _(f):
    return jobs.run_available(jobs.testing_sequences(stream(f), 20.0, 60.0, 3, 72))


@query("k07_interval_join", f"SELECT a.txn_id AS alert_id, t.txn_id FROM txn a JOIN txn t ON t.card = a.card AND t.ts_us BETWEEN a.ts_us - {48 * H} AND a.ts_us + {48 * H} WHERE a.risk_score >= 0.95", T)
def _(f):
    a = stream(f).where(F.col("risk_score") >= 0.95).select(F.col("txn_id").alias("alert_id"), "card", F.col("ts").alias("at"))
    return jobs.run_available(jobs.nearby_join(a, stream(f)))


@query("k08_case_history", PRIOR_SQL, ("txn", "cj"))
def _(f):
    return jobs.run_available(jobs.case_history(stream(f), f.cj))


@query("k09_memory_append", "SELECT concat('MEM-', CAST(txn_id AS VARCHAR)) AS case_id, customer_id, amt FROM txn WHERE risk_score >= 0.95", T)
def _(f):
    cases = stream(f).where(F.col("risk_score") >= 0.95).select(F.concat(F.lit("MEM-"), F.col("txn_id").cast("string")).alias("case_id"), "customer_id", "amt", "ts_us")
    path = temp(f, "memory")
    jobs.append_memory(cases, path, "ts_us").awaitTermination()
    return jobs.read_memory(f.spark, path, "ts_us").select("case_id", "customer_id", "amt")


# ---- sources and sinks: written, read back, compared -----------------------------------


@query("i02_csv_cases", """SELECT case_id, customer_id, outcome, first_fraud_txn_id, txn_ids, exposure_usd, report_filed,
 CASE WHEN first_fraud_txn_id % 2 = 0 THEN analyst_notes || chr(10) || 'He said "no", then left.' ELSE analyst_notes END AS analyst_notes FROM closed_case""", ("closed_case",))
def _(f):
    path = temp(f, "cases-csv")
    said = F.concat("analyst_notes", F.lit('\nHe said "no", then left.'))
    c = f.cases.withColumn("analyst_notes", F.when(F.col("first_fraud_txn_id") % 2 == 0, said).otherwise(F.col("analyst_notes")))
    have = {"card_id": F.lit(None).cast("string"), "n_txns": F.size(F.split("txn_ids", r"\|")), "connected_card_ids": F.lit(None).cast("string")}
    io.write_csv(c.select(*[have.get(n, F.col(n) if n in c.columns else F.lit(None)).alias(n) for n in io.CASE_SCHEMA.names]), path)
    return io.read_cases(f.spark, path).select("case_id", "customer_id", "outcome", "first_fraud_txn_id", "txn_ids", "exposure_usd", "report_filed", "analyst_notes")


@query("i04_graph_sink", """SELECT 'e_owns' AS table_name, count(*) AS n FROM (SELECT DISTINCT customer_id, card FROM txn) UNION ALL SELECT 'v_txn', count(*) FROM txn
 UNION ALL SELECT 'v_case', count(*) FROM closed_case UNION ALL SELECT 'e_known_device', count(*) FROM known UNION ALL SELECT 'tables equal to their source', 23""", ("txn", "closed_case", "known"))
def _(f):
    path = temp(f, "graph")
    source = tables.graph_tables(f.txn, linked(f))
    io.write_graph(source, path)
    counts = cut(io.graph_counts(source, io.read_graph_tables(f.spark, path, list(source))))
    shown = counts.where(F.col("table_name").isin("e_owns", "v_txn", "v_case", "e_known_device"))
    matching = counts.where("ok").agg(F.lit("tables equal to their source").alias("table_name"), F.count("*").alias("n"))
    return shown.select("table_name", F.col("n_loaded").alias("n")).unionByName(matching)


@query("i07_feature_store", "SELECT txn_id, prior_fraud_card FROM prior", ("txn", "cj"), {"prior": PRIOR_SQL})
def _(f):
    out = io.build_store({"features": f.features, "cases": f.cj}, temp(f, "store"), f.spark)
    return out["features"].select("txn_id", "prior_fraud_card")


@query("i08_case_json", "SELECT case_id, verdict, pattern, round(exposure_usd, 2) AS exposure_usd, CAST(1 + has_report::INT + has_monitor::INT + has_all::INT + has_close::INT AS INT) AS n_final FROM done", T, {"done": CASES_SQL})
def _(f):
    d = finished(f)
    rec = d.select(F.lit("run1").alias("run"), "case_id", F.struct("verdict", "pattern", "exposure_usd", "affected", "connected", "similar", "summary").alias("case"),
                   F.struct("initial", "final", "what_changed").alias("next_best_actions"), F.struct(F.col("report").alias("file"), "subjects", "narrative").alias("sar"))
    path = temp(f, "cases-json")
    io.write_cases(rec, path)
    back = f.spark.read.schema(rec.schema).json(path)
    return back.select("case_id", "case.verdict", "case.pattern", F.round("case.exposure_usd", 2).alias("exposure_usd"), F.size("next_best_actions.final").alias("n_final"))


@query("i09_prediction_log", "SELECT CAST(case_id AS VARCHAR) AS case_id, CASE WHEN p >= 0.5 THEN 'fraud' ELSE 'legitimate' END AS predicted_verdict, p AS predicted_p FROM prediction WHERE case_id % 5 <> 0", ("prediction",))
def _(f):
    path = temp(f, "log")
    v = F.when(F.col("case_id") % 5 != 0, F.when(F.col("p") >= 0.5, "fraud").otherwise("legitimate"))
    f.predictions.select(F.col("case_id").cast("string").alias("case_id"), v.alias("predicted_verdict"), F.col("p").alias("predicted_p")).write.json(path)
    return io.read_predictions(f.spark, path).select("case_id", "predicted_verdict", "predicted_p")


MEMORY_UPSERT = """
SELECT case_id, kind, count(*) AS n, max(v) AS version FROM (
  SELECT case_id, kind, 1 + CASE WHEN CAST(right(case_id, 1) AS INT) % 3 = 0 THEN 1 ELSE 0 END AS v,
         CASE WHEN CAST(right(case_id, 1) AS INT) % 3 = 0 THEN 'Y' || dst ELSE dst END AS dst
  FROM (SELECT DISTINCT case_id, kind, dst FROM (""" + MEMORY_SQL + """)))
GROUP BY 1, 2
"""


@query("i10_case_memory_upsert", MEMORY_UPSERT, ("cj",))
def _(f):
    """Three writes: half of the cases, the other half on the same days, then a change that also moves the day of every third."""
    path = temp(f, "case-memory")
    edges = tables.memory_edges(memory_cases(f)).select("case_id", "kind", "dst")
    last = F.substring("case_id", -1, 1).cast("int")
    cases = f.cj.select("case_id", F.col("closed_at").alias("written_at"), F.lit(1).alias("batch_id"),
                        F.date_format("closed_at", "yyyy-MM-dd").alias("day")).distinct()
    for half in (0, 1):
        ids = cases.where(last % 2 == half)
        io.write_memory(io.latest_cases(ids), edges.join(ids.select("case_id"), "case_id", "left_semi"), path)
    again = (cases.where(last % 3 == 0).withColumn("written_at", F.col("written_at") + F.expr("INTERVAL 1 DAY"))
             .withColumn("batch_id", F.lit(2)).withColumn("day", F.date_format("written_at", "yyyy-MM-dd")))
    changed = edges.join(again.select("case_id"), "case_id", "left_semi").withColumn("dst", F.concat(F.lit("Y"), "dst"))
    io.write_memory(io.latest_cases(again), changed, path)
    io.compact_memory(f.spark, path)
    _, got = io.read_memory(f.spark, path)
    return got.groupBy("case_id", "kind").agg(F.count("*").alias("n"), F.max("batch_id").alias("version"))


@query("u03_sql_functions", """SELECT txn_id, round(1 / (1 + exp(-(amt / 100 - 1))), 6) AS s, round(CASE WHEN risk_score > 0 AND risk_score < 1 THEN ln(risk_score / (1 - risk_score)) END, 6) AS l,
 round((amt - 34) / (1.4826 * 17), 6) AS z, customer_id || '|' || coalesce(addr1, '_') AS c FROM txn""", T)
def _(f):
    sqlfuncs.register(f.spark)
    return f.txn.selectExpr("txn_id", "round(sigmoid(amt / 100 - 1), 6) AS s", "round(logit(risk_score), 6) AS l", "round(robust_z(amt, 34D, 17D), 6) AS z", "card_key(customer_id, addr1) AS c")


