"""Vector, structural and hybrid retrieval; population sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.operators import keys, neighbors, retrieval, sweeps, tables
from fraudlake.plans.base_queries import CC_DEV
from fraudlake.plans.graph_queries import CC_TXN, HI, LO, TOUCH_CAPPED, TOUCH_SQL, cc_card, cc_dev
from fraudlake.plans.registry import query
from fraudlake.session import cut

# exact top-k of every vector against all others; dot products of unit vectors
SIM = """SELECT q.vec_id AS qid, c.vec_id AS cid, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) /
  (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))) AS score
FROM embeddings q, embeddings c"""
TOP = "SELECT qid, cid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) - 1 AS INT) AS rank FROM sim"


def vectors(f, name):
    return f.raw("embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vec"))


@query("r01_vector_topk", "SELECT qid, cid, rank, round(score, 6) AS score FROM top WHERE rank < 10", (), {"sim": SIM, "top": TOP})
def _(f):
    out = retrieval.vector_topk(vectors(f, "qid"), vectors(f, "cid"), 10)
    return out.select("qid", "cid", "rank", F.round("score", 6).alias("score"))


@query("r02_vector_topk_lsh")
def _(f):
    return retrieval.vector_topk_lsh(vectors(f, "qid"), vectors(f, "cid"), 10)


@query("r02_lsh_recall", "SELECT count(*) AS n_queries, 10 * count(*) AS n_wanted, TRUE AS recall_090 FROM embeddings WHERE vec_id % 100 = 0")
def _(f):
    """Every hundredth row asks; all rows answer."""
    q, c = vectors(f, "qid").where("qid % 100 = 0"), vectors(f, "cid")
    got = retrieval.recall(retrieval.vector_topk_lsh(q, c, 10), retrieval.vector_topk(q, c, 10))
    return got.select("n_queries", "n_wanted", (F.col("recall") >= 0.9).alias("recall_090"))


@query("r03_vectors_by_id", "SELECT vec_id AS cid, label, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def _(f):
    c = f.raw("embeddings").select(F.col("vec_id").alias("cid"), "label", "embedding")
    got = retrieval.vectors_by_id(c, f.raw("labels").select(F.col("doc_id").alias("cid")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return got.select("cid", "label", F.round(total, 6).alias("total"))


GATE = """SELECT qid, cid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank, cid) - 1 AS INT) AS rank, round(1.0 / (rank + 1), 9) AS score
FROM top WHERE rank < 15 AND cid < qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, cid) <= 5"""


@query("r04_asof_gate", GATE, (), {"sim": SIM, "top": TOP})
def _(f):
    q = vectors(f, "qid")
    hits = retrieval.vector_topk(q, vectors(f, "cid"), 15)
    dates = f.raw("embeddings").select(F.col("vec_id").alias("cid"), F.col("vec_id").alias("at"))
    out = retrieval.asof_gate(hits, q.select("qid", F.col("qid").alias("as_of")), dates, 5)
    return out.withColumn("score", F.round("score", 9))


@query("r04_topk_asof", """SELECT qid, cid, CAST(r AS INT) AS rank, round(1.0 / (r + 1), 9) AS score
FROM (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) - 1 AS r FROM sim WHERE cid < qid) WHERE r < 5""", (), {"sim": SIM})
def _(f):
    q = vectors(f, "qid")
    dates = f.raw("embeddings").select(F.col("vec_id").alias("cid"), F.col("vec_id").alias("at"))
    return retrieval.topk_asof(q, vectors(f, "cid"), q.select("qid", F.col("qid").alias("as_of")), dates, 5).withColumn("score", F.round("score", 9))


TC = ("flag", "txn", "closed_case")
TOUCHX = {"ccdev": CC_DEV, "cctxn": CC_TXN, "touch": TOUCH_SQL}
STRUCT = """SELECT alert_id AS qid, case_id AS cid, CAST(row_number() OVER (PARTITION BY alert_id ORDER BY case_id) - 1 AS INT) AS rank, 1.0::DOUBLE AS score
FROM (SELECT DISTINCT t.alert_id, t.case_id FROM touch t JOIN flag f USING (alert_id) JOIN closed_case c USING (case_id) WHERE c.closed_at < f.opened_at)"""


def case_dates(f):
    return f.cases.select(F.col("case_id").alias("cid"), F.unix_micros("closed_at").alias("at"))


def alert_times(f):
    return f.flags.select(F.col("alert_id").alias("qid"), F.col("opened_us").alias("as_of"))


def case_links(f, region_cap=None):
    """What ties alerts to closed cases, without the list of pairs."""
    to = lambda df, i, c: df.select(F.col(i).alias("qid" if i == "alert_id" else "cid"), F.col(c).alias("key"))
    alerts, cases = neighbors.region_windows(f.flags, f.txn, keys.explode_ids(f.cases), region_cap)
    return retrieval.Links((to(f.flags, "alert_id", "card"), to(f.flags, "alert_id", "device_profile")), (to(cc_card(f), "case_id", "card"), to(cc_dev(f), "case_id", "device_profile")),
                           windows=(alerts.withColumnRenamed("alert_id", "qid"), cases.withColumnRenamed("case_id", "cid")))


@query("r05_structural_hits", STRUCT, TC, TOUCHX)
def _(f):
    return retrieval.structural_hits(case_links(f), alert_times(f), case_dates(f))


MULTI = """SELECT qid, cid, kind, round(1.0 / (rank + 1), 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY 1.0 / (rank + 1) DESC, kind) - 1 AS INT) AS pos FROM (
  SELECT qid, cid, CASE WHEN e.label < 5 THEN 'policy' ELSE 'regdoc' END AS kind,
    row_number() OVER (PARTITION BY qid, e.label < 5 ORDER BY round(score, 9) DESC, cid) - 1 AS rank FROM sim JOIN embeddings e ON e.vec_id = cid) WHERE rank < 8
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY 1.0 / (rank + 1) DESC, kind) <= 8"""


@query("r06_multi_corpus", MULTI, (), {"sim": SIM})
def _(f):
    e = f.raw("embeddings").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), "label")
    out = retrieval.vector_topk_multi(vectors(f, "qid"), {"policy": e.where("label < 5"), "regdoc": e.where("label >= 5")}, 8)
    return out.withColumn("score", F.round("score", 9))


RRF = """SELECT qid, cid, round(s, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, cid) - 1 AS INT) AS rank FROM (
  SELECT qid, cid, sum(1.0::DOUBLE / (60 + rank + 1)) AS s FROM ({lists}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, cid) <= 10"""


@query("r07_rank_fusion", RRF.format(lists="SELECT qid, cid, rank FROM top WHERE rank < 10 UNION ALL SELECT qid, cid, rank FROM gate"), (), {"sim": SIM, "top": TOP, "gate": GATE})
def _(f):
    q = vectors(f, "qid")
    # written, as both lists read it
    hits = cut(retrieval.vector_topk(q, vectors(f, "cid"), 15))
    dates = f.raw("embeddings").select(F.col("vec_id").alias("cid"), F.col("vec_id").alias("at"))
    gate = retrieval.asof_gate(hits, q.select("qid", F.col("qid").alias("as_of")), dates, 5)
    return retrieval.rrf([hits.where("rank < 10"), gate]).withColumn("score", F.round("score", 9))


# Case and alert notes have no vectors in the test tables: each takes one of the stored vectors by its number.
HYB = {
    **TOUCHX, "struct": STRUCT,
    "nv": "SELECT count(*) AS n FROM embeddings",
    "qv": "SELECT alert_id AS qid, opened_us AS as_of, embedding FROM flag, nv JOIN embeddings ON vec_id = flagged_txn_id % n",
    "cv": "SELECT case_id AS cid, epoch_us(closed_at) AS at_us, embedding FROM closed_case, nv JOIN embeddings ON vec_id = first_fraud_txn_id % n",
    "s1": "SELECT q.qid, c.cid, q.as_of, c.at_us, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))) AS score FROM qv q, cv c",
    "h1": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) - 1 AS rank FROM s1",
    "sem": "SELECT qid, cid, r AS rank, 1.0::DOUBLE / (r + 1) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS r FROM h1 WHERE at_us < as_of) WHERE r < 10",
    "s2": "SELECT q.qid, c.qid AS cid, q.as_of, c.as_of AS at_us, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))) AS score FROM qv q, qv c",
    "h2": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) - 1 AS rank FROM s2",
    "mem": "SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS rank FROM h2 WHERE at_us < as_of QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 10",
}


def note_vectors(f, rows, id_col, num_col, out):
    e = f.raw("embeddings")
    return (rows.select(F.col(id_col).alias(out), F.pmod(num_col, F.lit(e.count())).alias("vec_id")).join(e, "vec_id")
            .select(out, F.col("embedding").alias("vec")))


def hybrid_inputs(f):
    q = note_vectors(f, f.flags, "alert_id", "flagged_txn_id", "qid")
    c = note_vectors(f, f.cases, "case_id", "first_fraud_txn_id", "cid")
    return q, c


@query("r08_hybrid", RRF.format(lists="SELECT qid, cid, rank FROM struct UNION ALL SELECT qid, cid, rank FROM sem UNION ALL SELECT qid, cid, rank FROM mem"), TC, HYB)
def _(f):
    q, c = hybrid_inputs(f)
    mem_dates = alert_times(f).select(F.col("qid").alias("cid"), F.col("as_of").alias("at"))
    out = retrieval.hybrid(case_links(f), q, c, q.withColumnRenamed("qid", "cid"), alert_times(f), case_dates(f), mem_dates)
    return out.withColumn("score", F.round("score", 9))


@query("r09_similar_cases", """
SELECT qid, cid, CASE WHEN o = 1 THEN 'structural' ELSE 'semantic' END AS source, pos FROM (
  SELECT qid, cid, o, CAST(row_number() OVER (PARTITION BY qid ORDER BY o, rank, cid) - 1 AS INT) AS pos FROM (
    SELECT qid, cid, min(o) AS o, arg_min(rank, (o, rank)) AS rank FROM (
      SELECT qid, cid, 1 AS o, rank FROM struct
      UNION ALL SELECT qid, cid, 2, rank FROM sem JOIN (SELECT qid, list_sort(list(score))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS med FROM sem GROUP BY 1) m USING (qid) WHERE sem.score > m.med) GROUP BY 1, 2)) WHERE pos < 5
""", TC, {**HYB, "touch": TOUCH_CAPPED})
def _(f):
    q, c = hybrid_inputs(f)
    sem = retrieval.topk_asof(q, c, alert_times(f), case_dates(f), 10)
    return retrieval.similar_cases(retrieval.structural_first(case_links(f, 1300), alert_times(f), case_dates(f), 5), sem, 5)


PRED_SQL = "SELECT concat(CASE WHEN y = 1 THEN 'LIVE-' ELSE 'BATCH-' END, CAST(case_id AS VARCHAR)) AS case_id, CASE WHEN pred = 1 THEN 'fraud' ELSE 'legitimate' END AS verdict, p FROM prediction"


def stored_cases(f):
    return f.predictions.select(F.concat(F.when(F.col("y") == 1, "LIVE-").otherwise("BATCH-"), F.col("case_id").cast("string")).alias("case_id"),
                                F.when(F.col("pred") == 1, "fraud").otherwise("legitimate").alias("verdict"), "p")


@query("r10_memory_summary", "SELECT split_part(case_id, '-', 1) AS run, verdict, count(*) AS n_cases, round(avg(p), 6) AS mean_p FROM m GROUP BY 1, 2", ("prediction",), {"m": PRED_SQL})
def _(f):
    return retrieval.memory_summary(stored_cases(f))


@query("r11_case_summary", "SELECT case_id, verdict, p AS fraud_probability, 'none' AS pattern, CASE WHEN verdict = 'fraud' THEN 'closed_fraud' ELSE 'open' END AS status, round(p * 1000, 2) AS exposure_usd, p > 0.5 AS report FROM m", ("prediction",), {"m": PRED_SQL})
def _(f):
    s = stored_cases(f)
    rec = s.select("case_id", F.struct("verdict", F.col("p").alias("fraud_probability"), F.lit("none").alias("pattern"),
                                       F.when(F.col("verdict") == "fraud", "closed_fraud").otherwise("open").alias("status"),
                                       F.round(F.col("p") * 1000, 2).alias("exposure_usd")).alias("case"),
                   F.struct((F.col("p") > 0.5).alias("file")).alias("sar"))
    return retrieval.case_summary(rec)


@query("s01_candidate_alerts", f"""
SELECT txn_id, ts_us, channel, customer_id, card, risk_score, amt, addr1 FROM txn WHERE risk_score >= 0.9 AND ts_us BETWEEN {LO} AND {HI}
AND txn_id NOT IN (SELECT flagged_txn_id FROM alert) ORDER BY risk_score DESC, ts_us DESC, txn_id DESC LIMIT 30
""", ("txn", "alert"))
def _(f):
    return sweeps.candidate_alerts(f.txn, f.alerts.select(F.col("flagged_txn_id").alias("txn_id")), LO, HI, 0.9, 30)


@query("s02_device_ring_sweep", f"""
SELECT t.device_profile, count(DISTINCT customer_id) AS n_cards, count(*) FILTER (WHERE id_23 LIKE 'IP_PROXY:%') AS n_proxied_txns, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n_txns
FROM txn t JOIN deg d ON d.device_profile = t.device_profile AND d.degree <= 100 WHERE channel = 'online' AND ts_us BETWEEN {LO} AND {HI} GROUP BY 1
HAVING count(DISTINCT customer_id) >= 2 AND count(*) FILTER (WHERE id_23 LIKE 'IP_PROXY:%') >= 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10
""", ("txn", "deg"))
def _(f):
    return sweeps.sweep_device_rings(f.txn, tables.device_degree(f.known), LO, HI, min_entities=2)


BANDS = "(VALUES (50.0::DOUBLE), (100.0), (200.0)) v(threshold)"


@query("s03_near_threshold_sweep", f"""
SELECT threshold, customer_id, n_below, first_us, last_us, round(avg_amt, 6) AS avg_amt FROM (
  SELECT threshold, customer_id, count(*) AS n_below, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(sum(CAST(amt AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS avg_amt
  FROM txn, {BANDS} WHERE channel = 'online' AND amt < threshold AND amt > threshold - 20 GROUP BY 1, 2 HAVING count(*) >= 2 AND max(ts_us) - min(ts_us) < 172800000000)
QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY n_below DESC, customer_id) <= 10
""", ("txn",))
def _(f):
    return sweeps.sweep_near_threshold(f.txn, 0, 2**60, [50.0, 100.0, 200.0], k=2).withColumn("avg_amt", F.round("avg_amt", 6))


@query("s04_near_threshold_sliding", f"""
WITH hit AS (SELECT threshold, customer_id, txn_id, ts_us FROM tx, {BANDS} WHERE channel = 'online' AND amt < threshold AND amt > threshold - 20)
SELECT threshold, customer_id, max(n) AS max_in_window FROM (SELECT a.threshold, a.customer_id, a.txn_id, count(*) AS n FROM hit a JOIN hit b
  ON b.customer_id = a.customer_id AND b.threshold = a.threshold AND b.ts_us BETWEEN a.ts_us - 172800000000 AND a.ts_us GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING max(n) >= 3
""".replace("WITH hit AS (", "SELECT * FROM (WITH hit AS (").rstrip() + ")", ("txn",), {"tx": "SELECT * FROM txn"})
def _(f):
    return sweeps.sweep_near_threshold_sliding(f.txn, 0, 2**60, [50.0, 100.0, 200.0])
