"""Readers with declared schemas and writers for every table the engine produces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlake.cols import Cols

S = T.StringType()
# one set of options for both directions
CSV = {"header": True, "quote": '"', "escape": '"'}
CASE_SCHEMA = T.StructType(
    [T.StructField(n, S) for n in ("case_id", "customer_id", "card_id")]
    + [T.StructField("opened_at", T.TimestampType()), T.StructField("closed_at", T.TimestampType())]
    + [T.StructField(n, S) for n in ("outcome", "pattern")]
    + [T.StructField("first_fraud_txn_id", T.LongType()), T.StructField("txn_ids", S)]
    + [T.StructField("n_txns", T.IntegerType()), T.StructField("exposure_usd", T.DoubleType())]
    + [T.StructField(n, S) for n in ("connected_card_ids", "actions_taken", "report_filed", "analyst_notes")]
)
ALERT_SCHEMA = T.StructType(
    [T.StructField("case_id", S), T.StructField("opened_at", T.TimestampType()),
     T.StructField("trigger_type", S), T.StructField("trigger_text", S),
     T.StructField("flagged_txn_id", T.LongType()), T.StructField("card_id", S),
     T.StructField("customer_id", S), T.StructField("risk_score", T.DoubleType())]
)
PREDICTION_SCHEMA = T.StructType(
    [T.StructField("case_id", S), T.StructField("split", S), T.StructField("gt_outcome", S),
     T.StructField("gt_pattern", S), T.StructField("gt_report", T.BooleanType()),
     T.StructField("gt_exposure", T.DoubleType()), T.StructField("gt_txn_ids", T.ArrayType(S)),
     T.StructField("predicted_verdict", S), T.StructField("predicted_p", T.DoubleType()),
     T.StructField("predicted_pattern", S), T.StructField("predicted_sar", T.BooleanType()),
     T.StructField("predicted_exposure", T.DoubleType()),
     T.StructField("predicted_txn_ids", T.ArrayType(S)),
     T.StructField("tool_calls", T.IntegerType()), T.StructField("latency_s", T.DoubleType())]
)


def read_txn(spark: SparkSession, path: str, cols: Cols | None = None) -> DataFrame:
    """Transactions from Parquet under role names; pruning and pushdown come from the scan."""
    return (cols or Cols()).standardize(spark.read.parquet(path))


def read_identity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Quoted fields may hold line breaks, commas and doubled quotes."""
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV).csv(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CASE_SCHEMA)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ALERT_SCHEMA).withColumnRenamed("case_id", "alert_id")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Scored cases from JSON lines; skipped or failed cases carry no verdict and drop out."""
    return spark.read.schema(PREDICTION_SCHEMA).json(path).where(F.col("predicted_verdict").isNotNull())


def write_txn(df: DataFrame, path: str) -> None:
    """Transactions partitioned by month, so that time windows prune whole folders."""
    df.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(path)


def write_graph(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/{name}")


def read_graph_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def graph_counts(expected: dict[str, DataFrame], loaded: dict[str, DataFrame]) -> DataFrame:
    """Expected and loaded row counts for each table, with the verdict."""
    def counts(tables, alias):
        parts = [df.agg(F.count("*").alias(alias)).select(F.lit(n).alias("table_name"), alias)
                 for n, df in sorted(tables.items())]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    e, g = counts(expected, "n_expected"), counts(loaded, "n_loaded")
    return (e.join(g, "table_name", "left")
            .withColumn("ok", F.coalesce(F.col("n_expected") == F.col("n_loaded"), F.lit(False))))


def sample_graph(txn: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """First ``n`` transactions by id and the edges that start at one of them."""
    head = txn.orderBy("txn_id").limit(n)
    return head, edges.join(head.select("txn_id"), "txn_id", "left_semi")


def write_cases(df: DataFrame, path: str) -> None:
    """Nested case records as JSON lines, one folder for each run."""
    df.write.mode("overwrite").partitionBy("run").json(path)


def write_memory(cases: DataFrame, edges: DataFrame, path: str, replaces: list[str] | None = None) -> str:
    """Upsert investigated cases as one commit: every batch is added, and ``read_memory`` lets the newest record of a case count.

    ``cases`` needs ``case_id``, ``written_at``, ``batch_id`` and the partition column ``day``; ``edges`` needs
    ``case_id``. Cases and edges of a commit go to folders of their own, and only then one line of the manifest names the
    commit: a reader sees both or neither, and what a failed write leaves behind is never read. Nothing stored is rewritten.
    ``replaces`` lists commits that this one stands for.
    """
    commit = uuid.uuid4().hex
    stamps = cases.select("case_id", "written_at", "batch_id", "day")
    cases.withColumn("commit", F.lit(commit)).write.mode("append").partitionBy("commit", "day").parquet(f"{path}/case")
    (edges.drop("written_at", "batch_id", "day").join(stamps, "case_id").withColumn("commit", F.lit(commit))
     .write.mode("append").partitionBy("commit", "day").parquet(f"{path}/edge"))
    line = cases.sparkSession.createDataFrame([(commit, replaces or [])], COMMIT_DDL)
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return commit


COMMIT_DDL = "commit string, replaces array<string>"


def commits(spark: SparkSession, path: str) -> list[str]:
    """Commits that count: named by the manifest and not replaced by another (one short line for each write since the last compaction)."""
    lines = spark.read.schema(COMMIT_DDL).json(f"{path}/manifest")
    gone = lines.select(F.explode("replaces").alias("commit"))
    return sorted(r["commit"] for r in lines.join(gone, "commit", "left_anti").select("commit").collect())


def read_memory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The newest record of every stored case, and the edges written with it; only folders of commits that count are read."""
    live = F.col("commit").isin(commits(spark, path))
    cases = latest_cases(spark.read.parquet(f"{path}/case").where(live).drop("commit"))
    edges = spark.read.parquet(f"{path}/edge").where(live).drop("commit")
    return cases, edges.join(cases.select("case_id", "written_at", "batch_id"), ["case_id", "written_at", "batch_id"], "left_semi").distinct()


def compact_memory(spark: SparkSession, path: str) -> str:
    """Write the newest records as one commit that replaces all others; readers go on with the old ones until its line is in the manifest."""
    old = commits(spark, path)
    cases, edges = read_memory(spark, path)
    return write_memory(cases, edges, path, replaces=old)


def latest_cases(cases: DataFrame) -> DataFrame:
    """One row for each case id, the newest write first."""
    w = Window.partitionBy("case_id").orderBy(F.desc("written_at"), F.desc("batch_id"))
    return cases.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def build_store(tables: dict[str, DataFrame], out: str, spark: SparkSession) -> dict[str, DataFrame]:
    """Write each feature table and hand back readers of the written files."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return {n: spark.read.parquet(f"{out}/{n}") for n in tables}
