"""Session settings, reliable lineage cuts and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows one task may receive for one key before the key is split over time slices.
MAX_ROWS_CONF = "fraudlake.maxRowsPerTask"
MAX_ROWS_DEFAULT = 1_000_000
# Rows a side may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 50_000
# Bytes of a table that joins may send through the driver, and rows of the input for each task of a shuffle.
BROADCAST_BYTES = 2 << 20
TASK_BYTES = 8 << 20
TASK_ROWS = 25_000


def build_session(app: str = "fraudlake", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter makes it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on, safe to set on any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # a row of a task that sorts for many windows takes some kilobytes, so tasks are small and broadcasts smaller
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    return spark


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Parts of a shuffle follow the rows of the input, so that a task holds the same share at any size; small parts are joined up again."""
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(few, -(-rows // TASK_ROWS))))


def max_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_ROWS_CONF, str(MAX_ROWS_DEFAULT)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if wanted is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        wanted = tempfile.mkdtemp(prefix="fraudlake-ckpt-")
    sc.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor cannot change or restart it,
    and later plans see a small scan with known size instead of the whole lineage."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/fraudlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_all(*makes: Callable[[], DataFrame], at_once: int = 6) -> list[DataFrame]:
    """``cut`` of several independent tables, written at the same time: their jobs share the cluster instead of waiting for each other."""
    with ThreadPoolExecutor(min(at_once, len(makes))) as pool:
        return list(pool.map(lambda make: cut(make()), makes))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark an already materialised table for broadcast when its row count allows it."""
    return F.broadcast(df) if fits(df, rows) else df
