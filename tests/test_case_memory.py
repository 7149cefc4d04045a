"""Commits of the case memory: both tables or neither, newest record, compaction; newest by time on a stream."""

import pytest
from pyspark.sql import functions as F

from fraudlake.sources import io
from fraudlake.streaming import jobs

CASE = "case_id string, written_at long, batch_id int, day string, p double"
EDGE = "case_id string, kind string, dst string"


def state(spark, path):
    cases, edges = io.read_memory(spark, path)
    return {(r.case_id, r.written_at, r.p) for r in cases.collect()}, {(r.case_id, r.kind, r.dst) for r in edges.collect()}


def test_a_failed_write_is_not_seen_and_compaction_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "memory")
    io.write_memory(spark.createDataFrame([("A", 1, 1, "d1", 0.1), ("B", 1, 1, "d1", 0.2)], CASE), spark.createDataFrame([("A", "K", "x"), ("B", "K", "y")], EDGE), path)
    first = state(spark, path)
    assert first == ({("A", 1, 0.1), ("B", 1, 0.2)}, {("A", "K", "x"), ("B", "K", "y")})
    bad = spark.createDataFrame([("A", "K", "z")], EDGE).withColumn("dst", F.when(F.col("dst") == "z", F.raise_error(F.lit("lost"))).otherwise(F.col("dst")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        io.write_memory(spark.createDataFrame([("A", 9, 2, "d2", 0.9)], CASE), bad, path)
    assert spark.read.parquet(f"{path}/case").where("written_at = 9").count() == 1      # written, but named by no line
    assert state(spark, path) == first
    io.write_memory(spark.createDataFrame([("A", 5, 3, "d2", 0.5)], CASE), spark.createDataFrame([("A", "K", "new")], EDGE), path)
    second = state(spark, path)
    assert second == ({("A", 5, 0.5), ("B", 1, 0.2)}, {("A", "K", "new"), ("B", "K", "y")})
    made = io.compact_memory(spark, path)
    assert state(spark, path) == second and io.commits(spark, path) == [made]
    io.write_memory(spark.createDataFrame([("C", 6, 4, "d3", 0.6)], CASE), spark.createDataFrame([], EDGE), path)
    assert state(spark, path)[0] == second[0] | {("C", 6, 0.6)} and len(io.commits(spark, path)) == 2


def test_newest_by_time_in_and_between_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ddl = "case_id string, amt double, ts_us long, note string"
    for rows in ([("A", 1.0, 5, None), ("A", 2.0, 9, "late"), ("A", 3.0, 2, None), ("B", 1.0, 1, "x"), ("B", 1.0, 1, "x")], [("A", 4.0, 7, None), ("B", 5.0, 3, None)]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        jobs.append_memory(spark.readStream.schema(ddl).parquet(src), out, "ts_us").awaitTermination()
    assert {tuple(r) for r in jobs.read_memory(spark, out, "ts_us").select("case_id", "amt", "ts_us").collect()} == {("A", 2.0, 9), ("B", 5.0, 3)}
