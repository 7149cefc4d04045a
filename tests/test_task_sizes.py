"""Tasks hold the same share of rows at any size of the input."""

from fraudlake import session
from fraudlake.operators import ranks

PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_parts_of_a_shuffle_follow_the_rows(spark, conf):
    with conf(**{PARTS: 8}):
        session.size_shuffles(spark, 1_000)
        assert int(spark.conf.get(PARTS)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        session.size_shuffles(spark, 36_000_000)
        assert int(spark.conf.get(PARTS)) * session.TASK_ROWS >= 36_000_000


def test_joins_send_little_through_the_driver(spark):
    df = spark.range(60_000)
    assert session.small(df) is df
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) <= 2 << 20


def test_ranks_in_a_class_by_many_ranges(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "CAST(id % 3 = 0 AS INT) AS y")
    whole = sorted(map(tuple, ranks.class_ranks(df, "id", "y", 42).select("id", "y", "_rank", "_class_rows").collect()))
    monkeypatch.setattr(ranks, "RANGE_ROWS", 10)
    cut = ranks.class_ranks(df, "id", "y", 42)
    assert "1, 2)" in cut._jdf.queryExecution().optimizedPlan().toString()     # two digits of the hash
    assert sorted(map(tuple, cut.select("id", "y", "_rank", "_class_rows").collect())) == whole
