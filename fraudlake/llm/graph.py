"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.session import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``label``, the smallest node it reaches, for every node of ``edges(u, v)``.

    Large star: every node sends its smallest neighbour to its larger neighbours; small star: to its
    smaller ones. Rounds are written to the shared folder. A hub's edges stay spread: its smallest
    neighbour comes from a partial aggregate, and the join back can be split by Spark.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = cut(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                  .select("e.u", "e.v").where("u <> v").distinct())
        # settled when no node is both a leaf's label and a leaf itself, and each leaf has one label
        if new.groupBy("u").count().where("count > 1").isEmpty() and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            leaves = new.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return leaves.unionByName(leaves.select(F.col("label").alias("node"), "label").distinct())
        now = new
    raise RuntimeError("components did not settle; raise max_rounds")
