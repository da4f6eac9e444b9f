"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.workdir import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge has a < b: a's are b's smaller neighbours.
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    down = joined.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return down.unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).toDF("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: integers, a <> b); component is the smallest node.

    Each round is written to the shared folder.  Stars are joined many-to-one, so a node of
    very many edges is split by the join; rounds grow with the logarithm of the longest path.
    An empty edge table gives no rows.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum("a").cast("decimal(38,0)"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
