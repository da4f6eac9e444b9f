"""Row numbers within an owner of any size.

``row_number() OVER (PARTITION BY owner)`` puts a whole owner in one task.  Here
the rows are range-partitioned by (owner, key), so an owner spans as many slices
as it needs; each slice is numbered by itself and shifted by what the owner holds
in earlier slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.plans.materialize import materialize


def rank_within(df: DataFrame, owner: str, key: str, rank: str = "rank") -> DataFrame:
    """(owner, key, rank), rank counting from 1 in key order; (owner, key) is unique.

    The sliced rows are written once: range bounds come from a sample, so the
    counts and the rows must read the very same slices.
    """
    sliced = materialize(
        df.select(owner, key)
        .repartitionByRange(owner, key)
        .withColumn("_slice", F.spark_partition_id()),
        "ranked",
    )
    earlier = Window.partitionBy(owner).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(owner, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter("_shift > 0")
        .select(owner, "_slice", "_shift")
    )
    # Only the first owner of a slice can continue from the slice before, so
    # shifts has at most one row per slice: small enough to broadcast at any scale.
    local = Window.partitionBy(owner, "_slice").orderBy(key)
    return (
        sliced.withColumn("_rn", F.row_number().over(local))
        .join(F.broadcast(shifts), [owner, "_slice"], "left")
        .select(owner, key, (F.col("_rn") + F.coalesce("_shift", F.lit(0))).alias(rank))
    )
