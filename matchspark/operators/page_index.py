"""Any page of any owner from the files that hold it.

The rows are stored in slices of (owner, key), a folder each, with their position in the slice.
Beside them lies one row per owner and slice: how many rows the owner has in earlier slices, where
its rows begin in this one, and its first and last key.  That is about as many rows as there are
owners and slices together, and it places a page of any limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.functions.requests import DEFAULT_LIMIT, MAX_LIMIT

ROWS, FENCES, SHAPE = "rows", "fences", "shape"
SLICE = "slice"
#: Ranks of an owner that meet in one block, so that an owner's pages and slices never all meet.
BLOCK = 1 << 20
#: ``monotonically_increasing_id`` counts the rows of a task in its lower 33 bits.
_IN_TASK = (1 << 33) - 1


def build(rows: DataFrame, owner: str, key: str, path: str, slices: int | None = None) -> None:
    """Store ``rows``, unique on (owner, key), below ``path``, a new folder.

    Rows whose owner or key is NULL are on no page and are left out.
    """
    spark = rows.sparkSession
    parts = [owner, key] if slices is None else [slices, owner, key]
    placed = (
        rows.dropna(subset=[owner, key])
        .repartitionByRange(*parts)
        .sortWithinPartitions(owner, key)
        .withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK)))
        .withColumn(SLICE, F.spark_partition_id())
    )
    # A file without rows keeps the columns, which no other file has to be opened for.
    spark.createDataFrame([], placed.schema).write.parquet(f"{path}/{SHAPE}")
    placed.write.partitionBy(SLICE).parquet(f"{path}/{ROWS}")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/{ROWS}")
    earlier = Window.partitionBy(owner).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    (
        stored.groupBy(owner, SLICE)
        .agg(
            F.min("pos").alias("first_pos"),
            F.count("*").alias("rows"),
            F.min(key).alias("first_key"),
            F.max(key).alias("last_key"),
        )
        .withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .write.parquet(f"{path}/{FENCES}")
    )


def fences(spark: SparkSession, path: str) -> DataFrame:
    """(owner, slice, first_pos, rows, first_key, last_key, before)."""
    return spark.read.parquet(f"{path}/{FENCES}")


def slices_of(requests: DataFrame, found: DataFrame, owner: str, limit: int) -> DataFrame:
    """(slice): those that hold a row of a page asked for, or the key that opens it."""
    last = F.col("page") * limit
    asked = requests.select(owner, F.greatest(last - limit, F.lit(1)).alias("_from"), last.alias("_to"))
    blocks = F.array_distinct(F.array(F.floor(F.col("_from") / BLOCK), F.floor(F.col("_to") / BLOCK)))
    asked = asked.withColumn("_block", F.explode(blocks))
    until = F.col("before") + F.col("rows")
    covered = F.sequence(F.floor((F.col("before") + 1) / BLOCK), F.floor(until / BLOCK))
    held = found.select(owner, SLICE, "before", until.alias("until"), F.explode(covered).alias("_block"))
    met = asked.join(held, [owner, "_block"]).filter("_to > before and _from <= until")
    return met.select(SLICE).distinct()


def read_pages(
    spark: SparkSession, path: str, requests: DataFrame, owner: str, key: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The stored rows of the pages asked for, with ``page`` and ``cursor``, as ``paging.paginate_all`` numbers them.

    ``requests`` holds (owner, page), pages counting from 1; pages asked for twice are given once,
    and those that do not exist have no rows.  The numbers of the slices asked for go through the
    driver, at most one for each stored folder; no other folder is opened.
    """
    limit = min(limit, MAX_LIMIT) if limit >= 1 else DEFAULT_LIMIT
    requests = requests.select(owner, F.col("page").cast("bigint").alias("page")).filter("page >= 1").distinct()
    found = fences(spark, path)
    which = [r[SLICE] for r in slices_of(requests, found, owner, limit).collect()]
    inside = F.col(SLICE).isin(which)
    shape = spark.read.parquet(f"{path}/{SHAPE}").schema
    stored = spark.read.schema(shape).parquet(f"{path}/{ROWS}").filter(inside)
    shifts = found.filter(inside).select(owner, SLICE, (F.col("before") - F.col("first_pos")).alias("_shift"))
    ranked = stored.join(shifts, [owner, SLICE]).withColumn("_rank", F.col("pos") + F.col("_shift") + 1)
    paged = ranked.withColumn("page", F.ceil(F.col("_rank") / limit)).join(requests, [owner, "page"])
    # The last key of a full page is the cursor of the next one.
    cursors = ranked.filter(F.col("_rank") % limit == 0).select(
        owner, (F.floor(F.col("_rank") / limit) + 1).alias("page"), F.col(key).alias("cursor")
    )
    return (
        paged.join(cursors, [owner, "page"], "left")
        .withColumn("cursor", F.coalesce("cursor", F.lit("")))
        .drop("pos", SLICE, "_shift", "_rank")
    )
