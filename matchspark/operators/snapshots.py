"""Updates, deletes and inserts that rewrite only the folders holding a changed key.

A table is cut into key ranges, ``rows/written=<version>/part=<n>``, and a small manifest per
version says which folders make it up and which keys each holds.  A change reads the folders
of its keys, writes them anew under the next version and then the manifest, in one file.  All other
folders keep their files, and earlier versions stay readable.  A job that ends before its manifest
has changed nothing; the next one writes over what it left.  One writer at a time.

Ids that grow with time lie together, so that changes to recent rows touch few folders.
The key is unique and not NULL; ranges are even whatever its prefixes are.  The driver gets the
manifest, a row for each part and at most ``MOST_PARTS``, and nothing that grows otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.operators import ingest

#: Parts of a new table; a part should fill a file or a few of usual size.
PARTS = 64
MOST_PARTS = 8192

_HEADER = -1


def create(rows: DataFrame, key: list[str], path: str, parts: int = PARTS) -> None:
    """Store ``rows`` at the new folder ``path`` as version 0."""
    if not 0 < parts <= MOST_PARTS:
        raise ValueError(f"a table has 1 to {MOST_PARTS} parts")
    ranged = rows.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id())
    ranged.write.partitionBy("part").parquet(f"{path}/rows/written=0")
    _write_manifest(rows.sparkSession, path, key, rows.schema, 0, None)


def versions(spark: SparkSession, path: str) -> list[int]:
    heads = spark.read.parquet(f"{path}/manifest").filter(F.col("part") == _HEADER)
    return sorted(r["version"] for r in heads.select("version").collect())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(part, written, n_rows, low, high) of the folders of a version, by default the newest."""
    version = versions(spark, path)[-1] if version is None else version
    rows = spark.read.parquet(f"{path}/manifest").filter((F.col("version") == version) & (F.col("part") != _HEADER))
    return rows.drop("version")


def snapshot(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest; other folders are not opened."""
    entries = manifest(spark, path, version).select("part", "written").collect()
    return _folders(spark, path, schema, [(r["written"], r["part"]) for r in entries]).drop("part", "written")


def _folders(spark: SparkSession, path: str, schema: T.StructType, which: list[tuple[int, int]]) -> DataFrame:
    shape = T.StructType([*schema.fields, T.StructField("written", T.IntegerType()), T.StructField("part", T.IntegerType())])
    names = [f"{written}/{part}" for written, part in which]
    return spark.read.schema(shape).parquet(f"{path}/rows").filter(F.concat_ws("/", "written", "part").isin(names))


def _place(key: list[str], schema: T.StructType, entries: list) -> Column:
    """The part of a key: the first one whose largest key is not below it, or else the last."""
    entries = sorted(entries, key=lambda r: r["part"])
    if not entries:
        return F.lit(0)
    highs = [F.struct(*[F.lit(r["high"][c]).cast(schema[c].dataType).alias(c) for c in key]) for r in entries]
    numbers = F.array(*[F.lit(r["part"]) for r in entries])
    below = F.size(F.filter(F.array(*highs), lambda high: high < F.struct(*[F.col(c) for c in key])))
    return F.element_at(numbers, F.least(below + 1, F.lit(len(entries))))


def change(
    spark: SparkSession,
    path: str,
    key: list[str],
    schema: T.StructType,
    keys: DataFrame,
    new_rows: Callable[[DataFrame], DataFrame],
) -> list[int]:
    """Replace the rows of the parts that ``keys`` fall into by ``new_rows`` of them; gives these parts.

    ``new_rows`` keeps the rows of other keys as they are and adds none but of ``keys``.
    """
    version = versions(spark, path)[-1]
    entries = manifest(spark, path, version).collect()
    place = _place(key, schema, entries).alias("part")
    touched = {r["part"] for r in keys.select(place).distinct().collect()}
    if not touched:
        return []
    old = _folders(spark, path, schema, [(r["written"], r["part"]) for r in entries if r["part"] in touched])
    out = new_rows(old.drop("written", "part")).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    out = out.withColumn("part", place).repartition("part")
    out.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows/written={version + 1}")
    kept = [r for r in entries if r["part"] not in touched]
    _write_manifest(spark, path, key, schema, version + 1, kept)
    return sorted(touched)


def _write_manifest(
    spark: SparkSession, path: str, key: list[str], schema: T.StructType, version: int, kept: list | None
) -> None:
    ends = T.StructType([T.StructField(c, schema[c].dataType) for c in key])
    shape = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("written", T.IntegerType()),
            T.StructField("n_rows", T.LongType()),
            T.StructField("low", ends),
            T.StructField("high", ends),
        ]
    )
    with_part = T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])
    span = F.struct(*key)
    made = (
        spark.read.schema(with_part)
        .parquet(f"{path}/rows/written={version}")
        .groupBy("part")
        .agg(F.count("*").alias("n_rows"), F.min(span).alias("low"), F.max(span).alias("high"))
        .select("part", F.lit(version).alias("written"), "n_rows", "low", "high")
    )
    # One file, so that a version is there with all its rows or not at all.
    rows = [(_HEADER, version, 0, None, None), *map(tuple, kept or []), *map(tuple, made.collect())]
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def update(
    spark: SparkSession,
    path: str,
    key: list[str],
    schema: T.StructType,
    changes: DataFrame,
    columns: list[str],
    now: Column,
    changed: str | None = None,
    order: list[str] | None = None,
) -> list[int]:
    """``ingest.apply_updates`` as a new version; gives the rewritten parts."""
    return change(
        spark, path, key, schema, changes, lambda rows: ingest.apply_updates(rows, changes, key, columns, now, changed, order)
    )


def delete(spark: SparkSession, path: str, key: list[str], schema: T.StructType, keys: DataFrame) -> list[int]:
    """The table without ``keys``; with ``integrity.cascade_delete`` the keys of its removed rows."""
    gone = keys.select(*key).distinct()
    return change(spark, path, key, schema, gone, lambda rows: rows.join(gone, key, "left_anti"))


def insert(
    spark: SparkSession, path: str, key: list[str], schema: T.StructType, batch: DataFrame, order: list[str]
) -> list[int]:
    """Add the batch's rows whose key is not stored, the first by ``order`` of each key."""

    def added(rows: DataFrame) -> DataFrame:
        new = ingest.accepted_rows(rows, batch, key, order)
        return rows.unionByName(new.select(*rows.columns))

    return change(spark, path, key, schema, batch, added)
