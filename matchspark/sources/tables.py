"""Typed reading and writing of the nine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.schemas import TABLES

# Folders per table: lookups by type and status then read one folder only.
PARTITIONED_BY = {"embeddings": ["object_type", "status"]}


def conform(name: str, df: DataFrame) -> DataFrame:
    """``df`` with exactly the table's columns and types.

    A missing optional column becomes NULL or its default, a missing time stamp
    the current time; any other missing column is an error.
    """
    table = TABLES[name]
    out = []
    for f in table.columns.fields:
        if f.name in df.columns:
            c = F.col(f.name)
        elif f.name in table.defaults:
            c = F.lit(table.defaults[f.name])
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.localtimestamp()
        elif f.nullable:
            c = F.lit(None)
        else:
            raise ValueError(f"{name} needs column {f.name}")
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Write each table below ``root``, which must be a new snapshot folder."""
    for name, df in tables.items():
        df.write.partitionBy(*PARTITIONED_BY.get(name, [])).parquet(f"{root}/{name}")


# Joined on the reaction key by every feed and by the matches.
BUCKETED_BY = {
    "recommendations": ["id", "candidate_id"],
    "reactions": ["recommendation_id", "reactor_id"],
}


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, table: str) -> DataFrame:
    """Store recommendations or reactions so that joins between them need no shuffle.

    ``table`` is the catalog name; both tables must have the same number of buckets.
    A bucket should fill a few files of usual size; keys are nearly unique, so
    buckets are even.
    """
    columns = BUCKETED_BY[name]
    writer = df.repartition(buckets, *columns).write.bucketBy(buckets, *columns)
    writer.sortBy(*columns).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def load_tables(
    spark: SparkSession, root: str, names: list[str] | None = None, views: bool = True
) -> dict[str, DataFrame]:
    """The tables below ``root`` with their declared types, also as temporary views."""
    loaded = {}
    for name in names or TABLES:
        columns = T.StructType(
            [T.StructField(f.name, f.dataType, True) for f in TABLES[name].columns.fields]
        )
        loaded[name] = spark.read.schema(columns).parquet(f"{root}/{name}")
        if views:
            loaded[name].createOrReplaceTempView(name)
    return loaded
