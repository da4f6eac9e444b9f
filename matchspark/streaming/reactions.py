"""Reaction requests as a stream into the immutable reactions table.

The table is a folder with one sub-folder per micro-batch.  A batch that is run
again after a failure overwrites its own folder, so each reaction is stored once.
One stream writes a table.  ``compact`` merges the folders of a stopped
stream; ``streaming.keyed`` keeps the keys as state instead of reading the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from matchspark.operators.adjudicate import adjudicate_reactions, created_reactions
from matchspark.operators.ingest import REACTION_KEY, accepted_rows
from matchspark.plans.materialize import materialize
from matchspark.schemas import TABLES

BATCH = "batch"

REACTION_SCHEMA = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in TABLES["reactions"].columns.fields]
)


def stored_reactions(spark: SparkSession, path: str) -> DataFrame:
    """The table, with the number of the batch each row came in."""
    schema = T.StructType([*REACTION_SCHEMA.fields, T.StructField(BATCH, T.LongType(), True)])
    return spark.read.schema(schema).parquet(path)


def _earlier(batch: DataFrame, path: str, number: int) -> DataFrame:
    """Stored rows that could conflict with ``batch``: of other batches, within its id range.

    Files are sorted by recommendation id, so the range skips most row groups when
    ids grow with time and reactions follow soon.
    """
    low, high = batch.agg(F.min("recommendation_id"), F.max("recommendation_id")).first()
    stored = stored_reactions(batch.sparkSession, path).filter(F.col(BATCH) < number)
    if low is None:
        return stored.limit(0)
    return stored.filter(F.col("recommendation_id").between(low, high))


def _append(new: DataFrame, path: str, number: int) -> None:
    (
        new.select(*REACTION_SCHEMA.fieldNames())
        .sortWithinPartitions("recommendation_id")
        .write.mode("overwrite")
        .parquet(f"{path}/{BATCH}={number}")
    )


def _start(stream: DataFrame, checkpoint: str, write) -> DataStreamWriter:
    def once(batch: DataFrame, number: int) -> None:
        # The batch is used several times; its source is read once.
        batch = batch.persist()
        try:
            write(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The table of a stopped stream in the new folder ``target``: all batches but the last as one.

    The last batch keeps its own folder, as the stream may run it again and overwrite it.  Merged
    rows are range-partitioned by recommendation, so that a batch's id range reads few files.
    """
    table = stored_reactions(spark, path)
    last = table.agg(F.max(BATCH)).first()[0]
    columns = REACTION_SCHEMA.fieldNames()
    earlier = table
    if last is not None and last >= 0:
        _append(table.filter(F.col(BATCH) == last).select(*columns), target, last)
        earlier = table.filter(F.col(BATCH) < last)
    _append(earlier.select(*columns).repartitionByRange("recommendation_id"), target, -1)


def create_table(spark: SparkSession, path: str) -> None:
    """An empty table, as batch -1, so that the first batch can read it."""
    _append(spark.createDataFrame([], REACTION_SCHEMA), path, -1)


def store_reactions(
    stream: DataFrame, path: str, checkpoint: str, order: list[str]
) -> DataStreamWriter:
    """Store a stream of reactions, first write wins; ``order`` ranks rows of one batch."""
    stream = stream.select(*dict.fromkeys([*REACTION_SCHEMA.fieldNames(), *order]))

    def write(batch: DataFrame, number: int) -> None:
        rows = accepted_rows(_earlier(batch, path, number), batch, REACTION_KEY, order)
        _append(rows, path, number)

    return _start(stream, checkpoint, write)


def store_requests(
    stream: DataFrame,
    recommendations: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    order: list[str],
    at: str,
    outcomes: str,
) -> DataStreamWriter:
    """Judge a stream of requests, store what is accepted, and write every outcome.

    ``recommendations`` is called per batch, so that new ones are seen.
    """

    def write(batch: DataFrame, number: int) -> None:
        judged = materialize(
            adjudicate_reactions(batch, recommendations(), _earlier(batch, path, number), order),
            "judged",
        )
        _append(created_reactions(judged, at), path, number)
        judged.write.mode("overwrite").parquet(f"{outcomes}/{BATCH}={number}")

    return _start(stream, checkpoint, write)
