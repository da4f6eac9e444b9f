"""Reactions as a stream with state per bucket of keys: first write wins, no stored file is read again.

The state of a bucket lists the taken keys whose hash falls into it.  It has no expiry, as a stored
reaction never changes, and lives in the state store of the stream (RocksDB, see ``STATE_SETTINGS``),
so its size is bounded by the executors' disks, not their memory.  Keys stored before the stream's
first start are loaded once, as initial state; a later batch reads its own rows and the taken keys of
its buckets.  A bucket is one call of Python for many keys, whose rows are judged as a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from matchspark.operators.ingest import ACCEPTED, EXISTS, REACTION_KEY
from matchspark.plans.materialize import freed

#: What the session needs for such streams; a session of ``matchspark.session`` has it.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch then uploads its changes instead of whole snapshots.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A store holds at most two such buffers outside the heap; an executor has several stores per core.
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "32",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
}


#: Buckets of keys; a stream keeps the number of its first start.
BUCKETS = 4096
# Names that start with an underscore do not reach Python.
BUCKET, KEY = "key_bucket", "key_text"


def packed(keys: list[str]) -> bytes:
    """Key texts, which hold no line break, in about a tenth of their size: neighbours share most of it."""
    return zlib.compress("\n".join(sorted(keys)).encode(errors="surrogatepass"), 1)


def unpacked(keys: bytes) -> list[str]:
    return zlib.decompress(keys).decode(errors="surrogatepass").split("\n")


class FirstWins(StatefulProcessor):
    """Passes the rows of a bucket on with their outcome; the first one ever of a key is accepted.

    Of a key's rows of one batch the first by ``order`` counts (null first).  They are read part by
    part with one row held back for each key not taken yet, so a key may have any number of them.
    """

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        # An element for each batch that has taken keys of the bucket, packed.
        self.taken = handle.getListState("taken", T.StructType([T.StructField("keys", T.BinaryType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.taken.appendValue((packed(initialState[KEY].tolist()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        taken = {k for (keys,) in self.taken.get() for k in unpacked(keys)}
        first: pd.DataFrame | None = None
        for df in rows:
            known = df[KEY].isin(taken)
            if known.any():
                yield self._judged(df[known], EXISTS)
                df = df[~known]
            if df.empty:
                continue
            some = df if first is None else pd.concat([first, df], ignore_index=True)
            some = some.sort_values(self.order, kind="stable", na_position="first", ignore_index=True)
            again = some.duplicated(KEY)
            first = some[~again]
            if again.any():
                yield self._judged(some[again], EXISTS)
        if first is not None:
            self.taken.appendValue((packed(first[KEY].tolist()),))
            yield self._judged(first, ACCEPTED)

    @staticmethod
    def _judged(rows: pd.DataFrame, outcome: str) -> pd.DataFrame:
        return rows.drop(columns=[BUCKET, KEY]).assign(outcome=outcome)

    def close(self) -> None:
        pass


def _by_bucket(rows: DataFrame) -> GroupedData:
    """Rows with their key as one text, grouped by its bucket."""
    key = F.to_json(F.struct(*REACTION_KEY))
    keyed = rows.withColumn(KEY, key).withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)))
    return keyed.groupBy(BUCKET)


def reaction_outcomes(stream: DataFrame, stored: DataFrame | None, order: list[str]) -> DataFrame:
    """The stream's rows with ``outcome``, as ``ingest.ingest_reactions`` gives it for its batches one after the other.

    ``stored`` are the reactions the table holds at the first start; it is read then only.
    """
    shape = T.StructType([*stream.schema.fields, T.StructField("outcome", T.StringType())])
    initial = None if stored is None else _by_bucket(stored.select(*REACTION_KEY).distinct())
    return _by_bucket(stream).transformWithStateInPandas(FirstWins(order), shape, "Append", "None", initial)


def start_keyed(
    stream: DataFrame, stored: DataFrame | None, path: str, checkpoint: str, order: list[str], **trigger
) -> StreamingQuery:
    """Append the accepted rows to the folder ``path``, each once; ``trigger`` as of ``DataStreamWriter.trigger``.

    Besides ``stored``, the table is what ``path`` holds.  Its file log makes a batch run again store its rows once.
    """
    accepted = reaction_outcomes(stream, stored, order).filter(F.col("outcome") == ACCEPTED).drop("outcome")
    write = accepted.writeStream.format("parquet").option("path", path).option("compression", "zstd")
    with freed(stream.sparkSession):
        return write.option("checkpointLocation", checkpoint).trigger(**trigger).start()
