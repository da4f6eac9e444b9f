"""Matches as both sides react, with nothing lost beyond the time that a side is waited for.

A recommendation's first side waits in the stream's state.  If the other side comes while it waits,
the match is written.  When the watermark passes its time, the side itself is written as ``waiting``
and its state is dropped, so state holds recent sides only.  A side that comes later than that waits
by itself and is written in its turn; ``all_matches`` meets the two.

State is kept per bucket of recommendations, so that Python is called for many of them at once and
meets their sides as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from matchspark.plans.materialize import freed

MATCH, WAITING = "match", "waiting"
CANDIDATE, RECRUITER = "candidate", "recruiter"
OUT = "recommendation_id string, candidate_id string, position_id string, side string, at long, kind string"


#: Buckets of recommendations; a stream keeps the number of its first start.
BUCKETS = 4096
BUCKET = "bucket"
_SIDE = ["recommendation_id", "candidate_id", "position_id", "side", "at"]


class Pairs(StatefulProcessor):
    """The sides of a bucket that wait for the other side, ``wait_ms`` at most; at in microseconds."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField(n, T.ArrayType(T.LongType() if n == "at" else T.StringType())) for n in _SIDE]
        self.waiting = handle.getValueState("waiting", T.StructType(fields))

    def _held(self) -> pd.DataFrame:
        held = self.waiting.get()
        return pd.DataFrame(dict(zip(_SIDE, held if held is not None else [[]] * len(_SIDE)))).astype({"at": "int64"})

    def _hold(self, sides: pd.DataFrame) -> None:
        if sides.empty:
            self.waiting.clear()
        else:
            self.waiting.update(tuple(sides[n].tolist() for n in _SIDE))

    def _ends(self, sides: pd.DataFrame) -> pd.Series:
        return sides["at"] // 1000 + self.wait_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        # A side reacts once; more rows of it are repeats, so two rows stand for all.
        sides, one = held, ["recommendation_id", "side"]
        for df in rows:
            sides = pd.concat([sides, df[_SIDE]], ignore_index=True).drop_duplicates(one, ignore_index=True)
        met = sides.duplicated("recommendation_id", keep=False)
        if met.any():
            pairs = sides[met].groupby("recommendation_id", sort=False)
            yield self._rows(pairs[["candidate_id", "position_id"]].nth(-1).assign(
                recommendation_id=sides["recommendation_id"], side=None, at=pairs["at"].transform("max")
            ), MATCH)
        left = sides[~met]
        self._hold(left)
        # A timer no later than the end of any side that waits; the bucket has one already if it held sides.
        if not left.empty and (held.empty or self._ends(left).min() < self._ends(held).min()):
            self.handle.registerTimer(int(self._ends(left).min()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        ends = self._ends(held)
        over = (ends <= expiredTimerInfo.getExpiryTimeInMs()) | (ends < timerValues.getCurrentWatermarkInMs())
        left = held[~over]
        if over.any():
            self._hold(left)
        if not left.empty:
            self.handle.registerTimer(int(ends[~over].min()))
        if over.any():
            yield self._rows(held[over], WAITING)

    @staticmethod
    def _rows(sides: pd.DataFrame, kind: str) -> pd.DataFrame:
        return sides.assign(kind=kind)[[*_SIDE, "kind"]]

    def close(self) -> None:
        pass


def pair_events(
    reactions: DataFrame, recommendations: DataFrame, positions: DataFrame, late: str, wait_days: float
) -> DataFrame:
    """Matches and sides no longer waited for, from a stream of stored reactions (see ``OUT``).

    The watermark stays ``late`` behind the newest row.  It only says when a side's time is over:
    rows behind it are paired or wait like others, none is dropped.  A row without time has no side.
    """
    recommended = recommendations.select(F.col("id").alias("recommendation_id"), "candidate_id", "position_id")
    owners = positions.select(F.col("id").alias("position_id"), "recruiter_id")
    # The number in place of the time keeps Spark from dropping rows behind the watermark.
    timed = (
        reactions.filter((F.col("reaction_type") == "positive") & F.col("created_at").isNotNull())
        .withColumn("_time", F.col("created_at").cast("timestamp"))
        .withWatermark("_time", late)
        .withColumn("at", F.unix_micros("_time"))
        .select("recommendation_id", "reactor_type", "reactor_id", "at")
    )
    by_owner = F.when(F.col("reactor_type") == CANDIDATE, F.col("candidate_id")).when(
        F.col("reactor_type") == RECRUITER, F.col("recruiter_id")
    )
    sides = (
        timed.join(recommended, "recommendation_id")
        .join(owners, "position_id")
        .filter(F.col("reactor_id") == by_owner)
        .select("recommendation_id", "candidate_id", "position_id", F.col("reactor_type").alias("side"), "at")
    )
    bucket = F.pmod(F.xxhash64("recommendation_id"), F.lit(BUCKETS))
    return sides.withColumn(BUCKET, bucket).groupBy(BUCKET).transformWithStateInPandas(
        Pairs(int(wait_days * 86_400_000)), OUT, "Append", "EventTime"
    )


def start_pairs(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append ``pair_events`` to ``path``, a folder for each kind, each row once."""
    write = events.writeStream.format("parquet").partitionBy("kind").option("path", path).option("compression", "zstd")
    with freed(events.sparkSession):
        return write.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def all_matches(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id, position_id, created_at): what the stream has matched, and sides that missed each other.

    It equals ``matching.derive_matches`` of the rows the stream has read, once the watermark has passed
    them by the waiting time; before that a side still waiting is in neither.
    """
    rows = spark.read.schema(OUT).parquet(path)
    apart = rows.filter(F.col("kind") == WAITING).groupBy("recommendation_id", "candidate_id", "position_id").agg(
        F.min(F.when(F.col("side") == CANDIDATE, F.col("at"))).alias("c_at"),
        F.min(F.when(F.col("side") == RECRUITER, F.col("at"))).alias("r_at"),
    )
    columns = ["recommendation_id", "candidate_id", "position_id", "at"]
    met = apart.filter("c_at is not null and r_at is not null").withColumn("at", F.greatest("c_at", "r_at"))
    both = rows.filter(F.col("kind") == MATCH).select(*columns).unionByName(met.select(*columns))
    return both.groupBy(*columns[:3]).agg(F.min("at").alias("at")).select(
        "candidate_id", "position_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("created_at")
    )
