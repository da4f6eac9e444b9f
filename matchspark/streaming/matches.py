"""Matches as both sides react."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.operators.ingest import REACTION_KEY


def stream_matches(
    reactions: DataFrame,
    recommendations: DataFrame,
    positions: DataFrame,
    late: str,
    apart: str,
) -> DataFrame:
    """(candidate_id, position_id, created_at) from a stream of stored reactions.

    ``reactions`` holds the first write of each key (see ``streaming.reactions``); a
    row read twice after a restart is dropped.  Rows later than ``late`` behind the
    newest are ignored, and pairs further than ``apart`` from each other are not
    found: the batch job ``matching.derive_matches`` has no such bound.
    """
    timed = reactions.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    owners = positions.select(F.col("id").alias("position_id"), "recruiter_id")
    recommended = recommendations.select(F.col("id").alias("recommendation_id"), "candidate_id", "position_id")

    def side(reactor_type: str, reactor: str, at: str) -> DataFrame:
        # The type is part of the key, so a side keeps state of its own rows only; what a row says is
        # not, so that a first write is kept whatever it says.  Naming the time here keeps Spark from
        # moving the filter below the watermark, which follows the newest row of both sides.
        kind = F.coalesce(F.when(F.col("at").isNull(), F.col("reactor_type")), F.col("reactor_type"))
        events = timed.filter(kind == reactor_type).dropDuplicatesWithinWatermark(REACTION_KEY)
        return events.filter(F.col("reaction_type") == "positive").select(
            "recommendation_id", F.col("reactor_id").alias(reactor), F.col("at").alias(at)
        )

    # With the owning recruiter on the candidates' side the join of the two streams
    # uses the whole reaction key: at most one partner per row.  Only what was liked meets the owners,
    # as every batch does these joins.
    liked = (
        side("candidate", "candidate_id", "c_at")
        .join(recommended, ["recommendation_id", "candidate_id"])
        .join(owners, "position_id")
    )
    answers = side("recruiter", "r_recruiter", "r_at").withColumnRenamed(
        "recommendation_id", "r_recommendation"
    )
    bound = F.expr(f"INTERVAL {apart}")
    return liked.join(
        answers,
        (F.col("recommendation_id") == F.col("r_recommendation"))
        & (F.col("recruiter_id") == F.col("r_recruiter"))
        & F.col("r_at").between(F.col("c_at") - bound, F.col("c_at") + bound),
    ).select(
        "candidate_id",
        "position_id",
        F.greatest("c_at", "r_at").cast("timestamp_ntz").alias("created_at"),
    )
