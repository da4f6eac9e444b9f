"""Decide a batch of candidates' reaction requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions.bodies import MAX_BODY_BYTES, decode_bodies
from matchspark.functions.requests import valid_reaction_type
from matchspark.operators.ingest import REACTION_KEY, accepted_rows
from matchspark.plans.materialize import materialize

CREATED, BAD_REQUEST, FORBIDDEN, NOT_FOUND, CONFLICT, NO_ROLE = 201, 400, 403, 404, 409, 500


def adjudicate_reactions(
    requests: DataFrame,
    recommendations: DataFrame,
    reactions: DataFrame,
    order: list[str],
    seq: str = "seq",
) -> DataFrame:
    """The requests, without ``body``, with status, reason, reactor_type and reaction_type.

    ``requests``: seq (unique), candidate_id (NULL without the role),
    recommendation_id, body, and the ``order`` columns.  The first rule that
    applies decides; rows with status 201 are the reactions to store.
    """
    owners = recommendations.select(
        F.col("id").alias("recommendation_id"),
        F.col("candidate_id").alias("_owner"),
    )
    no_id = F.coalesce("recommendation_id", F.lit("")) == ""
    reason = (
        F.when(F.col("candidate_id").isNull(), "no_candidate_role")
        .when(no_id, "id_required")
        .when(F.col("_owner").isNull(), "recommendation_not_found")
        .when(F.col("_owner") != F.col("candidate_id"), "not_own_recommendation")
        .when(F.col("_error").isNotNull(), "invalid_body")
        .when(~valid_reaction_type("reaction_type"), "invalid_reaction_type")
    )
    # Written once: the bodies are decoded for two branches, and their conditions
    # would otherwise be pushed down as repeated regular expressions.
    read = materialize(
        decode_bodies(requests, "body", ["reaction_type"], "_error", MAX_BODY_BYTES).drop("body"),
        "requests",
    ).withColumn("reactor_type", F.lit("candidate"))
    # Whether a request names its own recommendation is the same for all requests
    # of one key, so the first well-formed one per key is found without the join,
    # on rows cut per map task however often a recommendation is named.
    well_formed = read.filter(
        F.col("candidate_id").isNotNull()
        & ~no_id
        & F.col("_error").isNull()
        & valid_reaction_type("reaction_type")
    ).select(
        *dict.fromkeys([seq, *order]),
        "recommendation_id",
        "reactor_type",
        F.col("candidate_id").alias("reactor_id"),
    )
    stored = accepted_rows(reactions, well_formed, REACTION_KEY, order).select(
        seq, F.lit(True).alias("_stored")
    )
    judged = read.join(owners, "recommendation_id", "left").withColumn("reason", reason)
    status = (
        F.when(F.col("reason") == "no_candidate_role", NO_ROLE)
        .when(F.col("reason") == "recommendation_not_found", NOT_FOUND)
        .when(F.col("reason") == "not_own_recommendation", FORBIDDEN)
        .when(F.col("reason") == "already_exists", CONFLICT)
        .when(F.col("reason").isNotNull(), BAD_REQUEST)
        .otherwise(CREATED)
    )
    return (
        judged.join(stored, seq, "left")
        .withColumn(
            "reason",
            F.when(F.col("reason").isNull() & F.col("_stored").isNull(), "already_exists").otherwise(
                F.col("reason")
            ),
        )
        .withColumn("status", status)
        .drop("_stored", "_error", "_owner")
    )


def created_reactions(judged: DataFrame, at: str) -> DataFrame:
    """The reactions to store, stamped with the request time ``at``."""
    return judged.filter(F.col("status") == CREATED).select(
        "recommendation_id",
        "reactor_type",
        F.col("candidate_id").alias("reactor_id"),
        "reaction_type",
        F.col(at).alias("created_at"),
    )
