"""Recommendations from vectors, and mutual matches from reactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.ids import assign_ids
from matchspark.operators.vectors import inner_product_topk
from matchspark.schemas import SCORE_TYPE


REACTION_COLUMNS = ["recommendation_id", "reactor_type", "reactor_id", "reaction_type", "created_at"]
#: Folders that reactions are stored in for ``match_changes``; at most so many numbers reach the driver.
PARTS = 256
PART = "part"


def derive_matches(
    reactions: DataFrame,
    recommendations: DataFrame,
    positions: DataFrame,
    matches: DataFrame | None = None,
) -> DataFrame:
    """(candidate_id, position_id, created_at) where both sides reacted positively.

    The recruiter must own the position; the match dates from the later reaction.
    Both joins use the whole reaction key, so they are one to one however many
    reactions a recommendation has.
    """
    positive = reactions.filter(F.col("reaction_type") == "positive")

    def side(reactor_type: str, reactor: str, at: str) -> DataFrame:
        return positive.filter(F.col("reactor_type") == reactor_type).select(
            "recommendation_id",
            F.col("reactor_id").alias(reactor),
            F.col("created_at").alias(at),
        )

    liked = recommendations.select(
        F.col("id").alias("recommendation_id"), "candidate_id", "position_id"
    ).join(side("candidate", "candidate_id", "_c_at"), ["recommendation_id", "candidate_id"])
    owners = positions.select(F.col("id").alias("position_id"), "recruiter_id")
    found = (
        liked.join(owners, "position_id")
        .join(side("recruiter", "recruiter_id", "_r_at"), ["recommendation_id", "recruiter_id"])
        .select(
            "candidate_id", "position_id", F.greatest("_c_at", "_r_at").alias("created_at")
        )
    )
    if matches is not None:
        found = found.join(
            matches.select("candidate_id", "position_id"),
            ["candidate_id", "position_id"],
            "left_anti",
        )
    return found


def part_of(recommendation: Column, parts: int = PARTS) -> Column:
    """The folder of a recommendation's reactions."""
    return F.pmod(F.xxhash64(recommendation), F.lit(parts)).cast("int")


def write_by_recommendation(reactions: DataFrame, path: str, parts: int = PARTS, mode: str = "append") -> None:
    """Store reactions in a folder for each part, so that changes find theirs without reading the rest."""
    placed = reactions.withColumn(PART, part_of(F.col("recommendation_id"), parts))
    placed.repartition(PART).write.mode(mode).partitionBy(PART).parquet(path)


def stored_for(changed: DataFrame, path: str, parts: int = PARTS) -> DataFrame:
    """The stored reactions in the folders of the changed recommendations."""
    spark = changed.sparkSession
    place = part_of(F.col("recommendation_id"), parts).alias(PART)
    which = [r[PART] for r in changed.select(place).distinct().collect()]
    stored = spark.read.schema(f"{changed.select(*REACTION_COLUMNS)._jdf.schema().toDDL()}, {PART} int").parquet(path)
    return stored.filter(F.col(PART).isin(which)).drop(PART)


def match_changes(
    changed: DataFrame, stored: DataFrame, recommendations: DataFrame, positions: DataFrame
) -> DataFrame:
    """(candidate_id, position_id, created_at): the matches that ``changed`` adds to those of ``stored``.

    Both hold accepted reactions and no key twice.  A match is new if one side or both are: changed
    with stored, stored with changed, changed with changed.  What ``stored`` holds of other
    recommendations does not matter, so the folders of the changed ones are enough
    (``stored_for``).  Recommendations and owners of positions are taken as they are now.
    """
    positive = F.col("reaction_type") == "positive"
    keys = changed.filter(positive).select("recommendation_id").distinct()
    rows = changed.filter(positive).select(*REACTION_COLUMNS, F.lit(True).alias("_new")).unionByName(
        stored.filter(positive).join(keys, "recommendation_id", "left_semi").select(*REACTION_COLUMNS, F.lit(False).alias("_new"))
    )

    def side(reactor_type: str, reactor: str, mark: str) -> DataFrame:
        return rows.filter(F.col("reactor_type") == reactor_type).select(
            "recommendation_id",
            F.col("reactor_id").alias(reactor),
            F.col("created_at").alias(f"{mark}_at"),
            F.col("_new").alias(f"{mark}_new"),
        )

    affected = recommendations.select(F.col("id").alias("recommendation_id"), "candidate_id", "position_id").join(
        keys, "recommendation_id", "left_semi"
    )
    owners = positions.select(F.col("id").alias("position_id"), "recruiter_id")
    liked = affected.join(side("candidate", "candidate_id", "_c"), ["recommendation_id", "candidate_id"])
    return (
        liked.join(owners, "position_id")
        .join(side("recruiter", "recruiter_id", "_r"), ["recommendation_id", "recruiter_id"])
        .filter("_c_new or _r_new")
        .select("candidate_id", "position_id", F.greatest("_c_at", "_r_at").alias("created_at"))
    )


def recommend(nearest: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(candidate_id, position_id, score) from nearest positions (left_id, right_id, score).

    The score is the inner product clipped to [0, 1], with two digits; pairs that
    are recommended already are left out.
    """
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    # Rounded as a decimal: halves go up whatever the binary value is.
    score = F.round(clipped.cast("decimal(7,6)"), 2).cast(SCORE_TYPE)
    rows = nearest.select(
        F.col("left_id").alias("candidate_id"),
        F.col("right_id").alias("position_id"),
        score.alias("score"),
    )
    pair = ["position_id", "candidate_id"]
    return rows.join(recommendations.select(*pair), pair, "left_anti")


def recommend_new(
    embeddings: DataFrame,
    recommendations: DataFrame,
    k: int,
    now: Column,
    search: Callable[..., DataFrame] = inner_product_topk,
    seed: str = "",
    **options,
) -> DataFrame:
    """(id, candidate_id, position_id, score): the k nearest positions not recommended yet.

    Pairs recommended before are passed over before ranking, so that every run finds new
    ones.  ``search`` is ``inner_product_topk`` or, for large tables,
    ``inner_product_topk_approx``; ``options`` are passed to it.
    """
    known = recommendations.select(
        F.col("candidate_id").alias("left_id"), F.col("position_id").alias("right_id")
    )
    rows = recommend(search(embeddings, k, known=known, **options), recommendations)
    made = assign_ids(rows, "rcm", now, ["position_id", "candidate_id"], seed=seed)
    return made.select("id", "candidate_id", "position_id", "score")
