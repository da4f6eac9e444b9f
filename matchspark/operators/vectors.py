"""Embedding queue, embeddings, and nearest partners by inner product."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.plans.tiles import merge_top_k, tile_rows_for, tiled_top_k
from matchspark.schemas import EMBEDDING_DIMENSION

OBJECT_KEY = ["object_id", "object_type"]


def enqueue_embeddings(
    embeddings: DataFrame, candidates: DataFrame, positions: DataFrame, now: Column
) -> DataFrame:
    """A pending row for every profile (``id`` column) that has no embedding row yet."""
    profiles = candidates.select(
        F.col("id").alias("object_id"), F.lit("candidate").alias("object_type")
    ).unionAll(positions.select("id", F.lit("position")))
    return profiles.join(embeddings.select(*OBJECT_KEY), OBJECT_KEY, "left_anti").select(
        *OBJECT_KEY,
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit("pending").alias("status"),
    )


def profile_texts(candidates: DataFrame, positions: DataFrame) -> DataFrame:
    """(object_id, object_type, text) of every profile."""
    return candidates.select(
        F.col("id").alias("object_id"), F.lit("candidate").alias("object_type"),
        F.col("about").alias("text"),
    ).unionAll(
        positions.select("id", F.lit("position"), F.concat_ws(" ", "title", "description", "company"))
    )


def hashed_vectors(texts: DataFrame, dimension: int) -> DataFrame:
    """``texts`` with ``vector``: word counts hashed into ``dimension`` buckets, unit length."""
    words = RegexTokenizer(
        inputCol="text", outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False
    ).transform(texts)
    counts = HashingTF(numFeatures=dimension, inputCol="_words", outputCol="_counts").transform(
        words
    )
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counts)
    vector = F.when(F.size("_words") > 0, vector_to_array("_unit", "float32"))
    return unit.withColumn("vector", vector).drop("_words", "_counts", "_unit")


Model = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def modelled_vectors(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` with ``vector`` from a user's model: batches of texts in, of vectors out.

    The model sees an iterator of batches, so it can load its weights once per task.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from model(batches)

    return texts.withColumn("vector", F.pandas_udf(run, "array<float>")("text"))


def embed_pending(
    embeddings: DataFrame,
    texts: DataFrame,
    now: Column,
    dimension: int = EMBEDDING_DIMENSION,
    model: Model | None = None,
) -> DataFrame:
    """The pending rows with their vector and status done, or failed.

    A row fails when its profile is gone, its text holds no word, or the vector
    has the wrong length.
    """
    pending = embeddings.filter(F.col("status") == "pending").select(*OBJECT_KEY, "created_at")
    # Words may be absent from a text but the join keeps the row, so that it fails.
    joined = pending.join(texts, OBJECT_KEY, "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    made = modelled_vectors(joined, model) if model else hashed_vectors(joined, dimension)
    good = F.col("vector").isNotNull() & (F.size("vector") == dimension) & (F.trim("text") != "")
    return (
        made.withColumn("_good", F.coalesce(good, F.lit(False)))
        .select(
            *OBJECT_KEY,
            "created_at",
            now.alias("updated_at"),
            F.when(F.col("_good"), F.col("vector")).alias("embedding"),
            F.when(F.col("_good"), "done").otherwise("failed").alias("status"),
        )
    )


def done_vectors(embeddings: DataFrame, object_type: str, row_id: str, dimension: int) -> DataFrame:
    """(row_id, vector) of the finished rows of one type; ``unusable_vectors`` has those left out."""
    return embeddings.filter(
        (F.col("status") == "done")
        & (F.col("object_type") == object_type)
        & (F.size("embedding") == dimension)
    ).select(F.col("object_id").alias(row_id), F.col("embedding").alias("vector"))


def unusable_vectors(embeddings: DataFrame, dimension: int) -> DataFrame:
    """(object_id, object_type, reason): finished rows that the searches leave out, for want of a vector or by its length."""
    reason = F.when(F.col("embedding").isNull(), "no_vector").when(F.size("embedding") != dimension, "wrong_length")
    return embeddings.filter(F.col("status") == "done").select(*OBJECT_KEY, reason.alias("reason")).filter("reason is not null")


def inner_product_topk(
    embeddings: DataFrame,
    k: int,
    left: str = "candidate",
    right: str = "position",
    dimension: int = EMBEDDING_DIMENSION,
    tile_rows: int | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """(left_id, right_id, score, rank): the k largest inner products, exactly.

    Pairs in ``known`` (left_id, right_id) are left out before ranking.  Work grows with
    |left| x |right|: for large tables on both sides use ``inner_product_topk_approx``.
    """
    best = tiled_top_k(
        done_vectors(embeddings, left, "left_id", dimension),
        done_vectors(embeddings, right, "right_id", dimension),
        k,
        tile_rows or tile_rows_for(dimension),
        known=known,
    )
    return merge_top_k(best, k)


def sign_buckets(
    rows: DataFrame, dimension: int, tables: int, bits: int, seed: int = 0, probe: bool = False
) -> DataFrame:
    """``rows`` once per hash table, with (table, bucket): the signs against random planes.

    With ``probe`` also once per bucket that differs in one bit.
    """
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dimension))
    weights = 2 ** np.arange(bits)

    def signs(vectors: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        side = np.stack(vectors.to_numpy()).astype("float64") @ planes.T > 0
        buckets = side.reshape(len(vectors), tables, bits) @ weights
        return pd.Series(list(buckets.astype("int32")))

    buckets = F.pandas_udf(signs, T.ArrayType(T.IntegerType()))
    placed = rows.select("*", F.posexplode(buckets("vector")).alias("table", "bucket"))
    if not probe:
        return placed
    flips = [0, *[1 << bit for bit in range(bits)]]
    near = F.explode(F.array(*[F.col("bucket").bitwiseXOR(F.lit(flip)) for flip in flips]))
    return placed.withColumn("bucket", near)


def inner_product_topk_approx(
    embeddings: DataFrame,
    k: int,
    left: str = "candidate",
    right: str = "position",
    dimension: int = EMBEDDING_DIMENSION,
    tables: int = 16,
    bits: int = 6,
    seed: int = 0,
    tile_rows: int | None = None,
    probe: bool = False,
    known: DataFrame | None = None,
) -> DataFrame:
    """As ``inner_product_topk`` among pairs that share a bucket in some hash table.

    Scores are exact; a partner that shares no bucket is missed.  More tables find
    more, more bits compare less; ``probe`` also looks where one bit differs.  A
    bucket of any size is cut into tiles.
    """

    def side(object_type: str, row_id: str) -> DataFrame:
        rows = done_vectors(embeddings, object_type, row_id, dimension)
        return sign_buckets(rows, dimension, tables, bits, seed, probe and row_id == "left_id")

    best = tiled_top_k(
        side(left, "left_id"),
        side(right, "right_id"),
        k,
        tile_rows or tile_rows_for(dimension),
        ["table", "bucket"],
        known,
    )
    return merge_top_k(best.distinct(), k)
