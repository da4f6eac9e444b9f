"""Best partners by inner product, over groups of any size.

The rows of a group are cut into tiles of bounded size on both sides.  Each pair
of tiles meets in one task, which multiplies them as matrices and passes on only
the k best partners per left row; so neither a row pair nor a whole group is ever
materialised, and a group holding any share of the rows is spread over its tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_BYTES = 64 * 1024 * 1024
#: A pair of tiles is one task: small enough to keep every core of a middle-sized job busy.
TILE_ROWS = 4096
SCORE_DIGITS = 6


def tile_rows_for(dimension: int) -> int:
    """Rows of double-precision vectors that one tile holds."""
    return max(1, min(TILE_ROWS, TILE_BYTES // (8 * dimension)))


def _tile_counts(rows: DataFrame, group: list[str], tile_rows: int, name: str) -> DataFrame:
    return rows.groupBy(*group).agg(
        F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias(name)
    )


def tiled_top_k(
    left: DataFrame,
    right: DataFrame,
    k: int,
    tile_rows: int,
    group: list[str] | None = None,
    known: DataFrame | None = None,
    product: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(left_id, right_id, score): per left row the k best of each tile it meets.

    ``product`` gives the scores of left rows by right rows, -inf for pairs that are passed over; by
    default their inner products.

    The pairs of ``known`` (left_id, right_id) are passed over before ranking.  Each travels to
    the one tile pair where it would be found, once per group of its left row.

    ``left`` (left_id, vector, *group) and ``right`` (right_id, vector, *group) meet
    within equal groups.  Vectors have one length.  Products are summed in double
    precision and rounded to six digits; equal scores rank by ``right_id``.

    The tile counts of the groups are joined; without groups they are two scalar subqueries.
    """
    group = group or []
    left, right = left.filter("vector is not null"), right.filter("vector is not null")
    id_type = right.schema["right_id"].dataType
    if known is not None:
        pairs = known.select("left_id", F.col("right_id").cast(id_type).alias("known"))
        # A pair of rows that are not searched would only travel.
        pairs = pairs.join(right.select(F.col("right_id").alias("known")), "known", "left_semi")
        if group:
            pairs = pairs.join(left.select("left_id", *group), "left_id")
        else:
            pairs = pairs.join(left.select("left_id"), "left_id", "left_semi")
        pairs = pairs.filter("known is not null").withColumn("vector", F.lit(None).cast(left.schema["vector"].dataType))
    if group:
        tiles = _tile_counts(left, group, tile_rows, "_l").join(
            _tile_counts(right, group, tile_rows, "_r"), group
        )
    else:
        counts = {
            name: F.greatest(_tile_counts(rows, [], tile_rows, name).scalar(), F.lit(1))
            for name, rows in [("_l", left), ("_r", right)]
        }
    left = left.withColumn("known", F.lit(None).cast(id_type))
    if known is not None:
        left = left.unionByName(pairs.select(*left.columns))
    if group:
        left, right = left.join(tiles, group), right.join(tiles, group)
    else:
        left, right = left.withColumns(counts), right.withColumns(counts)

    def tile(row_id: str, count: str) -> Column:
        return F.pmod(F.xxhash64(row_id), F.col(count)).cast("int")

    def placed(rows: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        """Each row in its own tile, once for every tile of the other side; a known pair in its only one."""
        others = F.sequence(F.lit(0), F.col(other) - 1)
        if "known" in rows.columns:
            others = F.when(F.col("known").isNull(), others).otherwise(F.array(tile("known", other)))
        return (
            rows.withColumn(f"{own}_tile", tile(row_id, own))
            .withColumn(f"{other}_tile", F.explode(others))
            .drop("_l", "_r")
        )

    at = [*group, "_l_tile", "_r_tile"]
    meet = (
        placed(left, "left_id", "_l", "_r")
        .groupBy(*at)
        .cogroup(placed(right, "right_id", "_r", "_l").groupBy(*at))
    )
    schema = T.StructType(
        [
            T.StructField("left_id", left.schema["left_id"].dataType),
            T.StructField("right_id", right.schema["right_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    # Scores by a product of one's own take several arrays of their size.
    return meet.applyInPandas(_multiplier(k, product=product, products=1_000_000 if product else 4_000_000), schema)


def _multiplier(k: int, digits: int = SCORE_DIGITS, products: int = 4_000_000, product=None):
    """The function run per tile pair; self-contained, so workers need only numpy and pandas."""

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        pairs = left[left["known"].notna()]
        left = left[left["known"].isna()]
        if left.empty or right.empty:
            ids = pd.Series([], dtype="object")
            return pd.DataFrame({"left_id": ids, "right_id": ids, "score": ids.astype(float)})
        right = right.sort_values("right_id", kind="stable")
        right_ids = right["right_id"].to_numpy()
        b = np.stack(right["vector"].to_numpy())
        if product is None:
            b = b.astype("float64").T
        left_ids = left["left_id"].to_numpy()
        a = np.stack(left["vector"].to_numpy()).astype("float64")
        n, keep = len(right_ids), min(k, len(right_ids))
        place = np.arange(n, dtype="int64")
        strip = max(1, products // n)  # left rows multiplied at a time
        at_left = pd.DataFrame({"left_id": left_ids, "row": np.arange(len(left_ids))})
        at_right = pd.DataFrame({"known": right_ids, "column": np.arange(n)})
        hits = pairs[["left_id", "known"]].merge(at_left, on="left_id").merge(at_right, on="known")
        row, column = hits["row"].to_numpy(), hits["column"].to_numpy()
        passed = -(2**62)
        out_left, out_right, out_score = [], [], []
        for start in range(0, len(left_ids), strip):
            some = a[start : start + strip]
            score = some @ b if product is None else product(some, b)
            apart = np.isneginf(score)
            scaled = np.rint(np.where(apart, 0, score) * 10**digits).astype("int64")
            # One whole number per pair orders by score, then by id.
            order = np.where(apart, passed, scaled * n - place)
            inside = (row >= start) & (row < start + strip)
            order[row[inside] - start, column[inside]] = passed
            top = np.argpartition(-order, keep - 1, axis=1)[:, :keep]
            stays = np.take_along_axis(order, top, axis=1).ravel() != passed
            out_left.append(np.repeat(left_ids[start : start + strip], keep)[stays])
            out_right.append(right_ids[top.ravel()][stays])
            out_score.append(np.take_along_axis(scaled, top, axis=1).ravel()[stays] / 10**digits)
        return pd.DataFrame(
            {
                "left_id": np.concatenate(out_left),
                "right_id": np.concatenate(out_right),
                "score": np.concatenate(out_score),
            }
        )

    return multiply


def merge_top_k(partial: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The k best of each left row, ranked by score, then by right id."""
    best = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return partial.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) <= k)
