"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Sources in code-point order, null last, take the weights ``WEIGHTS`` in turn.  Their targets
share all words by weight; a target stops at ``REPEATS`` times its source's size and what is
over is shared again by weight (solved in closed form over the sources sorted by size/weight).

Inside a source documents stand in the order of md5(doc_id).  A copy e of a document covers
the words e * source_size + (words before it) .. + size of the source's demand; it is taken
when its middle lies within the target.  So taken words differ from the target by half a
document at most, and no document is taken more than ``REPEATS`` times.

The weight of a source changes over training time t in [0, 1] as 1 + slope * (2t - 1).  Its
integral, t + slope * (t*t - t), is the part of the demand met by t; inverting it at the
middle of a copy gives the copy's training position.

Null text has size 0; a source of size 0 has target 0.  Sizes of 0 are never taken.  A
repeated doc_id is a document each time.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.workdir import stored

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
REPEATS = 3
#: Hex digits of md5 by which a source is cut into slices for its running sums.
DIGITS = 3


def _turn(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, slope) from (source, source_size); one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", _turn(weights, F.col("place")).cast("long"))
        .withColumn("slope", _turn(slopes, F.col("place")))
        .withColumn("cap", F.lit(repeats).cast("long") * F.col("source_size"))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    solved = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(ahead), F.lit(0)))
        .withColumn("full", F.col("left") * F.col("weight") > F.col("cap") * F.sum("weight").over(rest))
        .withColumn("open_words", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    )
    shared = (F.col("weight") * F.col("open_words")).cast("double") / F.col("open_weight")
    return solved.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared).alias("target"), "slope")


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    slopes: tuple[float, ...] = SLOPES,
    repeats: int = REPEATS,
    digits: int = DIGITS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, copies, taken, and positions (array of copies' times)."""
    sized = docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffle_key"),
        *[F.col(c) for c in keep],
    ).withColumn("slice", F.substring("shuffle_key", 1, digits))
    # Slices of a source are summed before anything is gathered, so a hot source is no hot key.
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    goals = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, slopes, repeats)
    goals = goals.select(F.col("source").alias("goal_source"), "source_size", "target", "slope")
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("ahead", F.coalesce(F.sum("words").over(running), F.lit(0)))
    starts = starts.join(goals, starts["source"].eqNullSafe(goals["goal_source"])).select(
        F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), "ahead", "source_size", "target", "slope"
    )
    inside = Window.partitionBy("source", "slice").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["s_source"]) & (placed["slice"] == starts["s_slice"]))
    middle = lambda e: 2 * (F.col("source_size") * e + F.col("ahead") + F.col("before")) + F.col("size")
    copies = sum(
        (F.when((F.col("size") > 0) & (middle(e).cast("double") <= 2 * F.col("target")), 1).otherwise(0) for e in range(repeats)), F.lit(0)
    ).cast("int")

    def position(e: Column) -> Column:
        part = F.least(F.lit(1.0), middle(e).cast("double") / (2 * F.col("target")))
        a = F.col("slope")
        return 2 * part / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * part))

    return placed.withColumn("copies", copies).select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>")).alias("positions"),
        *keep,
    )


def _copies(docs: DataFrame, **options) -> DataFrame:
    """All copies of the mix: the documents' columns, position, copy and ``__row``, the hash of a whole row."""
    names = [c for c in docs.columns if c not in ("position", "copy")]
    # Only narrow rows are planned; the rows are joined again and range-sorted by position once.
    keyed = _keyed(docs).withColumn("__same", F.xxhash64(F.lit(1), *[F.col(c) for c in names]))
    spread = plan(keyed, keep=("__row",), **options).select("__row", "positions")
    rows = keyed.join(spread.groupBy("__row").agg(F.count(F.lit(1)).alias("__rows"), F.max("positions").alias("positions")), "__row")
    alone = rows.where("__rows = 1").select(*names, "__row", F.posexplode("positions").alias("copy", "position"))
    # Of equal rows one carries the text for the copies of all; tasks pass on one row of each group.
    several = rows.where("__rows > 1").drop("positions").dropDuplicates(["__same"])
    copies = spread.select("__row", F.posexplode("positions").alias("copy", "position"))
    return alone.unionByName(several.join(copies, "__row").select(*names, "__row", "copy", "position"))


def _keyed(docs: DataFrame) -> DataFrame:
    names = [c for c in docs.columns if c not in ("position", "copy")]
    return docs.select(*names).withColumn("__row", F.xxhash64(*[F.col(c) for c in names]))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """All copies of the mix in training order: the documents' columns, with position and copy (from 0).

    Equal rows stand for each other: each copy of one of them comes out once, and their copies
    are numbered per row.  Clashing input columns named ``position`` or ``copy`` are replaced.
    """
    return _copies(docs, **options).drop("__row").orderBy("position", "copy", "doc_id")


def shares(docs: DataFrame, **options) -> DataFrame:
    """Per document what the mix holds of it: doc_id, size, source_size, target, copies, taken, position (of its first copy).

    The copies are brought into training order and written as (row, copy, position), the order in
    which ``mixed`` gives the texts; each document's copies are then found in it.
    """
    order = stored(_copies(docs, **options).orderBy("position", "copy", "doc_id").select(F.col("__row").alias("o_row"), F.col("position").alias("at")), "order")
    columns = ["doc_id", "size", "source_size", "target"]
    planned = plan(_keyed(docs), keep=("__row",), **options)
    wanted = planned.select(*columns, "__row", F.try_element_at("positions", F.lit(1)).alias("first"), F.explode_outer("positions").alias("wanted"))
    met = wanted.join(order, (F.col("__row") == F.col("o_row")) & (F.col("wanted") == F.col("at")), "left")
    # Equal rows have first copies of their own; rows without copies stay single.
    chosen = met.where("first is not null").groupBy(*columns, "__row", "first").agg(F.count("at").cast("int").alias("copies"), F.min("at").alias("position"))
    left_out = planned.where(F.size("positions") == 0).select(*columns, "__row", F.lit(None).cast("double").alias("first"), F.lit(0).alias("copies"), F.lit(None).cast("double").alias("position"))
    return chosen.unionByName(left_out).select(*columns, "copies", (F.col("copies") * F.col("size")).alias("taken"), "position")
