"""Unique user names of the form adjective_noun + hex digits, four of them unless more names are needed.

The names of one width are numbered, and a keyed permutation of the numbers says which name stands
at which position: a Feistel network over pairs of numbers below 10 * 4**width, of which there are
as many as names, so that positions never meet in a name.  Users take free positions in the order
of their keys; nothing is drawn, and the number of jobs does not depend on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.plans.materialize import materialize
from matchspark.plans.ranking import rank_within

# The words names are made of.
ADJECTIVES = [
    "fast", "lazy", "clever", "curious", "brave", "mighty", "silent", "noisy", "happy", "grumpy",
]
NOUNS = ["lion", "tiger", "panda", "fox", "eagle", "shark", "wolf", "dragon", "otter", "koala"]


WIDTH = 4
ROUNDS = 6


def names_of_width(width: int) -> int:
    return len(ADJECTIVES) * len(NOUNS) * 16**width


def _side(width: int) -> int:
    """The root of the number of names."""
    return 10 * 4**width


def _shift(part: Column, number: Column, seed: str, side: int) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(seed), number.cast("string"), part.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % side


def number_at(position: Column, seed: str, width: int = WIDTH) -> Column:
    """The number of the name at a position; one to one over all numbers of the width."""
    side = _side(width)
    start = F.struct(F.floor(position / side).cast("bigint").alias("a"), (position % side).cast("bigint").alias("b"))
    step = lambda s, i: F.struct(s["b"].alias("a"), ((s["a"] + _shift(s["b"], i, seed, side)) % side).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * side + s["b"])


def position_of(number: Column, seed: str, width: int = WIDTH) -> Column:
    """The position at which a number stands: the rounds of ``number_at`` backwards."""
    side = _side(width)
    start = F.struct(F.floor(number / side).cast("bigint").alias("a"), (number % side).cast("bigint").alias("b"))
    step = lambda s, i: F.struct(F.pmod(s["b"] - _shift(s["a"], i, seed, side), F.lit(side)).alias("a"), s["a"].alias("b"))
    return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0)), start, step, lambda s: s["a"] * side + s["b"])


def name_of(number: Column, width: int = WIDTH) -> Column:
    word = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    pair = F.floor(number / 16**width)
    suffix = F.lpad(F.lower(F.hex((number % 16**width).cast("bigint"))), width, "0")
    return F.concat(word(ADJECTIVES, F.floor(pair / len(NOUNS))), F.lit("_"), word(NOUNS, pair), suffix)


def number_of(name: Column, width: int = WIDTH) -> Column:
    """The number of a name; null if it is none of this width."""
    shape = rf"^({'|'.join(ADJECTIVES)})_({'|'.join(NOUNS)})([0-9a-f]{{{width}}})$"
    part = lambda i: F.regexp_extract(name, shape, i)
    place = lambda words, i: F.array_position(F.array(*map(F.lit, words)), part(i)) - 1
    whole = (place(ADJECTIVES, 1) * len(NOUNS) + place(NOUNS, 2)) * 16**width + F.conv(part(3), 16, 10).cast("bigint")
    return F.when(name.rlike(shape), whole)


def user_name_at(position: Column, seed: str = "", width: int = WIDTH) -> Column:
    """The name at a position, from 0."""
    return name_of(number_at(position, seed, width), width)


def assign_user_names(
    df: DataFrame, key: str, taken: DataFrame | None = None, seed: str = "", start: int = 0, width: int = WIDTH
) -> DataFrame:
    """``df`` with a ``user_name`` that is unique over its rows and ``taken``; ``key`` is unique.

    Rows get the free positions from ``start`` on in the order of their keys; whoever counts the
    names given so far passes the count, so that positions in use are not looked at again.  Where
    a width has too few names left, all rows get the next one.
    """
    n = df.count()
    spark = df.sparkSession
    names = spark.range(0).select(F.lit("").alias("user_name")) if taken is None else taken.select("user_name")
    # Written between the steps, as Spark would otherwise repeat the rounds wherever their result is named.
    names = materialize(names, "taken")
    while True:
        numbers = materialize(names.select(number_of(F.col("user_name"), width).alias("number")), "numbers")
        used = numbers.filter("number is not null").distinct()
        used = materialize(used.select(position_of(F.col("number"), seed, width).alias("position")), "used")
        used = used.filter(F.col("position") >= start)
        end = start + n + used.count()
        if end <= names_of_width(width):
            break
        width, start = width + 1, 0
    free = spark.range(start, end).withColumnRenamed("id", "position").join(used, "position", "left_anti")
    free = rank_within(free.withColumn("all", F.lit(0)), "all", "position").select("position", "rank")
    ranked = rank_within(df.select(F.lit(0).alias("all"), F.col(key).alias("_key")), "all", "_key").select("_key", "rank")
    numbered = ranked.join(free, "rank").select("_key", number_at(F.col("position"), seed, width).alias("number"))
    named = numbered.select("_key", name_of(F.col("number"), width).alias("user_name"))
    return df.join(named, df[key].eqNullSafe(named["_key"])).drop("_key")
