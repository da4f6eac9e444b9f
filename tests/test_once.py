"""Steps that several parts of a job read are computed once."""

from pyspark.sql import functions as F

from checks.fixture import Fixture, OnceFixture
from checks.identity_queries import _by_year
from matchspark.functions.usernames import assign_user_names, user_name_at
from matchspark.plans.tiles import tiled_top_k


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_lines_are_joined_once(spark, sf_dir):
    plain, once = Fixture(spark, sf_dir), OnceFixture(Fixture(spark, sf_dir), tables=True)
    files = lambda df: " ".join(df.inputFiles())
    for name in ("recommendation_batch", "reaction_log", "recommendations", "reactions"):
        assert "lineitem" in files(getattr(plain, name)) and "lineitem" not in files(getattr(once, name))
        assert sorted(map(str, getattr(plain, name).collect())) == sorted(map(str, getattr(once, name).collect()))


def test_a_year_of_the_log_reads_its_own_folder(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    by_year, years = _by_year(fx)
    assert by_year.count() == fx.reaction_log.count() and len(years) > 2
    assert all("lineitem" not in f for f in by_year.inputFiles())


def test_rounds_of_names_are_not_repeated(spark):
    ids = spark.range(50).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("id"))
    taken = spark.range(20).select(user_name_at(F.col("id") * 3, "n").alias("user_name"))
    named = assign_user_names(ids, "id", taken, seed="n")
    # Six rounds in one expression, for the names that are given.
    assert plan_of(named).count("sha2(") == 1
    rows = named.collect()
    assert len({r.user_name for r in rows} | {r.user_name for r in taken.collect()}) == 70


def test_pairs_of_rows_without_vectors_stay_away(spark):
    rows = lambda side, n: spark.createDataFrame([(f"{side}{i}", [float(i), 1.0]) for i in range(n)], f"{side}_id string, vector array<double>")
    known = spark.createDataFrame([("left0", "right3"), ("left9", "right3"), ("left0", "right9"), (None, "right0")], "left_id string, right_id string")
    best = tiled_top_k(rows("left", 3), rows("right", 4), 2, 2, known=known)
    assert plan_of(best).count("LeftSemi") == 2
    got = {(r.left_id, r.right_id) for r in best.collect()}
    assert ("left0", "right3") not in got and ("left1", "right3") in got
