import pytest
from pyspark.sql import functions as F

from checks.fixture import Fixture
from matchspark.functions import usernames
from matchspark.operators import identity


@pytest.mark.parametrize(
    "provider, claims, user, want",
    [
        ("google", '{"sub":"1","email":"e","email_verified":true,"name":"A B"}', None,
         ("1", "e", "A B", None)),
        ("google", '{"sub":"1","email_verified":true,"name":"A"}', None, ("1", "", "A", None)),
        ("google", '{"sub":"1","email":"e","name":"A"}', None, (None, None, None, "email_not_verified")),
        ("google", '{"sub":"1","email_verified":"true","name":"A"}', None,
         (None, None, None, "unreadable_claims")),
        ("google", '{"sub":"1","email_verified":true}', None,
         (None, None, None, "name_forbidden_chars")),
        ("apple", '{"sub":"1","email":"e","email_verified":"false"}', "{}", ("1", "e", " ", None)),
        ("apple", '{"sub":"1","email":"e"}', '{"name":{"firstName":"A1","lastName":"<b>"}}',
         ("1", "e", "A1 <b>", None)),
        ("apple", '{"sub":"1","email":"e"}', '{"name":', ("1", "e", "", None)),
        ("apple", '{"sub":"1","email":"e"}', "", ("1", "e", "", None)),
        ("apple", '{"sub":"1","email_verified":true}', None, (None, None, None, "unreadable_claims")),
        ("apple", "[]", None, (None, None, None, "unreadable_claims")),
    ],
)
def test_claims(spark, provider, claims, user, want):
    df = spark.createDataFrame(
        [(provider, claims, user)], "provider string, claims_json string, user_json string"
    )
    r = identity.claims_to_users(df).first()
    assert (r.provider_user_id, r.email, r.full_name, r.error) == want


def test_claims_are_parsed_once_for_all_kinds(spark):
    df = spark.createDataFrame([("apple", "{}", "")], "provider string, claims_json string, user_json string")
    plan = identity.claims_to_users(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("from_json") == 3


def test_session_edges(spark):
    tokens = spark.createDataFrame(
        [("a", "2024-01-02", False), ("b", "2024-01-01", False), ("c", "2024-01-02", True),
         ("d", "2024-01-02", None)],
        "jti string, expires_at string, revoked boolean",
    ).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    asked = spark.createDataFrame([(j,) for j in "abcdx"], "jti string")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    got = {r.jti: r.state for r in identity.session_state(asked, tokens, now).collect()}
    assert got == {"a": "active", "b": "invalid", "c": "revoked", "d": "error", "x": "invalid"}


def test_positions_and_names_are_one_to_one(spark):
    """All numbers of a small width, and some of the usual one, there and back."""
    every = usernames.names_of_width(1)
    small = spark.range(every).select("id", usernames.number_at(F.col("id"), "s", 1).alias("n"))
    assert small.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (every, 0, every - 1)
    assert small.filter(F.col("id") != usernames.position_of(F.col("n"), "s", 1)).count() == 0
    some = spark.range(0, usernames.names_of_width(4), 9973).select("id", usernames.user_name_at(F.col("id"), "s").alias("name"))
    assert some.filter(F.col("id") != usernames.position_of(usernames.number_of(F.col("name")), "s")).count() == 0


def test_user_names_are_unique_when_a_width_runs_out(spark):
    ids = spark.range(1700).select(F.format_string("usr_%04d", "id").alias("id"))
    named = usernames.assign_user_names(ids, "id", seed="s", width=1).collect()
    assert len(named) == len({r.user_name for r in named}) == 1700
    assert {len(r.user_name.split("_")[1].lstrip("abcdefghijklmnopqrstuvwxyz")) <= 2 for r in named} == {True}


def test_taken_names_are_passed_over(spark):
    ids = spark.range(700).select(F.format_string("usr_%04d", "id").alias("id"))
    taken = spark.range(0, 1600, 2).select(usernames.user_name_at(F.col("id"), "s", 1).alias("user_name"))
    other = spark.createDataFrame([("fast_lion",), (None,), ("Fast_lion00",), ("someone else",)], "user_name string")
    named = {r.id: r.user_name for r in usernames.assign_user_names(ids, "id", taken.unionAll(taken).unionAll(other), "s", width=1).collect()}
    free = [r[0] for r in spark.range(1, 1600, 2).orderBy("id").select(usernames.user_name_at(F.col("id"), "s", 1)).collect()]
    assert [named[k] for k in sorted(named)] == free[:700]
    later = usernames.assign_user_names(ids.limit(50), "id", taken, "s", start=1400, width=1).collect()
    assert {r.user_name for r in later} == set(free[700:750])


def test_names_of_keys_that_differ_in_case_or_are_null(spark):
    ids = spark.createDataFrame([("a",), ("A",), (None,), ("",)], "id string")
    assert len({r.user_name for r in usernames.assign_user_names(ids, "id").collect()}) == 4
    assert usernames.assign_user_names(ids.limit(0), "id").collect() == []


def test_user_name_shape(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("id"))
    words = "|".join(usernames.ADJECTIVES), "|".join(usernames.NOUNS)
    named = usernames.assign_user_names(ids, "id")
    assert named.filter(~F.col("user_name").rlike(rf"^({words[0]})_({words[1]})[0-9a-f]{{4}}$")).count() == 0
    assert named.select("user_name").distinct().count() == 500


def test_sign_ins_become_users(spark, sf_dir):
    """Unknown identities get one row each with an id and a free name."""
    fx = Fixture(spark, sf_dir)
    name = usernames.user_name_at(F.xxhash64("id").bitwiseAND(0xFFFF))
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    users = fx.users.withColumn("user_name", name).dropDuplicates(["user_name"]).withColumn("updated_at", now)
    outcomes = identity.signin_outcome(fx.sign_ins, users, fx.candidates, fx.recruiters)
    claims = outcomes.select("seq", F.lit("a@example.com").alias("email"), F.lit("A").alias("full_name"))
    made = identity.new_users(outcomes, claims, users, now)
    assert made.columns == users.columns
    rows = made.collect()
    assert len(rows) == outcomes.filter("outcome = 'create_user'").count() > 0
    names = [r.user_name for r in rows] + [r.user_name for r in users.select("user_name").collect()]
    assert len(set(names)) == len(names) and len({r.id for r in rows}) == len(rows)
