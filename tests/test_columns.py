"""Edge rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from matchspark.functions import ids, names, requests, roles
from matchspark.functions.bodies import decode_bodies


def clean(spark, value, function):
    r = function(spark.createDataFrame([(value,)], "v string"), "v").first()
    return r.value, r.error


def decode(spark, value):
    df = spark.createDataFrame([(value,)], "v string")
    r = decode_bodies(df, "v", ["reaction_type"]).first()
    return r.reaction_type, r.error


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, value, error",
    [
        ("O'Brien", "O&#39;Brien", None),
        (" Al ", "Al", None),
        ("<b>Ann</b>", "Ann", None),
        ("<b> x</b>", " x", None),
        ("A ", "A", None),
        ("　A ", "A", None),
        ("a b", None, "forbidden_chars"),
        ("a\u000bb", None, "forbidden_chars"),
        ("a\tb-c", "a\tb-c", None),
        ("José", None, "forbidden_chars"),
        ("R2D2", None, "forbidden_chars"),
        ("", None, "forbidden_chars"),
        (None, None, "forbidden_chars"),
        ("a" * 128, "a" * 128, None),
        ("a" * 129, None, "too_long"),
    ],
)
def test_clean_name(spark, raw, value, error):
    assert clean(spark, raw, names.clean_names) == (value, error)


def test_clean_about_allows_500(spark):
    assert clean(spark, "a" * 500, names.clean_abouts)[1] is None
    assert clean(spark, "a" * 501, names.clean_abouts)[1] == "too_long"


@pytest.mark.parametrize(
    "text, limit",
    [
        (None, 50),
        ("", 50),
        ("0", 50),
        ("-1", 50),
        ("1", 1),
        ("+7", 7),
        ("50", 50),
        ("100", 100),
        ("101", 100),
        ("99999999999", 100),
        ("99999999999999999999", 50),
        ("abc", 50),
        (" 5 ", 50),
        ("5\n", 50),
    ],
)
def test_page_limit(spark, text, limit):
    assert one(spark, text, requests.page_limit("v")) == limit


def test_flags_and_provider(spark):
    got = [one(spark, t, requests.exclude_reacted("v")) for t in ["true", "false", "no", "", None]]
    assert got == [True, False, True, True, True]
    got = [
        one(spark, t, requests.normalise_provider("v")) for t in ["", None, "google", "apple", "x"]
    ]
    assert got == ["google", "google", "google", "apple", None]


@pytest.mark.parametrize(
    "body, value, error",
    [
        ('{"reaction_type":"positive"}', "positive", None),
        (' { "Reaction_Type" : "neutral" } \n', "neutral", None),
        ("{}", "", None),
        ("null", "", None),
        ('{"reaction_type":null}', "", None),
        ('{"reaction_type":"a","reaction_type":"b"}', "b", None),
        ('{"reaction_type":"a","reaction_type":null}', "a", None),
        ('{"reaction_type":"\\u0070\\"x"}', 'p"x', None),
        ('{"reaction_type":"x"}}', "x", None),
        ('{"reaction_type":"a, \\"reaction_type\\":\\"z\\""}', 'a, "reaction_type":"z"', None),
        ('{"reaction_type":5}', None, "failed_decode"),
        ('{"reaction_type":["a"]}', None, "failed_decode"),
        ('{"reaction_type":"a","x":"b"}', None, "failed_decode"),
        ('{"reaction_type":"a",}', None, "failed_decode"),
        ('{"reaction_type":"a\nb"}', None, "failed_decode"),
        ('{"reaction_type":"a"', None, "failed_decode"),
        ('"positive"', None, "failed_decode"),
        ("", None, "failed_decode"),
        (None, None, "failed_decode"),
        ('{"reaction_type":"a"} {}', None, "extra_data"),
        ('{"reaction_type":"a"}x', None, "extra_data"),
        ("null 1", None, "extra_data"),
    ],
)
def test_decode_body(spark, body, value, error):
    assert decode(spark, body) == (value, error)


def test_decode_long_body(spark):
    text = "a" * 900_000
    assert decode(spark, '{"reaction_type":"' + text + '"}') == (text, None)
    long = '{"reaction_type":"' + "a" * 1_000_000 + '"}'
    assert decode(spark, long) == ("a" * 1_000_000, None)
    limited = decode_bodies(spark.createDataFrame([(long,), ("{}",)], "v string"), "v", ["reaction_type"], max_bytes=1_000_000)
    assert [r.error for r in limited.collect()] == ["body_too_large", None]
    escapes = '{"reaction_type":"' + "\\n" * 100_000 + '"}'
    assert decode(spark, escapes) == ("\n" * 100_000, None)


def test_ids(spark):
    df = spark.range(1000).select(
        F.expr("timestamp_ntz'2024-05-06 07:08:09.1236'").alias("at"), "id"
    )
    made = df.select(ids.derived_id("usr", F.col("at"), F.col("id").cast("string")).alias("u"))
    rows = [r.u for r in made.collect()]
    assert len(set(rows)) == 1000
    assert all(len(u) == 30 and u.startswith("usr_") for u in rows)
    assert set("".join(u[4:] for u in rows)) <= set(ids.ALPHABET)
    assert made.select(ids.id_millis("u").alias("m")).distinct().collect() == [(1714979289124,)]
    fresh = [r.u for r in spark.range(100).select(ids.random_id("rcm").alias("u")).collect()]
    assert len(set(fresh)) == 100 and len(fresh[0]) == 30


def test_known_id(spark):
    # 1700000000000 ms and 80 zero bits.
    got = one(spark, "0" * 20, ids.encode_id("x", F.lit(1700000000000), F.col("v")))
    assert got == "x_01hf7yat00" + "0" * 16


def test_ids_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-05-06 07:08:09' as at, 'k' as k")
    made = df.select(ids.derived_id("usr", F.col("at"), "k").alias("u"))
    here = made.first().u
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        there = df.select(ids.derived_id("usr", F.col("at"), "k").alias("u")).first().u
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert here == there


def test_roles(spark):
    df = spark.createDataFrame(
        [("c", "r", False), ("c", None, False), (None, None, True)], "c string, r string, o boolean"
    )
    rows = df.select(
        roles.role_scope("c", "r", "o"), roles.access_lifetime("o", 60), roles.role_map("c", "r")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("role:candidate role:recruiter", 60, {"candidate": "c", "recruiter": "r"}),
        ("role:candidate", 60, {"candidate": "c"}),
        ("role:onboarding", 86400, {}),
    ]
