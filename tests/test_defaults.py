"""NULLs and odd values in requests, ids and batches: none may lose or mix up rows."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from matchspark.functions.ids import derived_id
from matchspark.functions.usernames import assign_user_names, user_name_at
from matchspark.operators import feeds, ingest, paging
from matchspark.plans import materialize


@pytest.mark.parametrize(("limit", "size"), [(None, 50), (0, 50), (-3, 50), (1, 1), (100, 100), (101, 100), (150, 100)])
def test_any_limit_gives_a_whole_page(spark, limit, size):
    rows = spark.range(149).select(
        F.lit("a").alias("owner"), F.format_string("%03d", "id").alias("key"), F.lit(limit).cast("int").alias("limit")
    )
    page = paging.page_top_n(rows, "owner", "key", "limit").collect()
    assert len(page) == size
    assert all(r.has_next and r.next_cursor == f"{size - 1:03d}" for r in page)


def test_null_flag_hides(spark):
    rows = spark.createDataFrame([("r1", "c", None), ("r2", "c", None), ("r1", "d", False)], "recommendation_id string, who string, flag boolean")
    reactions = spark.createDataFrame([("r1", "candidate", "c"), ("r1", "candidate", "d")], "recommendation_id string, reactor_type string, reactor_id string")
    left = feeds.exclude_reacted(rows, reactions, "candidate", "who", "flag").collect()
    assert sorted((r.recommendation_id, r.who) for r in left) == [("r1", "d"), ("r2", "c")]


def test_null_cursor_and_switch_start_a_part(spark):
    owners = spark.createDataFrame(
        [("a", None, None), ("b", "", False), ("c", "done", None), ("d", None, True)], "owner string, cur string, skip boolean"
    ).withColumns({"limit": F.lit(50), "hide_reacted": F.lit(True)})
    asked = feeds._requests(owners, "owner", "cur", "skip").collect()
    assert sorted(r.owner for r in asked) == ["a", "b"]


def test_ids_tell_bars_and_nulls_apart(spark):
    keys = [("x|y", "z"), ("x", "y|z"), ("q", None), (None, "q"), ("q", "\\N"), ("x\\", "y")]
    df = spark.createDataFrame(keys, "a string, b string")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    assert df.select(derived_id("x", at, "a", "b").alias("i")).distinct().count() == len(keys)


def test_a_name_listed_twice_as_taken(spark):
    df = spark.createDataFrame([("k1",), ("k2",)], "id string")
    drawn = spark.range(2).select(user_name_at(F.col("id")).alias("user_name"))
    got = assign_user_names(df, "id", drawn.unionAll(drawn)).collect()
    assert sorted(r.id for r in got) == ["k1", "k2"]


def test_a_null_order_value_keeps_its_row(spark):
    batch = spark.createDataFrame([("r1", "candidate", "c", None), ("r2", "candidate", "c", 2)], "recommendation_id string, reactor_type string, reactor_id string, seq long")
    out = ingest.ingest_reactions(batch.drop("seq").limit(0), batch, ["seq"]).collect()
    assert [r.outcome for r in out] == ["accepted"] * 2


def test_no_setting_is_changed_where_the_folder_is_missing():
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local[2]", applicationId="app-1")
    )
    assert materialize.shared_folder(session) == materialize.shared_folder(session)
    session.sparkContext.master = "local-cluster[3,2,1000]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        materialize.shared_folder(session)
