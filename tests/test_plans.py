"""Plans at scale: nothing is small enough to broadcast, one key holds a third of the rows."""

import re

import pytest
from pyspark.sql import functions as F

from matchspark.operators import adjudicate, feeds, identity, ingest, paging
from matchspark.plans.materialize import materialize, shared_folder
from matchspark.sources.tables import write_bucketed


@pytest.fixture
def large(spark):
    """Settings that make small data plan like large data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        # The jobs must do without this setting.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def run(df):
    """The final plan, after it has run."""
    df.collect()
    return plan_of(df)


N = 30_000


def tables(spark):
    """A third of the recommendations is for one position, a third for one candidate."""
    n = spark.range(0, N, 1, 8)
    position = F.when(F.col("id") % 3 == 0, "p0").otherwise(
        F.concat(F.lit("p"), (F.col("id") % 997).cast("string"))
    )
    candidate = F.when(F.col("id") % 3 == 1, "c0").otherwise(
        F.concat(F.lit("c"), (F.col("id") % 991).cast("string"))
    )
    recommendations = n.select(
        F.format_string("r%08d", "id").alias("id"),
        position.alias("position_id"),
        candidate.alias("candidate_id"),
    )
    positions = spark.range(997).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("b"), (F.col("id") % 10).cast("string")).alias("recruiter_id"),
        F.lit("t").alias("title"),
        F.lit("d").alias("description"),
        F.lit(None).cast("string").alias("company"),
    )
    reactions = n.filter("id % 5 = 0").select(
        F.format_string("r%08d", "id").alias("recommendation_id"),
        F.lit("candidate").alias("reactor_type"),
        candidate.alias("reactor_id"),
        F.lit("positive").alias("reaction_type"),
    )
    return tuple(materialize(df, "plans") for df in (recommendations, positions, reactions))


def test_pages_are_cut_before_the_shuffle(large):
    recommendations, positions, reactions = tables(large)
    plan = plan_of(feeds.position_feed(recommendations, positions, reactions))
    cuts = re.findall(r"WindowGroupLimit \[candidate_id.*?, 51, (\w+)", plan)
    assert cuts[:2] == ["Final", "Partial"]
    # The wide text is joined to the kept rows only.
    assert plan.index("SortMergeJoin [position_id") < plan.index("WindowGroupLimit")
    scans = re.findall(r"ReadSchema: (struct<[^\n]*?>)", plan)
    assert any("title" in s for s in scans)
    assert not any("title" in s and "recruiter_id" in s for s in scans)


def test_bucketed_tables_join_without_a_shuffle(large, tmp_path):
    recommendations, positions, reactions = tables(large)
    stored = {
        name: write_bucketed(df, name, str(tmp_path / name), 8, f"plans_{name}")
        for name, df in [("recommendations", recommendations), ("reactions", reactions)]
    }
    try:
        rows = stored["recommendations"].select(
            F.col("id").alias("recommendation_id"), "candidate_id", "position_id"
        )
        left = feeds.exclude_reacted(rows, stored["reactions"], "candidate", "candidate_id")
        assert "Exchange" not in plan_of(left)
        assert left.count() == N - reactions.count()
    finally:
        for name in stored:
            large.sql(f"drop table plans_{name}")


def test_hot_position_is_split(large):
    recommendations, positions, _ = tables(large)
    plan = run(feeds.recruiter_recommendations(recommendations, positions))
    assert "skew=true" in plan


def test_hot_owner_is_spread_when_requests_are_joined(large):
    recommendations, positions, reactions = tables(large)
    requests = recommendations.select("candidate_id").distinct().withColumn("cursor", F.lit(""))
    plan = plan_of(feeds.position_feed(recommendations, positions, reactions, requests))
    assert re.search(r"Join \[candidate_id#\d+, _salt#\d+\]", plan)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_hot_recommendation_is_split_in_adjudication(large):
    recommendations, _, reactions = tables(large)
    requests = large.range(0, N, 1, 8).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "c0").otherwise("c5").alias("candidate_id"),
        F.when(F.col("id") % 3 == 0, "r00000001")
        .otherwise(F.format_string("r%08d", "id"))
        .alias("recommendation_id"),
        F.lit('{"reaction_type":"positive"}').alias("body"),
    )
    requests = materialize(requests, "plans")
    judged = adjudicate.adjudicate_reactions(requests, recommendations, reactions, ["seq"])
    plan = run(judged)
    assert "skew=true" in plan
    assert judged.filter("recommendation_id = 'r00000001' and status = 201").count() == 1


def test_hot_identity_is_split_in_sign_ins(large):
    users = large.createDataFrame(
        [(f"u{i}", "google", f"x{i}") for i in range(500)],
        "id string, provider string, provider_user_id string",
    )
    none = large.createDataFrame([], "id string, user_id string")
    n = F.col("id")
    sign_ins = large.range(0, N, 1, 8).select(
        n.alias("seq"),
        F.lit("google").alias("provider"),
        F.when(n % 3 == 0, "new").otherwise(F.concat(F.lit("x"), (n % 5000).cast("string"))).alias(
            "provider_user_id"
        ),
    )
    out = identity.signin_outcome(materialize(sign_ins, "plans"), users, none, none)
    assert "skew=true" in run(out)
    hot = out.filter("provider_user_id = 'new'").groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in hot} == {"create_user": 1, "onboarding": N // 3 - 1}


def test_hot_key_is_cut_before_the_shuffle_of_an_insert(large):
    _, _, reactions = tables(large)
    batch = materialize(
        large.range(0, N, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "r0").otherwise(F.format_string("s%d", "id")).alias(
                "recommendation_id"
            ),
            F.lit("candidate").alias("reactor_type"),
            F.lit("c").alias("reactor_id"),
            F.lit("positive").alias("reaction_type"),
            F.col("id").alias("seq"),
        ),
        "plans",
    )
    out = ingest.ingest_reactions(reactions, batch, ["seq"])
    plan = plan_of(out)
    assert re.search(r"WindowGroupLimit \[recommendation_id.*, 1, Partial", plan)
    assert out.filter("recommendation_id = 'r0' and outcome = 'accepted'").count() == 1
    # No whole rows are grouped by the key: the batch itself is joined by seq.
    assert re.search(r"Join \[coalesce\(seq#\d+L, 0\), isnull\(seq#\d+L\)\], .*LeftOuter", plan)


def test_tables_are_written_to_the_folder_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder.rstrip("/")
    df = materialize(spark.range(3), "plans")
    assert all(folder.rstrip("/") in f for f in df.inputFiles())


def test_requests_and_lookups_are_not_broadcast(spark):
    """Spark takes rows repeated per salt for small, as it judges them by the numbers they are made from."""

    def made(n, **columns):
        return spark.range(n).select(*[F.concat(F.lit(p), F.col("id").cast("string")).alias(c) for c, p in columns.items()])

    requests = made(100, candidate_id="c", cursor="r").withColumn("recruiter_id", F.col("candidate_id"))
    rows = made(100, candidate_id="c", recommendation_id="r")
    assert "Broadcast" not in plan_of(paging.keyset_filter(rows, requests.drop("recruiter_id"), "candidate_id", "recommendation_id"))
    text = {"title": "t", "description": "d", "company": "o"}
    asked = made(100, user_id="u", candidate_id="c", recruiter_id="b", pos_cursor="", can_cursor="").withColumns(
        {"limit": F.lit(50), "hide_reacted": F.lit(False), "skip_positions": F.lit(False), "skip_candidates": F.lit(False)}
    )
    page = feeds.dual_feed_page(
        asked,
        made(100, id="r", position_id="p", candidate_id="c"),
        made(100, id="p", recruiter_id="b", **text),
        made(100, id="c", user_id="u", about="a"),
        made(100, id="u", full_name="f"),
        made(100, recommendation_id="r", reactor_type="candidate", reactor_id="c").repartition(2),
    )
    joins = [line for line in plan_of(page).splitlines() if "BroadcastHashJoin" in line]
    # Spark may still broadcast the reactions that are left out.
    assert all("LeftAnti" in line for line in joins)
