"""Matches by changes beside the batch job."""

import random

import pytest
from pyspark.sql import functions as F

from matchspark.operators import matching


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    recommendations = [(f"r{i}", f"p{i % 20}", f"c{i // 20}") for i in range(300)]
    positions = [(f"p{i}", f"b{i % 4}") for i in range(20)]
    rows = {}
    for i in range(900):
        r, p, c = recommendations[rng.choice([0, 1, rng.randrange(300)])]
        side = rng.choice(["candidate", "recruiter"])
        who = rng.choice([c, c, "other"]) if side == "candidate" else rng.choice([f"b{int(p[1:]) % 4}"] * 3 + ["b9"])
        rows.setdefault((r, side, who), (rng.choice(["positive", "positive", "negative"]), f"2024-01-{1 + i // 40:02d}", rng.randrange(5)))
    reactions = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "recommendation_id string, reactor_type string, reactor_id string, reaction_type string, created_at string, delta int")
    return (
        reactions.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).cache(),
        spark.createDataFrame(recommendations, "id string, position_id string, candidate_id string"),
        spark.createDataFrame(positions, "id string, recruiter_id string"),
    )


def rows_of(df):
    return sorted(map(str, df.select("candidate_id", "position_id", "created_at").collect()))


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 2, 0, 1, 3]])
def test_all_changes_together_equal_the_batch_job(spark, tables, tmp_path, order):
    reactions, recommendations, positions = tables
    path, found = str(tmp_path / "reactions"), []
    matching.write_by_recommendation(reactions.drop("delta").limit(0), path, 8)
    for delta in order:
        changed = reactions.filter(F.col("delta") == delta).drop("delta")
        stored = matching.stored_for(changed, path, 8)
        found += rows_of(matching.match_changes(changed, stored, recommendations, positions))
        matching.write_by_recommendation(changed, path, 8)
    assert sorted(found) == rows_of(matching.derive_matches(reactions, recommendations, positions))


def test_a_change_reads_the_folders_of_its_recommendations_only(spark, tables, tmp_path):
    reactions, recommendations, positions = tables
    path = str(tmp_path / "reactions")
    matching.write_by_recommendation(reactions.drop("delta"), path, 64)
    changed = reactions.filter("recommendation_id = 'r0'").drop("delta")
    stored = matching.stored_for(changed, path, 64)
    folders = {r[0].rsplit("/", 2)[-2] for r in stored.select(F.input_file_name()).distinct().collect()}
    part = spark.sql("select 'r0' as r").select(matching.part_of(F.col("r"), 64)).first()[0]
    assert folders == {f"part={part}"}
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert f"= {part})" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_no_changes(spark, tables, tmp_path):
    reactions, recommendations, positions = tables
    path = str(tmp_path / "reactions")
    rows = reactions.drop("delta")
    matching.write_by_recommendation(rows, path, 8)
    none = rows.limit(0)
    assert matching.stored_for(none, path, 8).count() == 0
    assert matching.match_changes(none, rows, recommendations, positions).count() == 0
