from checks.fixture import Fixture
from matchspark.operators import integrity
from matchspark.operators.matching import derive_matches
from matchspark.sources import tables


def test_nothing_refers_to_what_was_deleted(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    gone = fx.users.filter("id like '%1'").select("id")
    flagged = integrity.cascade_delete(fx.tables(), {"users": gone})
    kept = {name: df.filter("not removed").drop("removed") for name, df in flagged.items()}
    audit = {r.child + "." + r.column: r.orphan_rows for r in
             integrity.audit_foreign_keys(kept).collect()}
    # Tokens of unknown users were orphans before.
    before = integrity.audit_foreign_keys(fx.tables()).collect()
    allowed = {r.child + "." + r.column for r in before if r.orphan_rows}
    assert {k for k, v in audit.items() if v} <= allowed
    assert flagged["reactions"].filter("removed").count() > 0
    assert kept["users"].join(gone, "id").count() == 0


def test_cascade_from_a_middle_table(spark):
    def frame(columns, *rows):
        return spark.createDataFrame(list(rows), columns)

    given = {
        "users": frame("id string", ("u",)),
        "candidates": frame("id string, user_id string", ("c", "u")),
        "recruiters": frame("id string, user_id string", ("r1", "u"), ("r2", "u")),
        "positions": frame("id string, recruiter_id string", ("p1", "r1"), ("p2", "r2")),
        "recommendations": frame(
            "id string, position_id string, candidate_id string",
            ("x1", "p1", "c"),
            ("x2", "p2", "c"),
        ),
        "reactions": frame("recommendation_id string", ("x1",), ("x2",)),
        "matches": frame("candidate_id string, position_id string", ("c", "p1"), ("c", "p2")),
    }
    gone = integrity.cascade_delete(given, {"recruiters": frame("id string", ("r1",))})
    left = {name: df.filter("not removed").count() for name, df in gone.items()}
    assert left == {
        "users": 1,
        "candidates": 1,
        "recruiters": 1,
        "positions": 1,
        "recommendations": 1,
        "reactions": 1,
        "matches": 1,
    }


def test_matches_are_positive_on_both_sides(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    matches = fx.matches
    known = matches.limit(10)
    again = derive_matches(fx.reactions, fx.recommendations, fx.positions, known)
    assert again.count() == matches.count() - 10
    positive = fx.reactions.filter("reaction_type = 'positive'")
    pairs = matches.join(fx.recommendations, ["candidate_id", "position_id"])
    assert pairs.count() == matches.count()
    both = pairs.join(positive, pairs.id == positive.recommendation_id).groupBy("id").count()
    assert both.filter("count = 2").count() == matches.count()


def test_partition_folders_are_pruned(spark, sf_dir, tmp_path):
    made = tables.conform("embeddings", Fixture(spark, sf_dir).embeddings)
    tables.write_tables({"embeddings": made}, str(tmp_path))
    loaded = tables.load_tables(spark, str(tmp_path), ["embeddings"], views=False)["embeddings"]
    from matchspark.operators.lookups import embeddings_by_status

    df = embeddings_by_status(loaded, "candidate", "done")
    assert df.count() == made.filter("object_type = 'candidate' and status = 'done'").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1]
    assert "object_type" in filters and "status" in filters


def test_deletes_start_at_any_table(spark):
    """Tables whose key is not ``id``, and one without references."""
    tables = {
        "refresh_tokens": spark.createDataFrame([("j1", "u"), ("j2", "u")], "jti string, user_id string"),
        "matches": spark.createDataFrame([("c", "p"), ("c", "q")], "candidate_id string, position_id string"),
        "embeddings": spark.createDataFrame([("c", "candidate"), ("c", "position")], "object_id string, object_type string"),
    }
    gone = {name: df.limit(0) for name, df in tables.items()}
    gone["refresh_tokens"] = tables["refresh_tokens"].filter("jti = 'j2'")
    gone["matches"] = tables["matches"].filter("position_id = 'q'")
    gone["embeddings"] = tables["embeddings"].filter("object_type = 'position'")
    for name, df in integrity.cascade_delete(tables, gone).items():
        assert df.filter("removed").drop("removed").collect() == gone[name].select(*tables[name].columns).collect()
        assert df.filter("not removed").count() == 1
