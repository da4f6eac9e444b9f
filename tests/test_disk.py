"""What jobs leave on disk and in state while they run."""

import os
import time

import pytest
from pyspark.sql import functions as F

from checks.feed_queries import dual_page
from checks.fixture import Fixture, written_pair
from checks.identity_queries import feed_export, stream_pairs, stream_reactions_keyed
from matchspark.plans import materialize as plans
from matchspark.streaming.keyed import packed, unpacked
from matchspark.streaming.matches import stream_matches

REACTIONS = "recommendation_id string, reactor_type string, reactor_id string, reaction_type string, created_at string"


def shuffled(spark):
    folder = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = folder.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def by_key(spark):
    return spark.range(10_000).groupBy((F.col("id") % 100).alias("key")).count()


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    kept_rows = plans.materialize(by_key(spark), "freed")
    with plans.freed(spark):
        assert by_key(spark).count() == 100 and kept_rows.count() == 100
    # Executors delete them a moment later.
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    kept = spark.conf.get(plans.FREE_SHUFFLES)
    with pytest.raises(ValueError), plans.freed(spark):
        raise ValueError
    assert spark.conf.get(plans.FREE_SHUFFLES) == kept


def test_folders_move_and_go(spark):
    path, target = plans.new_folder(spark, "here"), plans.new_folder(spark, "there") + "/part=1"
    by_key(spark).write.parquet(path)
    plans.move_folder(spark, path, target)
    assert spark.read.parquet(target).count() == 100
    plans.delete_folder(spark, target)
    assert not os.path.exists(target.removeprefix("file://")) and not os.path.exists(path.removeprefix("file://"))


def test_a_side_of_matches_keeps_its_own_rows_only(spark, tmp_path):
    rows = [(f"r{i}", kind, f"{kind[0]}{i}", "positive", "2024-01-01") for i in range(50) for kind in ("candidate", "recruiter")]
    rows += [("r0", "recruiter", "x", "negative", "2024-01-09"), ("r1", "candidate", "c1", "negative", "2024-01-01")]
    made = spark.createDataFrame(rows, REACTIONS).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    made.write.parquet(str(tmp_path / "in"))
    recommendations = spark.createDataFrame([(f"r{i}", f"p{i}", f"c{i}") for i in range(50)], "id string, position_id string, candidate_id string")
    positions = spark.createDataFrame([(f"p{i}", f"r{i}") for i in range(50)], "id string, recruiter_id string")
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    found = stream_matches(stream, recommendations, positions, "30 days", "1 DAY")
    run = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    query = run.option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    operators = [o for o in query.recentProgress[0]["stateOperators"] if o["operatorName"].startswith("dedup")]
    assert sorted(o["numRowsTotal"] for o in operators) == [50, 51]
    # The newest row is a recruiter's and sets the time of both sides.
    assert query.lastProgress["eventTime"]["watermark"].startswith("2023-12-10")
    assert spark.read.schema(found.schema).parquet(str(tmp_path / "out")).count() in (49, 50)


def test_pages_of_both_feeds_are_cut_before_they_are_joined(spark, sf_dir):
    pages = dual_page(Fixture(spark, sf_dir))
    read = " ".join(pages.inputFiles())
    assert "position-page" in read and "candidate-page" in read
    assert not [name for name in ("lineitem", "orders.parquet", "recommendations", "reactions", "line-orders") if name in read]
    folder = plans.shared_folder(spark).removeprefix("file:") + "/matchspark"
    with written_pair(Fixture(spark, sf_dir)) as pair:
        paths = [os.path.dirname(df.inputFiles()[0].removeprefix("file:")) for df in pair]
        assert all(os.path.exists(path) and folder in path for path in paths)
    assert not [path for path in paths if os.path.exists(path)]
    assert pages.count() > 0


def test_exported_lines_are_compressed(spark, sf_dir):
    found = feed_export(Fixture(spark, sf_dir))
    assert all(f.endswith(".json.gz") for f in found.inputFiles()) and found.filter("document is null").count() == 0


def left_over(spark):
    """Folders with rows below the shared one, by the name of their step."""
    folder = plans.shared_folder(spark).removeprefix("file://") + "/matchspark"
    found = (d for d, _, files in os.walk(folder) if any(f.endswith(".parquet") for f in files))
    return {os.path.relpath(d, folder) for d in found}


def soon_gone(spark, before):
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    return not shuffled(spark) - before


def test_paired_stream_keeps_its_output_only(spark, sf_dir):
    shuffles, folders = shuffled(spark), left_over(spark)
    found = stream_pairs(Fixture(spark, sf_dir))
    assert {name.split("-")[0] for name in left_over(spark) - folders} == {"pairs"}
    assert soon_gone(spark, shuffles)
    assert found.count() > 0


def test_keyed_stream_keeps_its_output_only(spark, sf_dir):
    shuffles, folders = shuffled(spark), left_over(spark)
    found = stream_reactions_keyed(Fixture(spark, sf_dir))
    names = {name.split("-")[0] for name in left_over(spark) - folders}
    assert "reactions" in names and names <= {"reactions", "stored"}
    assert soon_gone(spark, shuffles)
    assert found.count() > 0


def test_taken_keys_are_packed():
    keys = [f'{{"recommendation_id":"rcm_{i:020d}","reactor_id":"é\\n {i % 7}"}}' for i in range(1000)]
    assert sorted(unpacked(packed(keys[::-1]))) == sorted(keys)
    assert len(packed(keys)) * 4 < len("".join(keys))
    assert unpacked(packed(["{}"])) == ["{}"]
