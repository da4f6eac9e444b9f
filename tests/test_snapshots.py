"""Changes that rewrite only the folders of their keys."""

import os

import pytest
from pyspark.sql import functions as F

from matchspark.operators import ingest, snapshots

COLUMNS = "id string, full_name string, updated_at timestamp_ntz"
KEY = ["id"]


def users(spark, a, b):
    return spark.range(a, b).select(
        F.format_string("usr_%06d", "id").alias("id"),
        F.concat(F.lit("n"), "id").alias("full_name"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"),
    )


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.create(users(spark, 0, 400), KEY, path, 8)
    return path, users(spark, 0, 1).schema


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def files(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(f"{path}/rows")
        for f in names
        if f.endswith(".parquet") and not f.startswith(".")
    }


def test_an_update_rewrites_the_folders_of_its_keys(spark, table):
    path, schema = table
    before = files(path)
    changes = users(spark, 120, 125).select("id", F.lit("new").alias("full_name")).union(spark.createDataFrame([("usr_9", "x")], "id string, full_name string"))
    now = F.lit("2024-02-02").cast("timestamp_ntz")
    want = rows_of(ingest.apply_updates(users(spark, 0, 400), changes, "id", ["full_name"], now))
    parts = snapshots.update(spark, path, KEY, schema, changes, ["full_name"], now)
    assert 1 <= len(parts) <= 3
    assert rows_of(snapshots.snapshot(spark, path, schema)) == want
    # What was there keeps its files, and is still a version.
    after = files(path)
    assert before.items() <= after.items()
    new = [f for f in after if f not in before]
    assert {f.split("part=")[1].split("/")[0] for f in new} == {str(p) for p in parts}
    assert rows_of(snapshots.snapshot(spark, path, schema, 0)) == rows_of(users(spark, 0, 400))
    read = {r[0] for r in snapshots.snapshot(spark, path, schema).select(F.input_file_name()).distinct().collect()}
    assert len(read) == 8


def test_deletes_and_inserts_follow_each_other(spark, table):
    path, schema = table
    assert len(snapshots.delete(spark, path, KEY, schema, users(spark, 10, 30))) <= 2
    # Keys before, between and after all stored ones; one twice, one stored already.
    batch = users(spark, 15, 17).union(users(spark, 398, 403)).union(users(spark, 15, 16).withColumn("full_name", F.lit("later")))
    batch = batch.union(spark.createDataFrame([("a", "first", None)], COLUMNS)).withColumn("seq", F.length("full_name"))
    snapshots.insert(spark, path, KEY, schema, batch, ["seq"])
    want = users(spark, 0, 10).union(users(spark, 15, 17)).union(users(spark, 30, 403))
    want = want.union(spark.createDataFrame([("a", "first", None)], COLUMNS))
    assert sorted(map(str, snapshots.snapshot(spark, path, schema).collect())) == sorted(map(str, want.collect()))
    spans = sorted((r["low"]["id"], r["high"]["id"]) for r in snapshots.manifest(spark, path).collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert snapshots.versions(spark, path) == [0, 1, 2]


def test_all_rows_gone_and_back(spark, table):
    path, schema = table
    snapshots.delete(spark, path, KEY, schema, users(spark, 0, 400))
    assert snapshots.snapshot(spark, path, schema).count() == 0
    assert snapshots.delete(spark, path, KEY, schema, users(spark, 0, 0)) == []
    snapshots.insert(spark, path, KEY, schema, users(spark, 3, 5).withColumn("seq", F.lit(1)), ["seq"])
    assert rows_of(snapshots.snapshot(spark, path, schema)) == rows_of(users(spark, 3, 5))


def test_a_job_that_ended_before_its_manifest_changed_nothing(spark, table):
    path, schema = table
    left = users(spark, 0, 9).withColumn("part", F.lit(0))
    left.write.partitionBy("part").parquet(f"{path}/rows/written=1")
    assert rows_of(snapshots.snapshot(spark, path, schema)) == rows_of(users(spark, 0, 400))
    snapshots.delete(spark, path, KEY, schema, users(spark, 399, 400))
    assert rows_of(snapshots.snapshot(spark, path, schema)) == rows_of(users(spark, 0, 399))


def test_keys_of_two_columns(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["k", "l"]
    rows = spark.range(100).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("l"), F.lit("v").alias("v"))
    snapshots.create(rows, key, path, 4)
    parts = snapshots.delete(spark, path, key, rows.schema, rows.filter("l in (1, 98)"))
    assert parts == [0, 3]
    assert rows_of(snapshots.snapshot(spark, path, rows.schema)) == rows_of(rows.filter("l not in (1, 98)"))


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.create(users(spark, 0, 0), KEY, path, 4)
    schema = users(spark, 0, 0).schema
    assert snapshots.snapshot(spark, path, schema).count() == 0
    snapshots.insert(spark, path, KEY, schema, users(spark, 0, 3).withColumn("seq", F.lit(1)), ["seq"])
    assert snapshots.snapshot(spark, path, schema).count() == 3
