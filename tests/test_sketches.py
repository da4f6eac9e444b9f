"""Inserts that read only the files their keys may be in."""

import random
import re

import pytest
from pyspark.sql import functions as F

from matchspark.operators import ingest, sketches

KEY = ingest.REACTION_KEY
COLUMNS = "recommendation_id string, reactor_type string, reactor_id string, reaction_type string, seq long"


def rows_of(spark, n, seed, first=0):
    """n rows over about n / 2 keys; one key holds a third of them, some ids are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if i % 3 == 0 else rng.randrange(n // 2)
        rows.append((None if k == 1 else f"r{first + k}", ["candidate", "recruiter"][k % 2], f"u{k % 7}", "positive", first + i))
    return spark.createDataFrame(rows, COLUMNS)


def outcomes(df):
    return sorted((r["seq"], r["outcome"]) for r in df.collect())


def test_outcomes_equal_the_plain_insert_over_many_runs(spark, tmp_path):
    path, schema = str(tmp_path / "t"), rows_of(spark, 1, 0).schema
    for b in range(3):
        batch = rows_of(spark, 300, b, first=100 * b).cache()
        got = sketches.insert_pruned(batch, path, KEY, ["seq"], schema, parts=8)
        everything = sketches.stored(spark, path, schema).drop("part", "run")
        want = ingest.insert_ignore(everything, batch, KEY, ["seq"])
        assert outcomes(got) == outcomes(want)
        sketches.append(ingest.accepted(got), KEY, path, f"b{b}", parts=8)
    full = sketches.stored(spark, path, schema)
    assert full.filter("recommendation_id is not null").groupBy(*KEY).count().filter("count > 1").count() == 0
    small = str(tmp_path / "small")
    sketches.compact(spark, path, KEY, schema, small, "all", parts=8)
    assert sketches.stored(spark, small, schema).select("run").distinct().count() == 1
    known = sketches.stored(spark, small, schema).drop("part", "run")
    assert sorted(map(str, known.collect())) == sorted(map(str, full.drop("part", "run").collect()))
    again = sketches.insert_pruned(known.filter("recommendation_id is not null"), small, KEY, ["seq"], schema, parts=8)
    assert {r["outcome"] for r in again.select("outcome").distinct().collect()} == {ingest.EXISTS}


def unique_rows(spark, a, b):
    return spark.range(a, b).select(
        F.concat(F.lit("r"), "id").alias("recommendation_id"),
        F.lit("candidate").alias("reactor_type"),
        F.concat(F.lit("u"), "id").alias("reactor_id"),
        F.lit("positive").alias("reaction_type"),
        F.col("id").alias("seq"),
    )


def test_a_batch_opens_a_fraction_of_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = unique_rows(spark, 0, 1).schema
    for run in range(5):
        sketches.append(unique_rows(spark, 4000 * run, 4000 * (run + 1)), KEY, path, f"b{run}", parts=16)
    batch = unique_rows(spark, 4000 * 3 + 7, 4000 * 3 + 11).union(unique_rows(spark, 10**6, 10**6 + 500))
    held = sketches.may_hold(batch, KEY, path, schema, 16)
    assert held.join(batch.select(*KEY), KEY).count() == 4
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "run" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {r[0] for r in held.select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in sketches.stored(spark, path, schema).select(F.input_file_name()).distinct().collect()}
    assert len(every) == 80
    assert len(files) <= 6 and all(re.search(r"run=b\d/part=\d+", f) for f in files)


def test_no_key_is_missed_and_few_others_pass(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = unique_rows(spark, 0, 50_000)
    sketches.append(rows, KEY, path, "b0", parts=4)
    known = sketches._read(spark, f"{path}/sketches", sketches.T._parse_datatype_string(sketches.SKETCH))
    # 12,500 keys a part take 16 blocks of at most 1,024.
    assert {r["blocks"] for r in known.select("blocks").collect()} == {16}

    def passing(some):
        at = some.select(
            sketches.part_of(KEY, 4).alias("part"), sketches.block_of(KEY, F.lit(16)).alias("block"), F.array(*sketches.bits_of(KEY)).alias("bits")
        )
        met = at.join(known, ["part", "block"])
        every = F.forall("bits", lambda b: F.element_at("words", F.shiftright(b, 6) + 1).bitwiseAND(sketches._mask(b)) != 0)
        return met.filter(every).count()

    assert passing(rows) == 50_000
    assert passing(unique_rows(spark, 10**6, 10**6 + 200_000)) <= 20


def test_merged_sketches_equal_the_sketch_of_all(spark):
    rows = unique_rows(spark, 0, 3000)
    shape = lambda df: sorted((r["part"], r["block"], tuple(r["words"])) for r in df.collect())
    halves = [sketches.sketch(rows.filter(f"seq % 2 = {i}"), KEY, 2, 2) for i in (0, 1)]
    assert shape(sketches.merge(halves[0].unionByName(halves[1]))) == shape(sketches.sketch(rows, KEY, 2, 2))


def test_a_run_without_sketch_is_read_whole_and_may_be_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = unique_rows(spark, 0, 100)
    sketches.append(rows, KEY, path, "b0", parts=4)
    empty = spark.createDataFrame([], sketches.T._parse_datatype_string(sketches.SKETCH)).drop("run")
    empty.write.mode("overwrite").parquet(f"{path}/sketches/run=b0")
    batch = unique_rows(spark, 50, 150)
    new = ingest.accepted(sketches.insert_pruned(batch, path, KEY, ["seq"], rows.schema, parts=4))
    assert new.count() == 50
    for _ in range(2):
        sketches.append(unique_rows(spark, 100, 150), KEY, path, "b1", parts=4)
    assert sketches.stored(spark, path, rows.schema).count() == 150


@pytest.mark.parametrize("n", [0, 5])
def test_empty_tables_and_batches(spark, tmp_path, n):
    path = str(tmp_path / "t")
    rows = unique_rows(spark, 0, n)
    assert sketches.insert_pruned(rows, path, KEY, ["seq"], rows.schema).filter("outcome = 'accepted'").count() == n
    sketches.append(rows, KEY, path, "b0")
    assert sketches.insert_pruned(rows, path, KEY, ["seq"], rows.schema).filter("outcome = 'accepted'").count() == 0
    assert sketches.insert_pruned(rows.limit(0), path, KEY, ["seq"], rows.schema).count() == 0


def test_positions_without_company_conflict_with_nothing(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["title", "description", "company"]
    rows = spark.createDataFrame([("a", "b", None, 1), ("a", "b", "c", 2)], "title string, description string, company string, seq long")
    sketches.append(rows, key, path, "b0")
    batch = rows.withColumn("seq", F.col("seq") + 10)
    got = sketches.insert_pruned(batch, path, key, ["seq"], rows.schema, optional="company")
    assert outcomes(got) == [(11, "accepted"), (12, "already_exists")]
