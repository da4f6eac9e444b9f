"""The keyed stream beside the batch job, and compaction of the stream's table."""

import random
import shutil

from pyspark.sql import functions as F

from matchspark.operators import ingest
from matchspark.streaming import reactions as table
from matchspark.streaming.keyed import FirstWins, reaction_outcomes, start_keyed

COLUMNS = "recommendation_id string, reactor_type string, reactor_id string, reaction_type string, created_at timestamp_ntz, seq long, batch int"
ORDER = ["created_at", "seq"]


def log(spark, n=400, keys=60, batches=4):
    """Reactions in batches; one key holds a third of the rows, and some times are null."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.randrange(keys)
        at = None if rng.random() < 0.05 else f"2024-01-0{1 + rng.randrange(9)}"
        rows.append((f"r{key}", ["candidate", "recruiter"][key % 2], f"u{key}", rng.choice(["positive", "negative"]), at, i, rng.randrange(batches)))
    strings = COLUMNS.replace("timestamp_ntz", "string")
    return spark.createDataFrame(rows, strings).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def key_of(r):
    return tuple(r[c] for c in [*ingest.REACTION_KEY, "reaction_type", "created_at", "seq"])


def test_batches_equal_the_batch_job_and_read_no_stored_file(spark, tmp_path):
    rows = log(spark).cache()
    first = rows.filter("batch = 0")
    stored = str(tmp_path / "stored")
    ingest.accepted(ingest.ingest_reactions(first.limit(0), first, ORDER)).write.parquet(stored)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    want = [key_of(r) for r in spark.read.parquet(stored).collect()]
    known = spark.read.schema(rows.schema).parquet(stored)
    for b in (1, 2, 3):
        part = rows.filter(F.col("batch") == b)
        new = ingest.accepted(ingest.ingest_reactions(spark.read.schema(rows.schema).parquet(stored, *([path] if b > 1 else [])), part, ORDER)).collect()
        want += [key_of(r) for r in new]
        part.write.parquet(f"{source}/part={b}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/*")
        start_keyed(stream, known, path, checkpoint, ORDER, availableNow=True).awaitTermination()
        if b == 1:
            # From the second batch on the table is not needed.
            keep = spark.read.parquet(stored).collect()
            shutil.copytree(stored, stored + "-kept")
            shutil.rmtree(stored)
            known = spark.createDataFrame([], rows.schema)
            spark.createDataFrame(keep, rows.schema).write.parquet(stored)
    got = [key_of(r) for r in spark.read.schema(rows.schema).parquet(stored + "-kept", path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({k[:3] for k in got}) == len(got)


def test_outcomes_of_every_row(spark, tmp_path):
    rows = log(spark, batches=1).cache()
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = reaction_outcomes(stream, None, ORDER).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = ingest.ingest_reactions(rows.limit(0), rows, ORDER).select("seq", "outcome").collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("seq", "outcome").collect())) == sorted(map(tuple, want))


def test_compaction_keeps_rows_and_the_last_batch_may_run_again(spark, tmp_path):
    path, small = str(tmp_path / "table"), str(tmp_path / "small")
    rows = ingest.accepted(ingest.ingest_reactions(log(spark).limit(0), log(spark), ORDER)).cache()
    table.create_table(spark, path)
    for b in range(4):
        table._append(rows.filter(F.col("batch") == b), path, b)
    table.compact(spark, path, small)
    names = sorted(x.name for x in (tmp_path / "small").iterdir())
    assert names == ["batch=-1", "batch=3"]
    full = lambda p: sorted(map(str, (tuple(r)[:5] for r in table.stored_reactions(spark, p).collect())))
    assert full(small) == full(path)
    last = rows.filter("batch = 3")
    again = ingest.accepted_rows(table._earlier(last, small, 3), last, ingest.REACTION_KEY, ORDER)
    assert again.count() == last.count()
    table.compact(spark, small, str(tmp_path / "twice"))
    assert full(str(tmp_path / "twice")) == full(path)


def test_compaction_of_an_empty_table(spark, tmp_path):
    path, small = str(tmp_path / "table"), str(tmp_path / "small")
    table.create_table(spark, path)
    table.compact(spark, path, small)
    assert table.stored_reactions(spark, small).count() == 0


def test_compaction_of_merged_rows_alone(spark, tmp_path):
    path, small = str(tmp_path / "table"), str(tmp_path / "small")
    table._append(log(spark), path, -1)
    table.compact(spark, path, small)
    assert table.stored_reactions(spark, small).count() == 400


class State:
    """A list or a value in place of the store's."""

    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def appendValue(self, row):  # noqa: N802
        self.rows.append(row)


def test_one_call_judges_many_keys_of_a_bucket():
    import pandas as pd

    state = State()
    wins = FirstWins(["seq"])
    wins.init(type("Handle", (), {"getListState": lambda self, name, schema: state})())
    wins.handleInitialState((0,), pd.DataFrame({"key_text": ["k0"]}), None)
    rows = [(f"k{i % 300}", i) for i in range(1200)]
    parts = [pd.DataFrame(rows[::-1][a : a + 500], columns=["key_text", "seq"]).assign(key_bucket=0) for a in range(0, 1200, 500)]
    out = pd.concat(wins.handleInputRows((0,), iter(parts), None))
    assert sorted(out["seq"]) == list(range(1200))
    assert sorted(out.loc[out["outcome"] == "accepted", "seq"]) == list(range(1, 300))
    again = pd.concat(wins.handleInputRows((0,), iter(parts), None))
    assert set(again["outcome"]) == {"already_exists"} and len(again) == 1200
