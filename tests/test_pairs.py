"""The paired stream and its waiting sides together equal the batch job."""

import random

from pyspark.sql import functions as F

from matchspark.operators.matching import derive_matches
from matchspark.streaming.pairs import MATCH, WAITING, Pairs, all_matches, pair_events, start_pairs

COLUMNS = "recommendation_id string, reactor_type string, reactor_id string, reaction_type string, created_at string"


def reactions(spark, n=60):
    """(batch, rows): sides up to 40 days apart, in batches that do not follow time; repeats in the next batch."""
    rng = random.Random(11)
    batches = [[], [], []]
    for i in range(n):
        for kind, who in [("candidate", f"c{i % 9}"), ("recruiter", f"b{i % 4}"), ("recruiter", "other")]:
            if rng.random() < 0.8:
                at = f"2024-{1 + rng.randrange(2):02d}-{1 + rng.randrange(28):02d} 10:00:00"
                row = (f"r{i}", kind, who, rng.choice(["positive"] * 4 + ["negative"]), at)
                b = rng.randrange(3)
                batches[b].append(row)
                if rng.random() < 0.2:
                    batches[(b + 1) % 3].append(row)
    return batches


def test_stream_and_waiting_sides_equal_the_batch_job(spark, tmp_path):
    recommendations = spark.createDataFrame([(f"r{i}", f"p{i % 4}", f"c{i % 9}") for i in range(60)], "id string, position_id string, candidate_id string")
    positions = spark.createDataFrame([(f"p{i}", f"b{i}") for i in range(4)], "id string, recruiter_id string")
    batches = reactions(spark)
    # The last row, of no recommendation, moves the watermark past all others.
    batches.append([("none", "candidate", "x", "positive", "2030-01-01 00:00:00")])
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, COLUMNS).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(f"{source}/part={i}")
        stream = spark.readStream.schema(df.schema).parquet(f"{source}/*")
        events = pair_events(stream, recommendations, positions, "1 day", 5)
        start_pairs(events, out, state, availableNow=True).awaitTermination()
    kinds = {r.kind: r["count"] for r in spark.read.parquet(out).groupBy("kind").count().collect()}
    assert kinds[MATCH] > 0 and kinds[WAITING] > 0
    stored = spark.read.schema(df.schema).parquet(f"{source}/*").distinct()
    want = derive_matches(stored, recommendations, positions)
    got = all_matches(spark, out)
    assert want.count() > 10
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Some pairs were met only as two waiting sides.
    assert want.count() > kinds[MATCH]


def test_one_call_meets_many_recommendations_of_a_bucket():
    import pandas as pd

    held, timers = [None], []

    class Value:
        get = staticmethod(lambda: held[0])
        update = staticmethod(lambda row: held.__setitem__(0, row))
        clear = staticmethod(lambda: held.__setitem__(0, None))

    handle = type("Handle", (), {"getValueState": lambda self, name, schema: Value, "registerTimer": lambda self, at: timers.append(at)})()
    pairs = Pairs(10)
    pairs.init(handle)
    columns = ["recommendation_id", "candidate_id", "position_id", "side", "at"]
    first = pd.DataFrame([(f"r{i}", f"c{i}", "p", "candidate", 1000 * i) for i in range(100)], columns=columns)
    assert list(pairs.handleInputRows((0,), iter([first, first]), None)) == [] and timers == [10]
    other = pd.DataFrame([(f"r{i}", f"c{i}", "p", "recruiter", 500_000) for i in range(0, 100, 2)], columns=columns)
    (met,) = pairs.handleInputRows((0,), iter([other]), None)
    assert sorted(met["recommendation_id"]) == sorted(other["recommendation_id"])
    assert set(met["at"]) == {500_000} and set(met["kind"]) == {MATCH}
    assert all(met["recommendation_id"].str[1:] == met["candidate_id"].str[1:])
    now = type("Now", (), {"getExpiryTimeInMs": lambda self: 10, "getCurrentWatermarkInMs": lambda self: 50})()
    (late,) = pairs.handleExpiredTimer((0,), now, now)
    assert sorted(late["recommendation_id"]) == sorted(f"r{i}" for i in range(1, 40, 2)) and set(late["kind"]) == {WAITING}
    assert timers == [10, 51]
