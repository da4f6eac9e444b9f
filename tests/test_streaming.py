from pyspark.sql import functions as F

from matchspark.streaming import reactions as table
from matchspark.streaming.matches import stream_matches

REQUESTS = "seq long, candidate_id string, recommendation_id string, body string, at timestamp_ntz"
RECOMMENDATIONS = "id string, position_id string, candidate_id string"


def body(kind):
    return f'{{"reaction_type": "{kind}"}}'


def at(spark, rows):
    columns = REQUESTS.replace("timestamp_ntz", "string")
    return spark.createDataFrame(rows, columns).withColumn("at", F.col("at").cast("timestamp_ntz"))


def test_requests_are_judged_against_all_earlier_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "reactions")
    outcomes, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    recommendations = spark.createDataFrame(
        [("r1", "p1", "c1"), ("r2", "p2", "c1"), ("r3", "p3", "c2")], RECOMMENDATIONS
    )
    batches = [
        [(1, "c1", "r1", body("positive"), "2024-01-01"), (2, "c1", "r1", body("negative"), "2024-01-01")],
        [(3, "c1", "r1", body("neutral"), "2024-01-02"), (4, "c1", "r3", body("neutral"), "2024-01-02"),
         (5, "c1", "r2", body("maybe"), "2024-01-02"), (6, "c1", "r2", body("neutral"), "2024-01-02")],
        [(7, "c2", "r3", body("positive"), "2024-01-03"), (8, "c1", "r2", body("positive"), "2024-01-03")],
    ]
    table.create_table(spark, path)

    def run():
        stream = spark.readStream.schema(REQUESTS).parquet(source + "/*")
        table.store_requests(
            stream, lambda: recommendations, path, checkpoint, ["seq"], "at", outcomes
        ).trigger(availableNow=True).start().awaitTermination()

    for i, rows in enumerate(batches):
        at(spark, rows).coalesce(1).write.parquet(f"{source}/part={i}")
        run()
    got = {r.seq: r.status for r in spark.read.parquet(outcomes).collect()}
    assert got == {1: 201, 2: 409, 3: 409, 4: 403, 5: 400, 6: 201, 7: 201, 8: 409}
    stored = table.stored_reactions(spark, path).collect()
    assert sorted((r.recommendation_id, r.reaction_type) for r in stored) == [
        ("r1", "positive"),
        ("r2", "neutral"),
        ("r3", "positive"),
    ]


def test_a_batch_run_again_stores_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "reactions")
    table.create_table(spark, path)
    rows = spark.createDataFrame(
        [("r1", "candidate", "c", "positive", 1)],
        "recommendation_id string, reactor_type string, reactor_id string, reaction_type string, "
        "seq long",
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    from matchspark.operators.ingest import REACTION_KEY, accepted_rows

    for _ in range(2):
        new = accepted_rows(table._earlier(rows, path, 0), rows, REACTION_KEY, ["seq"])
        table._append(new, path, 0)
        spark.catalog.refreshByPath(path)
    assert table.stored_reactions(spark, path).count() == 1
    later = accepted_rows(table._earlier(rows, path, 1), rows, REACTION_KEY, ["seq"])
    assert later.count() == 0


def test_matches_in_time_and_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    columns = (
        "recommendation_id string, reactor_type string, reactor_id string, reaction_type string, "
        "created_at string"
    )
    rows = [
        ("r1", "candidate", "c1", "positive", "2024-01-01 10:00:00"),
        ("r2", "candidate", "c1", "positive", "2024-01-01 10:00:00"),
        ("r3", "candidate", "c1", "negative", "2024-01-01 10:00:00"),
    ]
    answers = [
        ("r1", "recruiter", "b1", "positive", "2024-01-01 12:00:00"),
        ("r1", "recruiter", "b2", "positive", "2024-01-01 12:00:00"),
        ("r2", "recruiter", "b1", "negative", "2024-01-01 12:00:00"),
        ("r3", "recruiter", "b1", "positive", "2024-01-01 12:00:00"),
        # The same row again, as after a restart of the writer.
        ("r1", "candidate", "c1", "positive", "2024-01-01 10:00:00"),
    ]
    recommendations = spark.createDataFrame(
        [("r1", "p1", "c1"), ("r2", "p1", "c1"), ("r3", "p1", "c1")], RECOMMENDATIONS
    )
    positions = spark.createDataFrame([("p1", "b1")], "id string, recruiter_id string")
    for i, part in enumerate([rows, answers]):
        df = spark.createDataFrame(part, columns)
        df = df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(f"{source}/part={i}")
        stream = spark.readStream.schema(df.schema).parquet(source + "/*")
        found = stream_matches(stream, recommendations, positions, "1 day", "1 DAY")
        found.writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "state")
        ).option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(found.schema).parquet(out).collect()
    assert [(r.candidate_id, r.position_id, r.created_at.hour) for r in got] == [("c1", "p1", 12)]
