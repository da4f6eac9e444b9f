import random

import pytest
from pyspark.sql import functions as F

from matchspark.operators import adjudicate, ingest


def greedy(stored, batch):
    """Insert the rows one by one."""
    providers = {(p, i) for p, i, _ in stored}
    names = {n for _, _, n in stored if n is not None}
    out = {}
    for seq, p, i, n in sorted(batch):
        if (p, i) in providers:
            out[seq] = "duplicate_provider_key"
        elif n is not None and n in names:
            out[seq] = "duplicate_user_name"
        else:
            out[seq] = "accepted"
            providers.add((p, i))
            if n is not None:
                names.add(n)
    return out


@pytest.mark.parametrize("seed, plain", [(1, 0), (2, 0), (3, 1), (4, 3)])
def test_users_as_if_row_by_row(spark, monkeypatch, seed, plain):
    monkeypatch.setattr(ingest, "PLAIN_ROUNDS", plain)
    draw = random.Random(seed)

    def row():
        return (
            draw.choice(["google", "apple"]),
            f"p{draw.randrange(12)}",
            draw.choice([None, f"n{draw.randrange(10)}", f"n{draw.randrange(10)}"]),
        )

    stored = list({r[:2]: r for r in (row() for _ in range(3))}.values())
    batch = [(i, *row()) for i in range(60)]
    users = spark.createDataFrame(stored, "provider string, provider_user_id string, user_name string")
    rows = spark.createDataFrame(
        batch, "seq long, provider string, provider_user_id string, user_name string"
    )
    got = {r.seq: r.outcome for r in ingest.ingest_users(users, rows).collect()}
    assert got == greedy(stored, batch)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Row i shares its name with the row before or its provider key with the row after."""
    n, rng = 10_000, random.Random(4)
    columns = "seq long, provider string, provider_user_id string, user_name string"
    chain = [(i, "google", f"p{i // 2}", f"n{(i + 1) // 2}") for i in range(n)]
    # A hot key, a row that waits for two rows, and a branch off the chain.
    chain += [(n + i, "google", "p5", f"x{rng.randrange(40)}") for i in range(300)]
    chain += [(2 * n, "apple", "a", "n3000"), (2 * n + 1, "apple", "a", "n17"), (2 * n + 2, "apple", "a", None)]
    writes = []
    monkeypatch.setattr(ingest, "materialize", lambda df, name, real=ingest.materialize: writes.append(name) or real(df, name))
    rounds = []
    monkeypatch.setattr(ingest, "_decide", lambda *a, real=ingest._decide: rounds.append(1) or real(*a))
    users = spark.createDataFrame([], columns).drop("seq")
    got = {r.seq: r.outcome for r in ingest.ingest_users(users, spark.createDataFrame(chain, columns)).collect()}
    assert got == greedy([], chain)
    assert len(rounds) <= 7 and len(writes) <= 40


def test_row_refused_for_its_name_does_not_block_its_provider_key(spark):
    users = spark.createDataFrame(
        [("google", "p0", "taken")], "provider string, provider_user_id string, user_name string"
    )
    batch = spark.createDataFrame(
        [(1, "google", "p1", "taken"), (2, "google", "p1", "free"), (3, "apple", "p1", None),
         (4, "apple", "p2", None)],
        "seq long, provider string, provider_user_id string, user_name string",
    )
    got = {r.seq: r.outcome for r in ingest.ingest_users(users, batch).collect()}
    assert got == {1: "duplicate_user_name", 2: "accepted", 3: "accepted", 4: "accepted"}


REACTIONS = (
    "recommendation_id string, reactor_type string, reactor_id string, reaction_type string, seq long"
)


def test_first_reaction_wins(spark):
    stored = spark.createDataFrame([("r0", "candidate", "c", "positive", 0)], REACTIONS)
    batch = spark.createDataFrame(
        [
            ("r1", "candidate", "c", "negative", 5),
            ("r1", "candidate", "c", "positive", 6),
            ("r1", "recruiter", "c", "positive", 7),
            ("r0", "candidate", "c", "negative", 8),
        ],
        REACTIONS,
    )
    out = ingest.ingest_reactions(stored, batch, ["seq"])
    assert {r.seq: r.outcome for r in out.collect()} == {
        5: "accepted",
        6: "already_exists",
        7: "accepted",
        8: "already_exists",
    }
    # Nothing is accepted a second time.
    after = stored.unionByName(ingest.accepted(out))
    again = ingest.ingest_reactions(after, batch, ["seq"])
    assert again.filter("outcome = 'accepted'").count() == 0
    assert out.count() == batch.count()


def test_null_company_never_conflicts(spark):
    columns = "title string, description string, company string, seq long"
    stored = spark.createDataFrame([("t", "d", None, 0), ("t", "d", "x", 1)], columns)
    batch = spark.createDataFrame(
        [("t", "d", None, 2), ("t", "d", None, 3), ("t", "d", "x", 4), ("t", "d", "y", 5),
         ("t", "d", "y", 6)],
        columns,
    )
    out = {r.seq: r.outcome for r in ingest.ingest_positions(stored, batch, ["seq"]).collect()}
    assert [k for k, v in sorted(out.items()) if v == "accepted"] == [2, 3, 5]


def test_recommendation_needs_a_score(spark):
    batch = spark.createDataFrame([("p", "c", 1)], "position_id string, candidate_id string, seq int")
    with pytest.raises(ValueError):
        ingest.ingest_recommendations(batch, batch, ["seq"])


def test_update_stamps_every_changed_row(spark):
    target = spark.createDataFrame(
        [("a", "x", "e"), ("b", "y", "e")], "id string, full_name string, email string"
    ).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    changes = spark.createDataFrame([("a", "x")], "id string, full_name string")
    now = F.lit("2024-02-02").cast("timestamp_ntz")
    out = ingest.apply_updates(target, changes, "id", ["full_name"], now)
    days = {r.id: r.updated_at.month for r in out.collect()}
    assert days == {"a": 2, "b": 1}


def test_ladder(spark):
    recommendations = spark.createDataFrame(
        [("r1", "p", "c1"), ("r2", "p", "c2"), ("r3", "p", "c1")],
        "id string, position_id string, candidate_id string",
    )
    stored = spark.createDataFrame([("r3", "candidate", "c1", "neutral", 0)], REACTIONS)
    good = '{"reaction_type":"positive"}'
    requests = [
        (1, None, "", "x"),
        (2, "c1", "", good),
        (3, "c1", None, good),
        (4, "c1", "r9", "x"),
        (5, "c1", "r2", "x"),
        (6, "c1", "r1", "x"),
        (7, "c1", "r1", '{"reaction_type":"maybe"}'),
        (8, "c1", "r1", good),
        (9, "c1", "r1", '{"reaction_type":"negative"}'),
        (10, "c1", "r3", good),
        (11, "c2", "r1", good),
    ]
    batch = spark.createDataFrame(
        requests, "seq long, candidate_id string, recommendation_id string, body string"
    ).withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    judged = adjudicate.adjudicate_reactions(batch, recommendations, stored, ["seq"])
    got = {r.seq: r.status for r in judged.collect()}
    want = {1: 500, 2: 400, 3: 400, 4: 404, 5: 403, 6: 400, 7: 400, 8: 201, 9: 409, 10: 409}
    assert got == {**want, 11: 403}
    made = adjudicate.created_reactions(judged, "at").collect()
    assert [(r.recommendation_id, r.reaction_type) for r in made] == [("r1", "positive")]


def test_updates_by_two_columns_clear_and_follow_their_order(spark):
    target = spark.createDataFrame([("a", 1, "x", "m"), ("a", 2, "y", "n"), ("b", 1, "z", "o")], "k string, l int, v string, w string")
    changes = spark.createDataFrame(
        [("a", 1, None, None, ["v"], 1), ("a", 2, "p", None, ["v"], 1), ("a", 2, "q", None, ["v"], 2), ("a", 2, None, "r", ["w"], 3)],
        "k string, l int, v string, w string, changed array<string>, seq int",
    )
    now = F.lit("2024-02-02").cast("timestamp_ntz")
    out = ingest.apply_updates(target, changes, ["k", "l"], ["v", "w"], now, "changed", ["seq"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, None, "m"), ("a", 2, "q", "r"), ("b", 1, "z", "o")]
    with pytest.raises(Exception, match="several changes"):
        ingest.apply_updates(target, changes, ["k", "l"], ["v", "w"], now, "changed").collect()


def test_bulk_users_in_two_passes(spark):
    columns = "seq long, provider string, provider_user_id string, user_name string"
    users = spark.createDataFrame([(0, "google", "0", "ann")], columns).drop("seq")
    batch = spark.createDataFrame(
        [(1, "google", "0", "new"), (2, "google", "1", "ann"), (3, "google", "1", "bob"), (4, "apple", "1", "bob"),
         (5, "apple", "2", "bob"), (6, "apple", "3", None), (7, "apple", "4", None)],
        columns,
    )
    got = {r.seq: r.outcome for r in ingest.ingest_users_bulk(users, batch).collect()}
    provider, name = "duplicate_provider_key", "duplicate_user_name"
    assert got == {1: provider, 2: name, 3: provider, 4: "accepted", 5: name, 6: "accepted", 7: "accepted"}
