"""Two loads of a small seed whose second recruiter is created after its positions."""

import pytest
from pyspark.sql import functions as F

from checks.identity_queries import _empty_tables
from matchspark.operators.integrity import audit_foreign_keys
from matchspark.sources.seed import SeedStep, load_seed

USERS = "provider string, provider_user_id string, email string, full_name string, user_name string"
CANDIDATES = "email string, about string"
POSITIONS = "email string, title string, description string, company string"


def steps(spark):
    def frame(table, columns, *rows):
        return SeedStep(table, spark.createDataFrame(list(rows), columns))

    def user(name):
        return ("google", f"id-{name}", f"{name}@example.com", name, f"{name}_x")

    return [
        frame("users", USERS, user("ann"), user("ben"), user("cat")),
        frame("candidates", CANDIDATES, ("ann@example.com", "builds servers")),
        frame("candidates", CANDIDATES, ("cat@example.com", "builds pages")),
        frame("recruiters", "email string", ("ben@example.com",)),
        frame("positions", POSITIONS, ("ben@example.com", "Back end", "servers", "One")),
        frame("positions", POSITIONS, ("ben@example.com", "Front end", "pages", "Two")),
        frame("positions", POSITIONS, ("dan@example.com", "Full stack", "both", "Three")),
        frame("positions", POSITIONS, ("dan@example.com", "Design", "looks", "Two")),
        frame("users", USERS, user("dan")),
        frame("candidates", CANDIDATES, ("dan@example.com", "does both")),
        frame("recruiters", "email string", ("dan@example.com",)),
        frame("users", USERS, user("eve")),
        frame("candidates", CANDIDATES, ("eve@example.com", "tries things")),
        frame("recruiters", "email string", ("eve@example.com",)),
        frame("positions", POSITIONS, ("eve@example.com", "Tester", "tries", "Four")),
    ]


class Made:
    def __init__(self, spark):
        self.spark = spark


@pytest.fixture(scope="module")
def loads(spark):
    empty = _empty_tables(Made(spark))
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    first = load_seed(empty, steps(spark), now, "1")
    return first, load_seed(first, steps(spark), now, "2")


def counts(tables):
    return {name: df.count() for name, df in tables.items()}


def test_counts_after_each_load(loads):
    first, second = loads
    nothing = dict(recommendations=0, reactions=0, matches=0, refresh_tokens=0)
    assert counts(first) == dict(
        users=5, candidates=4, recruiters=3, positions=3, embeddings=7, **nothing
    )
    assert counts(second) == dict(
        users=5, candidates=4, recruiters=6, positions=5, embeddings=9, **nothing
    )


def test_references_hold_and_embeddings_wait(loads):
    _, second = loads
    assert audit_foreign_keys(second).filter("orphan_rows > 0").count() == 0
    assert second["embeddings"].select("status").distinct().collect() == [("pending",)]
    for name in ["users", "candidates", "recruiters", "positions"]:
        ids = second[name].select("id")
        assert ids.distinct().count() == ids.count()


def test_rows_of_a_step_go_in_their_order(spark):
    """Of two candidates of one user the first stays, and equal recruiters are two rows."""
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    ann = ("google", "id-ann", "ann@example.com", "ann", "ann_x")
    loaded = load_seed(
        _empty_tables(Made(spark)),
        [
            SeedStep("users", spark.createDataFrame([ann], USERS)),
            SeedStep(
                "candidates",
                spark.createDataFrame([("ann@example.com", "a later", 10), ("ann@example.com", "z first", 9)], CANDIDATES + ", row int"),
                ["row"],
            ),
            SeedStep("recruiters", spark.createDataFrame([("ann@example.com", 1), ("ann@example.com", 2)], "email string, row int"), ["row"]),
        ],
        now,
    )
    assert [r.about for r in loaded["candidates"].collect()] == ["z first"]
    assert loaded["recruiters"].select("id").distinct().count() == 2
