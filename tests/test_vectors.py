import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.fixture import Fixture
from checks.registry import QUERIES
from matchspark.operators import matching, vectors
from matchspark.plans.tiles import merge_top_k, tiled_top_k

DIMENSION = 8
EMBEDDINGS = "object_id string, object_type string, embedding array<float>, status string"


def made(spark, n_left=120, n_right=150, seed=0, copies=False):
    draw = np.random.default_rng(seed)
    rows = []
    for kind, n in [("candidate", n_left), ("position", n_right)]:
        for i in range(n):
            v = draw.standard_normal(DIMENSION)
            if copies and i % 3:
                v = np.ones(DIMENSION)
            v = (v / np.linalg.norm(v)).astype("float32")
            rows.append((f"{kind[:3]}_{i:04d}", kind, v.tolist(), "done"))
    return spark.createDataFrame(rows, EMBEDDINGS)


def brute(embeddings, k):
    rows = embeddings.filter("status = 'done'").collect()
    right = [(r.object_id, np.array(r.embedding, "float64")) for r in rows if r.object_type == "position"]
    out = {}
    for r in rows:
        if r.object_type == "candidate":
            v = np.array(r.embedding, "float64")
            scored = sorted((-round(float(v @ w), 6), i) for i, w in right)
            out[r.object_id] = [(i, -s) for s, i in scored[:k]]
    return out


def as_dict(topk):
    out = {}
    for r in sorted(topk.collect(), key=lambda r: (r.left_id, r["rank"])):
        out.setdefault(r.left_id, []).append((r.right_id, r.score))
    return out


@pytest.mark.parametrize("tile_rows", [None, 32])
@pytest.mark.parametrize("copies", [False, True])
def test_exact_top_k(spark, tile_rows, copies):
    """With many tiles, and with ties across them."""
    embeddings = made(spark, copies=copies)
    got = as_dict(
        vectors.inner_product_topk(embeddings, 7, dimension=DIMENSION, tile_rows=tile_rows)
    )
    want = brute(embeddings, 7)
    assert {c: [i for i, _ in v] for c, v in got.items()} == {
        c: [i for i, _ in v] for c, v in want.items()
    }
    for c in want:
        np.testing.assert_allclose([s for _, s in got[c]], [s for _, s in want[c]], atol=1e-9)


def test_fewer_partners_than_k_and_unfinished_rows(spark):
    embeddings = made(spark, 3, 2).unionByName(
        spark.createDataFrame(
            [
                ("pos_a", "position", None, "pending"),
                ("pos_b", "position", [1.0] * DIMENSION, "failed"),
                ("pos_c", "position", [1.0] * 3, "done"),
            ],
            EMBEDDINGS,
        )
    )
    got = as_dict(vectors.inner_product_topk(embeddings, 10, dimension=DIMENSION))
    assert len(got) == 3 and all(len(v) == 2 for v in got.values())


def test_groups_meet_only_within(spark):
    left = spark.createDataFrame(
        [("a", [1.0, 0.0], 1), ("b", [1.0, 0.0], 2), ("c", [1.0, 0.0], 3)],
        "left_id string, vector array<float>, g int",
    )
    right = spark.createDataFrame(
        [("x", [1.0, 0.0], 1), ("y", [0.5, 0.0], 1), ("z", [1.0, 0.0], 2)],
        "right_id string, vector array<float>, g int",
    )
    got = merge_top_k(tiled_top_k(left, right, 5, 1, ["g"]), 5).collect()
    assert sorted((r.left_id, r.right_id, r["rank"]) for r in got) == [
        ("a", "x", 1),
        ("a", "y", 2),
        ("b", "z", 1),
    ]


def test_approximate_search_finds_most(spark):
    """Vectors around a few centres, as real profiles are."""
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((12, 32))
    rows = []
    for kind in ["candidate", "position"]:
        for i in range(300):
            v = centres[i % 12] + 0.35 * draw.standard_normal(32)
            rows.append((f"{kind[:3]}_{i:04d}", kind, (v / np.linalg.norm(v)).tolist(), "done"))
    embeddings = spark.createDataFrame(rows, EMBEDDINGS)
    exact = vectors.inner_product_topk(embeddings, 10, dimension=32)
    near = vectors.inner_product_topk_approx(embeddings, 10, dimension=32, tables=12, bits=5)
    pairs = near.select("left_id", "right_id", F.col("score").alias("s"))
    both = exact.join(pairs, ["left_id", "right_id"])
    assert both.filter(F.abs(F.col("s") - F.col("score")) > 1e-9).count() == 0
    assert both.count() / exact.count() > 0.9
    assert near.groupBy("left_id", "right_id").count().filter("count > 1").count() == 0


def test_scores_are_clipped_and_rounded(spark):
    nearest = spark.createDataFrame(
        [("c", "p1", 1.2), ("c", "p2", -0.3), ("c", "p3", 0.285), ("c", "p4", 0.5)],
        "left_id string, right_id string, score double",
    )
    known = spark.createDataFrame([("p4", "c")], "position_id string, candidate_id string")
    got = {r.position_id: str(r.score) for r in matching.recommend(nearest, known).collect()}
    assert got == {"p1": "1.00", "p2": "0.00", "p3": "0.29"}


def queue(spark):
    return spark.createDataFrame(
        [
            ("c1", "candidate", "pending"),
            ("c2", "candidate", "pending"),
            ("c3", "candidate", "pending"),
            ("p1", "position", "pending"),
            ("p2", "position", "done"),
        ],
        "object_id string, object_type string, status string",
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))


def texts(spark):
    return spark.createDataFrame(
        [
            ("c1", "candidate", "Spark, spark and SQL"),
            ("c2", "candidate", " ... "),
            ("p1", "position", "spark sql"),
        ],
        "object_id string, object_type string, text string",
    )


def now():
    return F.lit("2024-02-02").cast("timestamp_ntz")


def test_embed_pending(spark):
    out = vectors.embed_pending(queue(spark), texts(spark), now(), 64)
    rows = {r.object_id: r for r in out.collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "c1": "done",
        "c2": "failed",
        "c3": "failed",
        "p1": "done",
    }
    vector = np.array(rows["c1"].embedding)
    assert len(vector) == 64 and abs(np.linalg.norm(vector) - 1) < 1e-6
    assert vector @ np.array(rows["p1"].embedding) > 0.8
    assert rows["c2"].embedding is None
    assert all(r.updated_at.month == 2 and r.created_at.month == 1 for r in rows.values())


def test_embed_with_a_model(spark):
    def lengths(batches):
        for batch in batches:
            yield pd.Series([[float(len(t))] * (3 if len(t) > 9 else 2) for t in batch])

    out = vectors.embed_pending(queue(spark), texts(spark), now(), 3, lengths)
    assert {r.object_id: r.status for r in out.collect()} == {
        "c1": "done",
        "c2": "failed",
        "c3": "failed",
        "p1": "failed",
    }


def test_enqueue_is_idempotent(spark):
    stored = queue(spark).withColumn("updated_at", now()).withColumn(
        "embedding", F.lit(None).cast("array<float>")
    )
    profiles = spark.createDataFrame([("c1",), ("c9",)], "id string")
    none = spark.createDataFrame([], "id string")
    new = vectors.enqueue_embeddings(stored, profiles, none, now())
    assert [(r.object_id, r.object_type, r.status) for r in new.collect()] == [
        ("c9", "candidate", "pending")
    ]
    assert vectors.enqueue_embeddings(stored.unionByName(new), profiles, none, now()).count() == 0


@pytest.mark.parametrize("tile_rows", [None, 32])
def test_known_pairs_are_passed_over_before_ranking(spark, tile_rows):
    embeddings = made(spark, 40, 60)
    first = matching.recommend_new(
        embeddings, spark.createDataFrame([], "position_id string, candidate_id string"), 5, now(),
        dimension=DIMENSION, tile_rows=tile_rows,
    )
    pairs = {(r.candidate_id, r.position_id) for r in first.collect()}
    second = matching.recommend_new(
        embeddings, spark.createDataFrame([(p, c) for c, p in pairs], "position_id string, candidate_id string"), 5, now(),
        dimension=DIMENSION, tile_rows=tile_rows,
    ).collect()
    want = {(c, p) for c, near in brute(embeddings, 10).items() for p, _ in near[5:]}
    assert {(r.candidate_id, r.position_id) for r in second} == want
    assert len({r.id for r in second}) == len(want) == 200


def test_all_pairs_known_leaves_nothing(spark):
    embeddings = made(spark, 3, 4)
    known = spark.createDataFrame(
        [(f"can_{i:04d}", f"pos_{j:04d}") for i in range(3) for j in range(4)], "left_id string, right_id string"
    )
    assert vectors.inner_product_topk(embeddings, 5, dimension=DIMENSION, known=known).count() == 0
    near = vectors.inner_product_topk_approx(embeddings, 5, dimension=DIMENSION, known=known, probe=True)
    assert near.count() == 0


def test_middle_sized_sides_use_many_tasks(spark):
    assert (-(-20_000 // vectors.tile_rows_for(64))) ** 2 >= 8


def test_registered_approximate_search_reaches_its_recall(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    exact = vectors.inner_product_topk(fx.embeddings, 10, dimension=64)
    near = QUERIES["inner_product_topk_approx"](spark, sf_dir)
    assert exact.join(near, ["left_id", "right_id"]).count() >= 0.9 * exact.count()
