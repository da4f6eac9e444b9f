import math
import random

import pytest
from llm_frames import frame, words
from pyspark.sql import functions as F

from matchspark.llm import mixing, topk


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, id string")


def brute(rows, k):
    """Every row against every other row, whatever their ids."""
    ok = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(ok):
        if q % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for other, (i, b) in enumerate(ok) if other != at and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s if abs(s) < 2**63 else None) for n, (s, i) in enumerate(scores)]
    return ordered(out)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("shard", [8192, 60])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERIES", 8 if shard == 60 else 1024)
    rng = random.Random(4)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25, 0.0]) for _ in range(6)], "s", "i") for i in range(300)]
    rows += [(300 + i, [1.0] * 6, None, None) for i in range(30)]  # ties
    rows += [(1001, None, "", ""), (1010, [1.0, None, 0, 0, 0, 0], "", ""), (1020, [float("nan")] * 6, "", ""), (1030, [float("inf")] * 6, "", "")]
    rows += [(2000, [1.0, 2.0], "", ""), (2001, [3.0, 1.0], "", "")]  # another length: fewer than k
    rows = [(i, [None if x is None else float(x) for x in v] if v is not None else None, s, t) for i, v, s, t in rows]
    df = vectors(spark, rows)
    rounded = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = ordered(topk.top_k(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rounded, 10)


@pytest.mark.parametrize("shard", [8192, 20])
def test_components_of_any_size_and_repeated_ids(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERIES", 8 if shard == 20 else 1024)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(70 + i, [rng.choice([1e30, -1e30, 131072.0, 1e9, 0.0, 1.0]) for _ in range(4)]) for i in range(20)]
    rows += [(10, [1e30, 1e30, 0.0, 1.0]), (10, [0.5] * 4), (10, [0.5] * 4), (10, [0.5] * 4), (33, [2.0] * 4)] + [(33, [3.0] * 4)] * 15
    df = vectors(spark, [(i, v, "s", "i") for i, v in rows])
    rounded = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = ordered(topk.top_k(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rounded, 10)
    assert any(r[3] is None for r in got) and sum(r[0] == 10 for r in got) == 50


def test_no_vectors(spark):
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(3, [1.0], "", "")]), F.col("vec_id") % 10 == 0).count() == 0


def filled(sizes):
    """Targets by sharing again and again until none is above three times its size."""
    total = sum(s for _, s in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, (n, _) in enumerate(sizes)}
    cap, target, left, open_ = {n: 3 * s for n, s in sizes}, {}, total, [n for n, _ in sizes]
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > cap[n]]
        if not over:
            target.update(share)
            break
        for n in over:
            target[n] = cap[n]
            left -= cap[n]
        open_ = [n for n in open_ if n not in over]
    return target


def mix_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "b", "b", "b", "b", "ü", "z", None, "d", "e"])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), "en", source))
    return rows + [(700, None, "en", "a"), (701, "  \n", "en", "empty"), (None, "x y", None, "b")]


def test_targets_and_taken(spark):
    rows = mix_rows(1)
    got = mixing.plan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {n: sum(len((r[1] or "").split()) for r in rows if r[3] == n) for n in names}
    target = filled([(n, size[n]) for n in names])
    assert math.isclose(sum(target.values()), sum(size.values()))
    for n in names:
        mine = [r for r in got if r["source"] == n]
        assert all(math.isclose(r["target"], target[n], abs_tol=1e-9) and r["source_size"] == size[n] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[n]) <= max((r["size"] for r in mine), default=0)
    assert all(r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"] for r in got)
    assert all(0 <= p <= 1 for r in got for p in r["positions"])


def test_mix_is_sorted_whole_and_repeatable(spark):
    df = frame(spark, mix_rows(2))
    out = mixing.mixed(df)
    rows = out.collect()
    assert out.columns == [*[c for c in df.columns if c != "copy"], "copy", "position"]
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert rows == mixing.mixed(df.repartition(7)).collect()
    planned = mixing.plan(df).agg(F.sum("copies")).first()[0]
    assert len(rows) == planned


def test_the_schedule_is_followed(spark):
    """A rising weight gives few words early and many late: u words' share is met at t with t + a(t*t - t) = u."""
    df = spark.createDataFrame([(i, "w " * 10, s) for i in range(3000) for s in ["x"]] + [(5000 + i, "w " * 10, s) for i in range(3000) for s in ["y"]], "doc_id long, text string, source string")
    rows = mixing.plan(df, weights=(1, 1), slopes=(0.5, -0.5)).collect()
    for source, a in (("x", 0.5), ("y", -0.5)):
        times = sorted(p for r in rows if r["source"] == source for p in r["positions"])
        for t in (0.25, 0.5, 0.75):
            met = sum(p <= t for p in times) / len(times)
            assert abs(met - (t + a * (t * t - t))) < 0.01


def test_odd_rows(spark, odd, none):
    got = mixing.plan(odd).collect()
    assert len(got) == odd.count()
    assert sum(r["size"] == 0 for r in got) == 4
    assert mixing.plan(none).count() == 0 and mixing.mixed(none).count() == 0
    assert "copy" in mixing.mixed(odd).columns


def test_equal_rows_are_mixed_as_planned(spark):
    """What the mix holds of equal rows is what the plan takes of them."""
    rng = random.Random(3)
    rows = [(7, words(rng, 10), "en", "a")] * 100 + [(i, words(rng, 12), "en", "bc"[i % 2]) for i in range(60)] + [(None, "x y z", "en", "a")] * 5
    df = frame(spark, rows)
    planned = mixing.plan(df).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    out = mixing.mixed(df)
    assert {r.doc_id: r.n for r in planned} == {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert sorted(r.position for r in out.collect()) == sorted(p for r in mixing.plan(df).collect() for p in r.positions)


def test_shares_are_counted_in_the_mix(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(7, words(rng, 10), "en", "a")] * 40 + [(i, words(rng, 12), "en", "bc"[i % 2]) for i in range(60)] + [(None, "x y z", "en", "a")] * 5 + [(99, None, "en", None)]
    df = frame(spark, rows)
    key = lambda r: (str(r.doc_id), r.size, r.source_size, r.target, r.copies, r.taken)
    planned = mixing.plan(df).collect()
    got = mixing.shares(df).collect()
    assert sorted((*key(r), str(r.position)) for r in got) == sorted((*key(r), str(r.positions[0] if r.positions else None)) for r in planned)
    # A copy that the mix lacks is not counted.
    made = mixing._copies
    monkeypatch.setattr(mixing, "_copies", lambda docs, **options: made(docs, **options).where("doc_id <> 7"))
    assert {r.taken for r in mixing.shares(df).collect() if r.doc_id == 7} == {0}
