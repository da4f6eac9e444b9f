import hashlib
import math
import random

import numpy as np

from matchspark.llm import centroids
from matchspark.llm.queries import op13_centroid_clusters

SCHEMA = "vec_id long, embedding array<double>, id string, v string, cluster int, place int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, "i", "v", 1, 2) for i, e in rows], SCHEMA)


def slow(rows, k, rounds, d, scale=256):
    """{(vec_id, integers): [(cluster, distance)]}, centroids: Lloyd's rounds in whole numbers."""
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in e]) for i, e in rows
            if e is not None and len(e) == d and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), x in zip(kept, of) if x == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = {j: sum(x for _, at, x in found if at == j) for j in range(len(c))}
    fits = lambda x: x if x < 1 << 63 else None
    whole = sum(total.values())
    return [(i, j, fits(x), fits(total[j]) if fits(x) is not None else None, fits(whole), ",".join(map(str, c[j]))) for i, j, x in found]


def check(spark, rows, k, rounds, d):
    got = centroids.cluster_vectors(vectors(spark, rows), k=k, rounds=rounds, dimension=d).collect()
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))
    want = slow(rows, k, rounds, d)
    assert order(got) == order(want)
    return want


def test_lloyd_in_whole_numbers(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(8)]) for i in range(600)]
    check(spark, rows, 12, 4, 8)


def test_ties_repeated_rows_and_rows_that_take_no_part(spark):
    grid = [(i % 30, [float(i % 3), float(i % 2), -1.0]) for i in range(120)]
    odd = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, math.nan, 2.0]), (203, [math.inf, 0.0, 0.0]), (204, [1.0]), (205, []), (None, [0.5, 0.5, 0.5])]
    want = check(spark, grid + odd, 7, 3, 3)
    assert len(want) == 121


def test_components_of_any_size(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(60)]
    rows += [(100, [1e300, 0.0, 0.0, 0.0]), (101, [-1.7e308, 1.0, 2.0, 3.0]), (102, [2.0**40] * 4), (103, [3e6, -3e6, 0.0, 1.0]), (104, [1e300, 1e10, 0.5, 0.0])]
    for k in (3, 40, 100):
        check(spark, rows, k, 3, 4)


def test_no_rows_and_fewer_rows_than_centroids(spark):
    assert centroids.cluster_vectors(vectors(spark, []), dimension=2).collect() == []
    check(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], 40, 5, 2)


def test_scan_agrees_with_all_distances():
    rng = np.random.default_rng(5)
    for spread in (1, 50, 10_000, 1 << 22):
        rows = rng.integers(-spread, spread + 1, (40, 64)).tolist()
        v = rng.integers(-spread, spread + 1, (500, 64))
        number, distance = centroids.Centroids(rows).nearest(v)
        every = ((v[:, None] - np.array(rows)[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_scan_passes_over_most_centroids(monkeypatch):
    rng = np.random.default_rng(6)
    middles = np.sort(rng.integers(-5000, 5000, 40))
    rows = (middles[:, None] + rng.integers(-20, 20, (40, 64))).tolist()
    v = middles[rng.integers(0, 40, 400)][:, None] + rng.integers(-20, 20, (400, 64))
    seen = []
    search = centroids.Centroids(rows)

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(len(at))
            return np.asarray(super().__getitem__(at))

    search.matrix = search.matrix.view(Counted)
    search.nearest(v)
    assert sum(seen) < 0.1 * 40 * len(v)


def test_query_on_the_tables(spark, duck, sf_dir):
    rows = op13_centroid_clusters(spark, sf_dir).collect()
    assert len(rows) == duck.execute("select count(*) from embeddings").fetchone()[0]
    assert len({r.cluster for r in rows}) > 20
