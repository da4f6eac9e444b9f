"""Centroid clustering of whole-number vectors by equal-average equal-variance search.

Components become integers, floor(scale * x).  Centroids stand sorted by their component sum
(their mean times the dimension).  A vector starts at its own mean and scans outward.  With
gap the difference of the sums and d the dimension, no centroid is nearer than gap**2 / d, so
the scan ends once that exceeds the best distance; a centroid on the way is passed over if
gap**2 / d plus the squared difference of the deviations exceeds it.  What is left is decided
by exact integer distances, ties to the smaller number.

A round is one pass: tasks assign their vectors and put out, per cluster, its count and
component sums as limbs of ``LIMB`` bits, which Spark adds up; the driver sees the sums of k
centroids only, and replaces each by floor(sum / count) in whole numbers of any size.

Vectors that are null, of another length, or hold null or non-finite components take no part.
Repeated ids are a vector each; a null id counts as empty text in the order of the first
centroids, where equal ids stand by their components.  Fewer vectors than k give as many
centroids; an empty table gives no rows.  Components of more than 2**30 / d are
computed in Python's integers; a distance or inertia that no long holds is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, ROUNDS, DIMENSION, SCALE = 40, 5, 64, 256
#: Components times dimension up to here keep every distance and bound within 63 bits.
NARROW = 1 << 30
LIMB = 40
#: Vectors that are searched together.
TOGETHER = 8192


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x) of a finite double; exact, also where the product is no double."""
    return math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale


class Centroids:
    """Centroids (lists of Python integers) sorted by mean, for the search by narrow vectors."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        narrow = [i for i, r in enumerate(rows) if max(map(abs, r), default=0) * len(r) <= NARROW]
        self.wide = [i for i in range(len(rows)) if i not in set(narrow)]
        number = np.array(sorted(narrow, key=lambda i: (sum(rows[i]), i)), np.int64)
        self.number = number
        self.matrix = np.array([rows[i] for i in number.tolist()], np.int64).reshape(len(number), len(rows[0]) if rows else 0)
        self.sums = self.matrix.sum(axis=1)
        self.deviation = deviations(self.matrix)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """(number of the nearest centroid, squared distance) of narrow vectors."""
        number, distance = self._scan(v)
        for c in self.wide:
            far = ((v.astype(object) - np.array(self.rows[c], object)) ** 2).sum(axis=1)
            distance = distance.astype(object)
            better = (number < 0) | (far < distance) | ((far == distance) & (c < number))
            number, distance = np.where(better, c, number), np.where(better, far, distance)
        return number, distance

    def nearest_wide(self, v: list[int]) -> tuple[int, int]:
        """The same for one vector of integers of any size."""
        distance, number = min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(self.rows))
        return number, distance

    def _scan(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, d = self.matrix.shape[0], v.shape[1]
        best, who = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), -1, np.int64)
        if not k:
            return who, best
        sums, spread = v.sum(axis=1), deviations(v)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        never = np.int64(1) << 40
        open_ = np.arange(len(v))
        for step in range(k):
            low = np.where(left >= 0, sums[open_] - self.sums[np.maximum(left, 0)], never)
            high = np.where(right < k, self.sums[np.minimum(right, k - 1)] - sums[open_], never)
            gap = np.minimum(low, high)
            if step:
                # The gap only grows, so a vector whose mean is too far from here on is done.
                stay = np.minimum(gap, 1 << 31) ** 2 <= d * np.minimum(best[open_], (1 << 62) // d)
                open_, left, right, low, high, gap = (x[stay] for x in (open_, left, right, low, high, gap))
                if not len(open_):
                    break
            at = np.where(low <= high, left, right)
            left, right = left - (low <= high), right + (low > high)
            bound = gap.astype(np.float64) ** 2 / d + (spread[open_] - self.deviation[at]) ** 2
            near = bound * (1 - 1e-9) - 1e-3 <= best[open_]  # room for the rounding of the deviations
            row, c = open_[near], at[near]
            distance = ((v[row] - self.matrix[c]) ** 2).sum(axis=1)
            better = (distance < best[row]) | ((distance == best[row]) & (self.number[c] < who[row]))
            best[row[better]], who[row[better]] = distance[better], self.number[c[better]]
        return who, best


def deviations(v: np.ndarray) -> np.ndarray:
    """Root of the squared differences from the mean; the radicand is exact before it is divided."""
    d = max(1, v.shape[1])
    return np.sqrt((d * (v * v).sum(axis=1) - v.sum(axis=1) ** 2) / d)


def _vectors(batches: Iterator[pa.RecordBatch], scale: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[int, list[int]]]]]:
    """(rows, their narrow integers with 0 for wide ones, (row, integers) of the wide ones)."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            large = (np.abs(x) >= NARROW // d / scale).any(axis=1)
            wide = [(i, [whole(c, scale) for c in x[i].tolist()]) for i in np.flatnonzero(large).tolist()]
            yield part, np.floor(np.where(large[:, None], 0.0, x) * scale).astype(np.int64), wide


def _assigned(centroids: Centroids, v: np.ndarray, wide: list[tuple[int, list[int]]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    number, distance = centroids.nearest(v)
    if wide:
        distance = distance.astype(object)
        for i, row in wide:
            number[i], distance[i] = centroids.nearest_wide(row)
    return number, distance


def _sums(kept: DataFrame, rows: list[list[int]], scale: int, d: int) -> list[tuple[int, list[int]]]:
    """(count, component sums) of the vectors nearest to each centroid."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        count, total = [0] * len(rows), np.zeros((len(rows), d), object)
        for _, v, wide in _vectors(batches, scale, d):
            number, _ = _assigned(centroids, v, wide)
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.diff(number[order], prepend=-1))
            for c, n, s in zip(number[order][first].tolist(), np.diff(np.append(first, len(order))).tolist(), np.add.reduceat(v[order], first, axis=0).tolist()):
                count[c] += n
                total[c] += s
            for i, row in wide:
                total[number[i]] += row
        out: list[tuple[int, int, int, int]] = []
        for c, n in enumerate(count):
            if not n:
                continue
            out.append((c, -1, 0, n))
            for place, s in enumerate(total[c].tolist()):
                size, limb = abs(s), 0
                while size:
                    out.append((c, place, limb, (size & ((1 << LIMB) - 1)) * (1 if s > 0 else -1)))
                    size, limb = size >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["cluster", "place", "limb", "value"],
        )

    parts = kept.select("v").mapInArrow(scan, "cluster int, place int, limb int, value long")
    found: list[tuple[int, list[int]]] = [(0, [0] * d) for _ in rows]
    # At most k * (d + 1) rows for each limb.
    for c, place, limb, value in parts.groupBy("cluster", "place", "limb").agg(F.sum("value")).collect():
        n, s = found[c]
        if place < 0:
            found[c] = value, s
        else:
            s[place] += value << (LIMB * limb)
    return found


def kept_vectors(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """(id, v): the rows that take part, components as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # A comparison with null is null, which a filter takes as false.
    return df.select(F.col(id_).alias("id"), v.alias("v")).where((F.size("v") == dimension) & finite)


def cluster_vectors(
    df: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    id_: str = "vec_id",
    vector: str = "embedding",
    dimension: int = DIMENSION,
    scale: int = SCALE,
    salt: str = "2:",
) -> DataFrame:
    """Per vector: id, cluster, distance, cluster_inertia, inertia, centroid (its components as text).

    The first centroids are the k vectors with the smallest sha256 of ``salt`` and their id.
    """
    kept = kept_vectors(df, id_, vector, dimension)
    place = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.orderBy(place, "v").limit(k).select("v").collect()
    rows = [[whole(x, scale) for x in r["v"]] for r in first]
    for _ in range(rounds if rows else 0):
        rows = [[x // n for x in s] if n else old for old, (n, s) in zip(rows, _sums(kept, rows, scale, dimension))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        for part, v, wide in _vectors(batches, scale, dimension):
            number, distance = _assigned(centroids, v, wide)
            if distance.dtype == object:
                distance = pa.array([x if x < 1 << 63 else None for x in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    kind = df.schema[id_].dataType.simpleString()
    assigned = kept.mapInArrow(scan, f"id {kind}, cluster int, distance long")
    whole_sum = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), whole_sum).alias("s")).collect()
    fits = lambda s: None if s is None or s >= 1 << 63 else int(s)
    inertias = {r["cluster"]: fits(r["s"]) for r in sums}
    everything = fits(None if any(r["s"] is None for r in sums) else sum(r["s"] for r in sums))
    each = F.array(*[F.lit(inertias.get(c)).cast("long") for c in range(len(rows))]) if rows else F.array().cast("array<long>")
    texts = F.array(*[F.lit(",".join(map(str, r))) for r in rows]) if rows else F.array().cast("array<string>")
    at = F.col("cluster") + 1
    return assigned.select(
        F.col("id").alias(id_),
        "cluster",
        "distance",
        F.try_element_at(each, at).alias("cluster_inertia"),
        F.lit(everything).cast("long").alias("inertia"),
        F.try_element_at(texts, at).alias("centroid"),
    )
