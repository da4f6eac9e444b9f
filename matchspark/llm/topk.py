"""Exact top-k by inner product with no-random-access aggregation.

Vectors become integers, floor(scale * x).  Candidates are dealt into shards of about
``SHARD`` rows.  In a shard every component is a sorted list; a query reads its lists from
the best end, in steps.  At each depth a row's lower bound takes the worst value for what is
unread and its upper bound the value read last; rows whose upper bound is below the k-th
lower bound go, and reading stops when only k remain.  The final scores of the survivors
are then resolved, ties to the smaller id, and the shards' lists are merged per query.

Queries meet shards in blocks of ``QUERIES``: a stated query set against all rows.  Vectors
that are null, or hold null or non-finite components, and rows without id take no part; vectors
of different lengths are not compared.  An empty side gives no rows.

Every row is a candidate and may be a query, also where ids repeat: a query leaves out its own
row only.  Equal rows travel once, with their number.  Vectors with a component of 2**27 or more
after scaling are computed in Python's integers; a score that no long holds is null, at its rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 8192
QUERIES = 1024
#: Parts of each list after which bounds are compared.
DEPTHS = (0.5, 0.8, 0.95)
#: Queries that read a shard's lists together.
TOGETHER = 128


#: Components up to here keep scores of 512 components and their bounds within 63 bits.
NARROW = 1 << 27


def whole_vectors(df: DataFrame, id_: str, vector: str, scale: int) -> DataFrame:
    """(id, dim, narrow, v, n): the distinct integer vectors that take part, as int32 or as text, and how many rows have them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bool, bytes]] = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
                    continue
                if all(abs(x) < NARROW // scale for x in v):
                    rows.append((i, len(v), True, np.floor(np.array(v, np.float64) * scale).astype(np.int32).tobytes()))
                else:
                    whole = [math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale for x in v]
                    rows.append((i, len(v), False, ",".join(map(str, whole)).encode()))
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["id", "dim", "narrow", "v"])

    parts = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(scan, "id long, dim int, narrow boolean, v binary")
    return parts.groupBy("id", "dim", "narrow", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("print", F.xxhash64("v"))


def _whole(v: bytes, narrow: bool) -> list[int]:
    return np.frombuffer(v, np.int32).tolist() if narrow else list(map(int, v.split(b",")))


def _ordered(score: int) -> tuple[int | None, int, bytes | None]:
    """(score if a long holds it, its length in binary digits beyond that with its sign, bytes that order scores of one length)."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, None
    size = score.bit_length()
    high = score if score > 0 else (1 << size) - 1 + score
    return None, size if score > 0 else -size, high.to_bytes((size + 7) // 8, "big")


class Lists:
    """The sorted lists of a shard, one per component, and each row's place in every list."""

    def __init__(self, rows: np.ndarray):
        self.whole = rows.astype(np.int64)
        self.rows = rows.astype(np.float64)
        order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.rows, order, axis=0)
        self.place = np.empty(rows.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(rows), dtype=np.int32)[:, None], axis=0)
        self.largest = np.abs(self.rows).max(axis=0, initial=0)

    def top(self, queries: np.ndarray, k: int, skip: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that may be among its k best; ``skip`` (row, query) pairs are left out.

        Positive components read their list from its upper end, negative ones from its lower end.
        A row's bounds are its read part plus the worst, or the last read, value of the unread lists.
        """
        n = len(self.rows)
        up, down = np.maximum(queries, 0).T.astype(np.float64), np.minimum(queries, 0).T.astype(np.float64)
        slack = 1e-12 * (self.largest @ (up - down))  # for rounding of sums over 2**53
        alive = ~skip
        for part in DEPTHS:
            depth = max(k, int(part * n))
            if depth >= n or (alive.sum(axis=0) <= k).all():
                break
            rows = np.flatnonzero(alive.any(axis=1))
            from_top, from_bottom = self.place[rows] >= n - depth, self.place[rows] < depth
            read = (self.rows[rows] * from_top) @ up + (self.rows[rows] * from_bottom) @ down
            last = self.sorted[n - depth, :, None] * up, self.sorted[depth - 1, :, None] * down
            high = read + (~from_top) @ last[0] + (~from_bottom) @ last[1]
            low = read + (~from_top) @ (self.sorted[0, :, None] * up) + (~from_bottom) @ (self.sorted[-1, :, None] * down)
            low[~alive[rows]] = -np.inf
            if len(rows) > k:
                alive[rows] &= high + slack >= np.partition(low, len(rows) - k, axis=0)[len(rows) - k] - slack
        return [np.flatnonzero(a) for a in alive.T]


def top_k(
    df: DataFrame, is_query: Column, k: int = 10, id_: str = "vec_id", vector: str = "embedding", scale: int = 1024
) -> DataFrame:
    """(query_id, rank, id, score): the k best other rows of ``df`` for each row where ``is_query`` holds."""
    rows = whole_vectors(df, id_, vector, scale)
    asked = whole_vectors(df.where(is_query), id_, vector, scale)
    shards = max(1, math.ceil(df.count() / SHARD))
    blocks = max(1, math.ceil(df.where(is_query).count() / QUERIES))
    shard = rows.withColumn("shard", F.pmod(F.xxhash64("id", "print"), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "print"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and queries.num_rows:
            ids, prints, n = (candidates.column(c).to_numpy() for c in ("id", "print", "n"))
            vectors, narrow = candidates.column("v").to_pylist(), candidates.column("narrow").to_numpy()
            asking, asked_print, times = (queries.column(c).to_numpy() for c in ("id", "print", "n"))
            wanted, simple = queries.column("v").to_pylist(), queries.column("narrow").to_numpy()
            matrix = lambda vs: np.frombuffer(b"".join(vs), np.int32).reshape(len(vs), -1)
            small, large = np.flatnonzero(narrow), np.flatnonzero(~narrow).tolist()
            lists = Lists(matrix([vectors[i] for i in small.tolist()])) if len(small) else None
            wide = {i: _whole(vectors[i], False) for i in large}

            def put(q: int, at: list[int], scores: list[int]) -> None:
                best = sorted(range(len(at)), key=lambda x: (-scores[x], ids[at[x]]))[:k]
                for x in best:
                    own = ids[at[x]] == asking[q] and prints[at[x]] == asked_print[q]
                    out.append((asking[q], asked_print[q], times[q], ids[at[x]], n[at[x]] - own, *_ordered(scores[x])))

            def others(q: int, at: list[int]) -> list[int]:
                return [i for i in at if n[i] > 1 or ids[i] != asking[q] or prints[i] != asked_print[q]]

            exact = lambda v, i: sum(a * b for a, b in zip(v, wide[i] if i in wide else _whole(vectors[i], True)))
            fast = np.flatnonzero(simple) if lists else np.empty(0, np.int64)
            for a in range(0, len(fast), TOGETHER):
                some = fast[a : a + TOGETHER]
                v = matrix([wanted[q] for q in some.tolist()]).astype(np.int64)
                alone = (ids[small, None] == asking[some]) & (prints[small, None] == asked_print[some]) & (n[small, None] == 1)
                for q, x, at in zip(some.tolist(), v, lists.top(v, k, alone)):
                    scores = (lists.whole[at] @ x).tolist()
                    more = others(q, large)
                    put(q, [*small[at].tolist(), *more], [*scores, *(exact(x.tolist(), i) for i in more)])
            for q in np.flatnonzero(~simple).tolist() if lists else range(len(asking)):
                v, at = _whole(wanted[q], bool(simple[q])), others(q, list(range(len(ids))))
                put(q, at, [exact(v, i) for i in at])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, kinds))})

    names = ("query_id", "print", "times", "id", "n", "score", "size", "high")
    keys = ("dim", "shard", "block")
    shape = "query_id long, print long, times long, id long, n long, score long, size int, high binary"
    near = shard.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, shape)
    order = Window.partitionBy("query_id", "print").orderBy(F.col("size").desc(), F.col("score").desc(), F.col("high").desc(), F.col("id"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    repeated = lambda c: F.explode(F.sequence(F.lit(1), c.cast("int")))
    # Equal candidates are ranked one by one; a repeated query has its list as often.
    best = ranked(ranked(near).withColumn("copy", repeated(F.least("n", F.lit(k)))))
    return best.withColumn("copy", repeated(F.col("times"))).select("query_id", "rank", F.col("id").alias(id_), "score")
