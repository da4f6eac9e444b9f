"""Near-duplicate groups with HyperMinHash registers and exact confirmation.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Each set is
compressed to ``BUCKETS`` registers of 16 bits: the shingle hashes are dealt to buckets by
their top bits, and a bucket keeps the smallest rest as its count of leading zeros (6 bits)
and the ``MANTISSA`` bits that follow.  An empty bucket of a small set borrows the register
of a fixed pseudo-random other bucket that is not empty.

1. Equal sets are one class, stood for by its smallest doc_id (partial aggregation, so a
   class of any size costs one row per task).
2. Registers are banded, ``BANDS`` x ``ROWS``.  Representatives that share a band become
   candidates; a pair at 0.85 shares none with probability below 1e-8,
   one at 0.8 below 1e-7.
3. In every band bucket all members meet the smallest one (a star, not all pairs).  Pairs
   are estimated with collision correction; only those six standard deviations or more below
   the threshold go.  Each member's best pair is confirmed on full sets first, then those
   pairs that would still join two components.
4. Buckets that still hold several components are completed: their members are compared
   across components inside tasks, block by block, and what passes the estimate is confirmed
   there.  So no link that a band shows is lost, while only links that join components are put out.

Texts without words have no set and are linked with nothing.  Rows without doc_id are kept
and linked with nothing.  A repeated doc_id is one document: the row with the smallest set hash
(ties: text hash) stands for it in every step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.components import components
from matchspark.llm.text import mix, pieces, shingle_sets
from matchspark.llm.workdir import stored

BUCKETS = 128
MANTISSA = 10
BANDS, ROWS = 32, 4
#: Chance that two different minima share a register, by the published approximation.
COLLISION = 0.169919487159739093975315012348630288992889 / 2**MANTISSA
THRESHOLD = (85, 100)
#: Members of one confirmation task slice, and of one block in a bucket that holds several components.
SLICE = 256
BLOCK = 512

_probe = mix(np.arange(BUCKETS * 64, dtype=np.uint64)).reshape(BUCKETS, 64) % np.uint64(BUCKETS)
_probe = np.concatenate([_probe.astype(np.int64), (np.arange(BUCKETS)[:, None] + np.arange(1, BUCKETS)) % BUCKETS], axis=1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The uint16 registers of a sorted, distinct, non-empty set of hashes."""
    rest = 64 - (BUCKETS.bit_length() - 1)
    bucket = (shingles >> np.uint64(rest)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    value = shingles[first] & np.uint64((1 << rest) - 1)
    fraction, exponent = np.frexp(value.astype(np.float64))
    mantissa = np.minimum(((fraction - 0.5) * (2 << MANTISSA)).clip(0).astype(np.int64), (1 << MANTISSA) - 1)
    zeros = (rest - exponent).clip(0, 62)
    out = np.zeros(BUCKETS, np.uint16)
    out[bucket[first]] = (zeros << MANTISSA) | mantissa
    if len(first) < BUCKETS:
        full = np.zeros(BUCKETS, bool)
        full[bucket[first]] = True
        empty = np.flatnonzero(~full)
        ways = _probe[empty]
        out[empty] = out[ways[np.arange(len(empty)), full[ways].argmax(axis=1)]]
    return out


def signatures(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, n_shingles, print (128-bit hash of the full set) and registers; null where there is no set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            sizes, prints, regs = [], [], []
            for s in shingle_sets(data, offsets, shingle):
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "print", "registers"],
            )

    return _hashed(docs).mapInArrow(scan, "doc_id long, text_hash long, n_shingles long, print binary, registers binary")


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, band, rep): one row per band of each representative."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16)
            bands = regs.reshape(-1, BANDS, ROWS).copy().view(np.uint64).reshape(-1, BANDS)
            with np.errstate(over="ignore"):
                keys = mix(mix(bands) + salt)
            rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(band), pa.array(rep)], names=["key", "band", "rep"])

    return reps.select("rep", "registers").mapInArrow(scan, "key long, band int, rep long")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    same = (a == b).mean(axis=-1)
    return (same - COLLISION) / (1 - COLLISION)


def may_link(jaccard: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """What an estimate and the set sizes do not rule out."""
    part, whole = threshold
    t = part / whole
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    slack = 6 * np.sqrt(t * (1 - t) / np.minimum(BUCKETS, np.maximum(large, 1)))
    return (whole * small >= part * large) & (jaccard >= t - slack)


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b, jaccard) of the pairs that may be links."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb")]
            jaccard = estimate(*regs)
            keep = may_link(jaccard, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")), threshold)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(jaccard)], names=["a", "b", "jaccard"])
            yield out.filter(pa.array(keep))

    side = lambda x: reps.select(F.col("rep").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(scan, "a long, b long, jaccard double")
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs whose full sets reach the threshold.

    Every a-document meets its b-documents in slices of about ``SLICE``: the rows of a slice come
    sorted, a first, and stream past it, so a task holds one set beside the batch being read.
    """
    part, whole = threshold
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    member = pairs.join(degree, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("role"), F.col("b").alias("doc_id")
    )
    hub = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    rows = (
        member.unionByName(hub)
        .join(texts, "doc_id")
        .repartition("a", "slice")
        .sortWithinPartitions("a", "slice", "role")
        .select("a", "slice", "role", "doc_id", "text")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set = np.empty(0, np.uint64)
        for rows_, data, offsets in pieces(batches):
            links: list[tuple[int, int]] = []
            columns = (rows_.column(c).to_pylist() for c in ("a", "role", "doc_id"))
            for a, role, b, s in zip(*columns, shingle_sets(data, offsets, shingle)):
                if role == 0:
                    hub_set = s
                    continue
                both = len(np.intersect1d(hub_set, s, assume_unique=True))
                if both and whole * both >= part * (len(hub_set) + len(s) - both):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(scan, "a long, b long")


def _across(buckets: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): links that join the components of members sharing a bucket, confirmed on full sets.

    A bucket is cut into blocks of about ``BLOCK`` members; each pair of blocks meets in one
    group.  Members of different components whose estimate allows it are confirmed there, in the
    first band they share, and a link that joins two components is put out: a row per member at most.
    """
    part, whole = threshold
    blocks = buckets.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = (
        buckets.join(blocks, "key")
        .withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "band", "rep", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(reps.select("rep", "registers", "n_shingles").join(texts, F.col("rep") == F.col("doc_id")).drop("doc_id"), "rep")
    )

    def compare(group: pa.Table) -> pa.Table:
        band = group.column("band")[0].as_py()
        rep, n, block, i = (group.column(c).to_numpy() for c in ("rep", "n_shingles", "block", "i"))
        comp = group.column("component").to_numpy().copy()
        regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        bands = regs.reshape(-1, BANDS, ROWS)
        right_only = block != i
        left = np.flatnonzero(~right_only)
        right = np.flatnonzero(right_only) if right_only.any() else left
        sets: list[np.ndarray] | None = None
        links: list[tuple[int, int]] = []
        for x in left.tolist():
            others = right[comp[right] != comp[x]]
            if not len(others):
                continue
            others = others[may_link(estimate(regs[others], regs[x]), n[others], n[x], threshold)]
            if band and len(others):
                others = others[~(bands[others, :band] == bands[x, :band]).all(axis=2).any(axis=1)]
            if not len(others):
                continue
            if sets is None:
                sets = [s for _, data, offsets in pieces(group.to_batches()) for s in shingle_sets(data, offsets, shingle)]
            own = sets[x]
            for at in range(0, len(others), 64):
                some = others[at : at + 64]
                joined = np.concatenate([sets[o] for o in some.tolist()])
                spot = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                both = np.add.reduceat((own[spot] == joined).astype(np.int64), np.cumsum(n[some]) - n[some])
                for o in some[whole * both >= part * (n[some] + n[x] - both)].tolist():
                    if comp[o] != comp[x]:
                        links.append((int(min(rep[o], rep[x])), int(max(rep[o], rep[x]))))
                        comp[comp == max(comp[o], comp[x])] = min(comp[o], comp[x])
        return pa.table({c: pa.array([p[k] for p in links], pa.int64()) for k, c in enumerate("ab")})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _relabelled(links: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, component) of all representatives under these links."""
    found = components(links)
    return stored(
        reps.select("rep").join(found, reps["rep"] == found["node"], "left").select("rep", F.coalesce("component", "rep").alias("component")),
        "labels",
    )


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    x = labels.select(F.col("rep").alias("a"), F.col("component").alias("ca"))
    y = labels.select(F.col("rep").alias("b"), F.col("component").alias("cb"))
    return pairs.join(x, "a").join(y, "b").where("ca <> cb").drop("ca", "cb")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, representative (smallest doc_id of equal sets), component_id, kept."""
    signed = stored(signatures(docs, shingle), "signatures")
    named = signed.where("doc_id is not null").groupBy("doc_id").agg(
        F.min_by(
            F.struct("text_hash", "n_shingles", "print", "registers"),
            F.struct(F.coalesce("print", F.lit(b"").cast("binary")).alias("p"), "text_hash"),
        ).alias("s")
    ).select("doc_id", "s.*")
    reps = stored(
        named.where("print is not null")
        .groupBy("print", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.first("registers").alias("registers")),
        "representatives",
    )
    keys = stored(band_keys(reps), "bands")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub")).where("n > 1").drop("n")
    buckets = stored(keys.join(shared, "key"), "buckets")
    stars = stored(
        _estimated(buckets.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), reps, threshold), "stars"
    )
    members = reps.select(F.col("rep").alias("doc_id"), "text_hash").join(
        buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"
    )
    texts = stored(_hashed(docs).join(members, ["doc_id", "text_hash"], "left_semi").drop("text_hash").dropDuplicates(["doc_id"]), "texts")
    confirm = lambda pairs: _confirmed(pairs, texts, shingle, threshold)
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("jaccard", (-F.col("a")).alias("first"))).alias("a")).select("a", "b")
    links = stored(confirm(best), "links")
    labels = _relabelled(links, reps)
    rest = stars.select("a", "b").join(best, ["a", "b"], "left_anti")
    links = stored(links.unionByName(confirm(_apart(rest, labels))), "links")
    labels = _relabelled(links, reps)
    placed = buckets.join(labels, "rep")
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    # The hub has met every member of its bucket already.
    open_ = placed.where("rep <> hub").join(mixed, "key", "left_semi").select("key", "band", "rep", "component")
    links = stored(links.unionByName(_across(open_, reps, texts, shingle, threshold)), "links")
    labels = _relabelled(links, reps)

    classes = named.join(reps.select("print", "n_shingles", "rep"), ["print", "n_shingles"]).select("doc_id", F.col("rep"))
    found = classes.join(labels, "rep").select(
        F.col("doc_id").alias("id"), F.col("rep").alias("representative"), F.col("component").alias("component_id")
    )
    return (
        signed.select("doc_id", "n_shingles")
        .join(found, signed["doc_id"] == found["id"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("representative", "doc_id").alias("representative"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, without those that stand behind another of their group."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
