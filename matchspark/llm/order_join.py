"""Exact set-similarity join of texts with prefix filters under several token orders.

A document's set holds the 64-bit hashes of its distinct three-word shingles.  Two sets of n
and m tokens with a Jaccard similarity of t share a token among the first n - ceil(t * n) + 1
and the first m - ceil(t * m) + 1 tokens of *every* order of all tokens.  ``ORDERS`` orders are
used.  Each puts tokens of a smaller frequency class first and mixes a class by its own seed;
classes are powers of two of the counts, over all documents, of the ``SLOT_BITS``-bit slots that
tokens fall into, so the orders take ``2**SLOT_BITS`` bytes whatever the input.

1. Equal sets are one class, stood for by its smallest doc_id.
2. The prefix tokens of the first order are an index.  Its cells are (token, length band): sets
   whose lengths allow the threshold lie in one band or in neighbouring ones, so a set enters the
   cell of its band and, as a guest, the next one.  Two guests need not meet.
3. Every set carries a mark: for each further order its prefix as a bit set (two prefixes that
   share a token share a bit), and the parities of its tokens over some bits (which differ in no
   more bits than the sets differ in tokens).  A mark has a power of two of words, in proportion
   to the set, and folds to a smaller one.  A pair of a cell is a candidate only if lengths, all
   prefixes and parities allow it.
4. In every cell the members meet one of them first (a star, not all pairs), in ``STARS`` rounds;
   candidates are verified on full sets and their links joined to components.
5. Cells that still hold several components are cut into blocks of a bounded number of tokens.
   Pairs of blocks are compared by marks, and a block pair puts out only links that join components.

Texts are fetched only for members of candidate pairs: a bit map of the members' hashes, of
``2**FETCH_BITS`` bits whatever the input, leaves most other texts where they are.

No link is lost: filters are necessary conditions, and every pair of a cell is compared, unless
its ends are in one component already.

Texts without words have no set and are linked with nothing.  Rows without doc_id are kept and
linked with nothing.  A repeated doc_id is one document: the row with the smallest set hash
(ties: text hash) stands for it.  doc_id must be a whole number, or cast to one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.components import components
from matchspark.llm.text import mix, pieces, shingle_sets
from matchspark.llm.workdir import stored

SHINGLE = 3
THRESHOLD = (90, 100)
ORDERS = 3
SLOT_BITS = 18
STARS = 2
#: 64-bit words of the smallest mark: parities, then one bit set for each order after the first.
PARITY_WORDS, PREFIX_WORDS = 8, 4
#: Tokens for which the smallest mark is enough, and how often it is doubled at most: beyond, marks rule out less.
MARK_TOKENS, DOUBLED = 1024, 6
#: Tokens of a block of a cell (a set counts ``SET_COST`` more), and members of a verification slice.
BLOCK_TOKENS, SET_COST = 1 << 20, 1000
SLICE = 256
#: Bits of the map of texts to fetch, a multiple of the 4,096 bytes of one of its rows.
FETCH_BITS = 25

_SEEDS = mix(np.arange(1, ORDERS + 2, dtype=np.uint64))


def slot_classes(docs: DataFrame, shingle: int = SHINGLE, bits: int = SLOT_BITS) -> np.ndarray:
    """Per slot the number of binary digits of its token count; at most 2**bits rows reach the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for _, data, offsets in pieces(batches):
            sets = [s for s in shingle_sets(data, offsets, shingle) if len(s)]
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(scan, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    classes = np.zeros(1 << bits, np.uint8)
    classes[counted.column("slot").to_numpy()] = np.frexp(counted.column("n").to_numpy().astype(np.float64))[1]
    return classes


def prefix_length(n: int, threshold: tuple[int, int]) -> int:
    """n - ceil(t * n) + 1 in whole numbers."""
    part, whole = threshold
    return n + (-part * n) // whole + 1


def prefix(tokens: np.ndarray, order: int, classes: np.ndarray, length: int) -> np.ndarray:
    """The first tokens of a set under an order; those that tie with the last one come along."""
    bits = len(classes).bit_length() - 1
    rank = (classes[(tokens >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mix(tokens ^ _SEEDS[order]) >> np.uint64(6))
    if length >= len(tokens):
        return tokens
    return tokens[rank <= np.partition(rank, length - 1)[length - 1]]


def mark(tokens: np.ndarray, classes: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Parities of all tokens and the prefixes under the orders after the first, as 64-bit words, a row for each size unit."""
    units = 1 << min(DOUBLED, (max(0, len(tokens) - 1) // MARK_TOKENS).bit_length())
    bits = 64 * PARITY_WORDS * units
    places = (mix(tokens ^ _SEEDS[ORDERS]) & np.uint64(bits - 1)).astype(np.int64)
    parts = [np.bincount(places, minlength=bits) & 1]
    length = prefix_length(len(tokens), threshold)
    for order in range(1, ORDERS):
        held = np.zeros(64 * PREFIX_WORDS * units, np.int64)
        held[(prefix(tokens, order, classes, length) & np.uint64(len(held) - 1)).astype(np.int64)] = 1
        parts.append(held)
    return np.concatenate([np.packbits(p != 0, bitorder="little").view("<u8").reshape(units, -1) for p in parts], axis=1)


class Marks:
    """The marks of many sets."""

    def __init__(self, column: pa.Array):
        self.raw = column.to_pylist()
        self.units = np.array([len(m) for m in self.raw], np.int64) // (8 * (PARITY_WORDS + (ORDERS - 1) * PREFIX_WORDS))
        self._folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, rows: np.ndarray, units: int) -> np.ndarray:
        """The marks of these rows, of this size at least, folded to it."""
        if units not in self._folded:
            large = np.flatnonzero(self.units >= units)
            place = np.zeros(len(self.raw), np.int64)
            place[large] = np.arange(len(large))
            out = np.empty((len(large), units, PARITY_WORDS + (ORDERS - 1) * PREFIX_WORDS), "<u8")
            for size in np.unique(self.units[large]).tolist():
                at = large[self.units[large] == size]
                full = np.frombuffer(b"".join([self.raw[i] for i in at.tolist()]), "<u8").reshape(len(at), size // units, units, -1)
                out[place[at], :, :PARITY_WORDS] = np.bitwise_xor.reduce(full[..., :PARITY_WORDS], axis=1)
                out[place[at], :, PARITY_WORDS:] = np.bitwise_or.reduce(full[..., PARITY_WORDS:], axis=1)
            self._folded[units] = place, out
        place, out = self._folded[units]
        return out[place[rows]]


def allowed(
    marks_a: Marks, at_a: np.ndarray, na: np.ndarray, marks_b: Marks, at_b: np.ndarray, nb: np.ndarray, threshold: tuple[int, int]
) -> np.ndarray:
    """For rows ``at_a`` and ``at_b``: what lengths, prefixes under the further orders and parities do not rule out."""
    part, whole = threshold
    ok = whole * np.minimum(na, nb) >= part * np.maximum(na, nb)
    size = np.minimum(marks_a.units[at_a], marks_b.units[at_b])
    for units in np.unique(size[ok]).tolist():
        here = np.flatnonzero(ok & (size == units))
        a, b = marks_a.folded(at_a[here], units), marks_b.folded(at_b[here], units)
        both = (a[..., PARITY_WORDS:] & b[..., PARITY_WORDS:]) != 0
        shared = both.reshape(len(here), units, ORDERS - 1, PREFIX_WORDS).any(axis=(1, 3)).all(axis=1)
        differ = np.bitwise_count(a[..., :PARITY_WORDS] ^ b[..., :PARITY_WORDS]).sum(axis=(1, 2), dtype=np.int64)
        ok[here] = shared & (differ * (whole + part) <= ((na + nb) * (whole - part))[here])
    return ok


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def signed_sets(docs: DataFrame, classes: np.ndarray, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, text_hash, n, print (128-bit hash of the set), mark, band, tokens (prefix under the first order); null where there is no set."""
    table = docs.sparkSession.sparkContext.broadcast(classes)
    # A little wider than the threshold asks for, so that rounding never puts two bands between sets that may link.
    ratio = math.log(threshold[1] / threshold[0]) * (1 + 1e-9) if threshold[0] < threshold[1] else 1e-9

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            rows: list[tuple] = []
            for s in shingle_sets(data, offsets, shingle):
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                tokens = prefix(s, 0, table.value, prefix_length(len(s), threshold))
                rows.append(
                    (
                        len(s),
                        hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                        mark(s, table.value, threshold).tobytes(),
                        int(math.log(len(s)) / ratio),
                        tokens.view(np.int64),
                    )
                )
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
                names=["doc_id", "text_hash", "n", "print", "mark", "band", "tokens"],
            )

    return _hashed(docs).mapInArrow(scan, "doc_id long, text_hash long, n long, print binary, mark binary, band long, tokens array<long>")


def _cells(reps: DataFrame) -> DataFrame:
    """(key, rep, home): the cells a set enters by its prefix under the first order; not at home in the next band's."""
    cell = lambda shift, home: F.struct(F.xxhash64("token", F.col("band") + shift).alias("key"), F.lit(home).alias("home"))
    return reps.select("rep", "band", F.explode("tokens").alias("token")).select("rep", F.explode(F.array(cell(0, True), cell(1, False))).alias("c")).select("c.key", "rep", "c.home")


def _texts(docs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, text) of the members (rep); the bit map reaches the driver, in rows of 4,096 bytes."""
    hashed = reps.join(members.distinct(), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "text_hash")
    slot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << FETCH_BITS)) + 1
    maps = hashed.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toArrow()
    bits = np.zeros((1 << FETCH_BITS) // 32768, "V4096")
    for at, held in zip(maps.column("at").to_pylist(), maps.column("bits").to_pylist()):
        bits[at - 1] = np.void(held)
    table = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    @F.pandas_udf("boolean")
    def wanted(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy() - 1
        return pd.Series(table.value[at >> 3] >> (at & 7) & 1 == 1)

    near = _hashed(docs).where("doc_id is not null").where(wanted(slot))
    return near.join(hashed, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).drop("text_hash")


def _candidates(pairs: DataFrame, reps: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that lengths and marks allow."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            at = np.arange(batch.num_rows)
            keep = allowed(Marks(batch.column("ma")), at, na, Marks(batch.column("mb")), at, nb, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    part, whole = threshold
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("mark").alias(f"m{x}"))
    sizes = F.lit(whole) * F.least("na", "nb") >= F.lit(part) * F.greatest("na", "nb")
    near = pairs.join(side("a").select("a", "na"), "a").join(side("b"), "b").where(sizes)
    return near.join(side("a").select("a", "ma"), "a").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(scan, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    A set a streams past its partners, in slices of about ``SLICE`` of them; a task holds one set
    and the batch being read.
    """
    part, whole = threshold
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    partners = pairs.join(slices, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("turn"), F.col("b").alias("doc_id"))
    heads = slices.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("turn"), F.col("a").alias("doc_id"))
    ordered = partners.unionByName(heads).join(texts, "doc_id").repartition("a", "slice").sortWithinPartitions("a", "slice", "turn")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for rows, data, offsets in pieces(batches):
            found_a, found_b = [], []
            for a, turn, b, s in zip(*(rows.column(c).to_pylist() for c in ("a", "turn", "doc_id")), shingle_sets(data, offsets, shingle)):
                if not turn:
                    head = s
                elif whole * (both := len(np.intersect1d(head, s, assume_unique=True))) >= part * (len(head) + len(s) - both):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return ordered.select("a", "turn", "doc_id", "text").mapInArrow(scan, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows that agree in ``names``, from batches sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        keys = [table.column(c).to_numpy() for c in names]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
            yield table.slice(a, b - a)
        rest = table.slice(int(cuts[-1]) if len(cuts) else 0).to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


class _Block:
    """A pair of blocks of a cell, or one block with itself."""

    def __init__(self, table: pa.Table, threshold: tuple[int, int]):
        self.threshold = threshold
        self.n, self.home = (table.column(c).to_numpy() for c in ("n", "home"))
        self.component = table.column("component").to_numpy().copy()
        self.marks = Marks(table.column("mark"))
        second = table.column("block").to_numpy() != table.column("i").to_numpy()
        self.left = np.flatnonzero(~second)
        self.right = np.flatnonzero(second)
        self.one = table.column("i")[0].as_py() == table.column("j")[0].as_py()

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, rows) that may link across components, by the components as they are then."""
        for at, x in enumerate(self.left.tolist()):
            others = self.left[at + 1 :] if self.one else self.right
            others = others[(self.component[others] != self.component[x]) & (self.home[others] | self.home[x])]
            if len(others):
                same = np.full(len(others), x)
                others = others[allowed(self.marks, others, self.n[others], self.marks, same, self.n[same], self.threshold)]
                if len(others):
                    yield x, others


_AT = ("key", "i", "j")


def _across(cells: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): links that join the components of members (key, rep, home, component) of one cell."""
    part, whole = threshold
    rows = cells.join(reps.select("rep", "n", "mark"), "rep")
    weight = F.ceil(F.sum(F.col("n") + SET_COST) / BLOCK_TOKENS).cast("int")
    blocks = rows.groupBy("key").agg(weight.alias("blocks"))
    placed = (
        rows.join(blocks, "key")
        .withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "home", "component", "n", "mark")
    )

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, _AT):
            if group.num_rows > 1:
                kept = np.zeros(group.num_rows, bool)
                for x, others in _Block(group, threshold).candidates():
                    kept[x] = True
                    kept[others] = True
                if kept.any():
                    yield from group.filter(pa.array(kept)).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, _AT):
            block = _Block(group, threshold)
            rep, component = group.column("rep").to_numpy(), block.component
            sets = [s for _, data, offsets in pieces(group.to_batches()) for s in shingle_sets(data, offsets, shingle)]
            found_a, found_b = [], []
            for x, others in block.candidates():
                for o in others.tolist():
                    if component[o] == component[x]:
                        continue
                    both = len(np.intersect1d(sets[x], sets[o], assume_unique=True))
                    if whole * both >= part * (len(sets[x]) + len(sets[o]) - both):
                        found_a.append(int(rep[x]))
                        found_b.append(int(rep[o]))
                        component[component == component[o]] = component[x]
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    shape = "key long, i int, j int, block int, rep long, home boolean, component long, n long, mark binary"
    left = stored(placed.repartition(*_AT).sortWithinPartitions(*_AT).mapInArrow(screen, shape), "screened")
    texts = _texts(docs, reps, left.select("rep"))
    fetched = left.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    ordered = fetched.repartition(*_AT).sortWithinPartitions(*_AT)
    return ordered.mapInArrow(verify, "a long, b long")


def _labelled(links: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, component) of all sets under these links."""
    found = components(links)
    return stored(
        reps.select("rep").join(found, reps["rep"] == found["node"], "left").select("rep", F.coalesce("component", "rep").alias("component")), "labels"
    )


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, n_shingles, representative (smallest doc_id of equal sets), component_id, kept."""
    classes = slot_classes(docs, shingle)
    signed = stored(signed_sets(docs, classes, shingle, threshold), "sets")
    first = F.min(F.struct(F.coalesce("print", F.lit(b"").cast("binary")).alias("print"), "text_hash", "n"))
    named = signed.where("doc_id is not null").groupBy("doc_id").agg(first.alias("s")).select("doc_id", "s.*").where("n > 0")
    stands = named.groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select(F.col("s.doc_id").alias("rep"), F.col("s.text_hash").alias("rep_hash"))
    reps = stored(
        signed.join(stands, (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
        .dropDuplicates(["doc_id", "text_hash"])
        .select("rep", "text_hash", "n", "print", "mark", "band", "tokens"),
        "representatives",
    )
    cells = _cells(reps)
    # A cell is of use if a set at home meets another one.
    shared = cells.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min(F.when(F.col("home"), F.col("rep"))).alias("head")).where("sets > 1 and head is not null").drop("sets")
    open_ = stored(cells.join(shared, "key"), "cells")

    def verified(pairs: DataFrame) -> DataFrame:
        near = stored(_candidates(pairs, reps, threshold), "candidates")
        texts = _texts(docs, reps, near.select(F.explode(F.array("a", "b")).alias("rep")))
        return _verified(near, texts, shingle, threshold)

    pairs = open_.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    links = stored(verified(pairs), "links")
    for star in range(1, STARS + 1):
        labels = _labelled(links, reps)
        # The head has met every member of its cell.
        placed = open_.where("rep <> head").select("key", "rep", "home").join(labels, "rep")
        least = F.min_by("rep", F.when(F.col("home"), F.xxhash64("rep", F.lit(star))))
        mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), least.alias("head")).where("least <> most and head is not null").select("key", "head")
        open_ = stored(placed.join(mixed, "key"), "cells")
        if star == STARS:
            break
        apart = open_.join(labels.select(F.col("rep").alias("head"), F.col("component").alias("c")), "head").where("component <> c")
        pairs = apart.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
        links = stored(links.unionByName(verified(pairs)), "links")
    links = stored(links.unionByName(_across(open_.select("key", "rep", "home", "component"), reps, docs, shingle, threshold)), "links")
    labels = _labelled(links, reps)

    classes_of = named.select(F.col("doc_id").alias("id"), "print").join(reps.select("print", "rep"), "print").join(labels, "rep")
    return (
        signed.select("doc_id", "n")
        .join(classes_of.select("id", F.col("rep").alias("representative"), "component"), F.col("doc_id") == F.col("id"), "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("representative", "doc_id").alias("representative"),
            F.coalesce("component", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
