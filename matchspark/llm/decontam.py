"""Benchmark decontamination with suffix arrays over the training words.

Each piece of the training text is a shard: its words become ranks, and its word
suffixes are sorted by their first ten words (a suffix array of bounded depth; a
separator of rank 0 ends each document).  Every benchmark suffix of ``WINDOW`` words, and
every item of fewer words, is binary-searched in every shard; the interval found gives
all its places.  Windows on one diagonal are joined to maximal verbatim matches.

The benchmark is the stated query set.  It is sent to the tasks in blocks of at most
``block_chars`` characters, so a broadcast has a fixed bound whatever the benchmark's size.

Null or empty text has no words and no hits.  A null or wordless item occurs nowhere.
Repeated documents are judged row by row; an item id on several rows stands for any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import WORD, pieces, word_hashes

WINDOW = 10
BLOCK_CHARS = 8_000_000
SCHEMA = (
    "key binary, n_words long, matches array<struct<item_id:string,item_word:long,word:long,n_words:long>>"
)


def benchmark_windows(rows: list[tuple[str, str]], window: int = WINDOW) -> dict:
    """Distinct windows of the items, by length, and the items and places of each."""
    texts = [(str(i), t) for i, t in rows if i is not None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in texts], pa.string())})
    seen: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    ids: list[str] = []
    for part, data, offsets in pieces([batch]):
        words, bounds = word_hashes(data, offsets, WORD)
        listed = words.tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = min(window, b - a)
            if n:
                for p in range(a, b - n + 1):
                    seen.setdefault(tuple(listed[p : p + n]), []).append((len(ids), p - a))
            ids.append(texts[len(ids)][0])
    keys = list(seen)
    return {
        "ids": ids,
        "lengths": np.array([len(k) for k in keys], np.int64),
        "words": np.array([k + (0,) * (window - len(k)) for k in keys], np.uint64).reshape(-1, window),
        "places": [seen[k] for k in keys],
    }


class Shard:
    """The suffix array of a piece of text: ranks of its words and the order of its suffixes."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, window: int = WINDOW):
        self.window = window
        self.vocabulary, ranks = np.unique(words, return_inverse=True)
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.pack = 62 // self.bits
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.starts = bounds[:-1] + np.arange(len(bounds) - 1)
        total = len(words) + len(bounds) - 1
        seq = np.zeros(total + window + self.pack, np.int64)
        self.place = np.arange(len(words)) + self.doc
        seq[self.place] = ranks + 1
        self.seq = seq
        steps = range(0, window, self.pack)
        self.keys = [self.packed(seq, k, total, min(self.pack, window - k)) for k in steps]
        self.order = self.sorted_places()

    def packed(self, seq: np.ndarray, at: int, n: int, count: int) -> np.ndarray:
        """Ranks of ``count`` words from each place on, in one integer."""
        out = np.zeros(n, np.int64)
        for k in range(count):
            out = (out << self.bits) | seq[at + k : at + k + n]
        return out

    def sorted_places(self) -> np.ndarray:
        """Places of words by the words that follow; only suffixes still tied are sorted further."""
        order = self.place[np.argsort(self.keys[0][self.place], kind="stable")]
        if len(order) < 2 or len(self.keys) == 1:
            return order
        first = self.keys[0][order]
        same = first[1:] == first[:-1]
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        group = np.cumsum(np.concatenate([[True], ~same]))[tied]
        at = order[tied]
        order[tied] = at[np.lexsort([*(k[at] for k in reversed(self.keys[1:])), group])]
        return order

    def intervals(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which windows can occur, start, end) of their intervals in the suffix array."""
        if not len(self.vocabulary) or not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        used = np.arange(self.window) < lengths[:, None]
        which = np.flatnonzero(((self.vocabulary[at] == words) | ~used).all(axis=1))
        ranks, used = at[which] + 1, used[which]
        top = (1 << self.bits) - 1
        low = self.search(np.where(used, ranks, 0), strict=False)
        return which, low, self.search(np.where(used, ranks, top), strict=True)

    def search(self, ranks: np.ndarray, strict: bool) -> np.ndarray:
        """Binary search for all windows at once: suffixes below (strict: not above) each."""
        wanted = []
        for k in range(0, self.window, self.pack):
            out = np.zeros(len(ranks), np.int64)
            for c in range(k, min(k + self.pack, self.window)):
                out = (out << self.bits) | ranks[:, c]
            wanted.append(out)
        low, high = np.zeros(len(ranks), np.int64), np.full(len(ranks), len(self.order), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = self.order[np.minimum(middle, len(self.order) - 1)]
            less, equal = np.zeros(len(ranks), bool), np.ones(len(ranks), bool)
            for key, want in zip(self.keys, wanted):
                value = key[at]
                less |= equal & (value < want)
                equal &= value == want
            right = open_ & ((less | equal) if strict else less)
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low


def shard_matches(words: np.ndarray, bounds: np.ndarray, tests: dict, window: int = WINDOW) -> dict[int, list[dict]]:
    """Maximal verbatim matches by document of the shard."""
    shard = Shard(words, bounds, window)
    which, low, high = shard.intervals(tests["words"], tests["lengths"])
    found: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for w, a, b in zip(which.tolist(), low.tolist(), high.tolist()):
        if a >= b:
            continue
        n = int(tests["lengths"][w])
        places = shard.order[a:b]
        docs = np.searchsorted(shard.starts, places, "right") - 1
        for doc, at in zip(docs.tolist(), (places - shard.starts[docs]).tolist()):
            for item, item_word in tests["places"][w]:
                found.setdefault((doc, item, at - item_word), []).append((at, n))
    out: dict[int, list[dict]] = {}
    for (doc, item, shift), runs in found.items():
        runs.sort()
        start, end = runs[0][0], runs[0][0] + runs[0][1]
        spans = []
        for at, n in runs[1:]:
            if at > end - window + 1:
                spans.append((start, end))
                start = at
            end = at + n
        for a, b in [*spans, (start, end)]:
            out.setdefault(doc, []).append(
                {"item_id": tests["ids"][item], "item_word": a - shift, "word": a, "n_words": b - a}
            )
    return out


def _blocks(benchmark: DataFrame, item: str, item_text: str, window: int, block_chars: int) -> list[Broadcast]:
    """The windows of the items, a broadcast for each block of about ``block_chars`` characters."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    out = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        out.append(spark.sparkContext.broadcast(benchmark_windows([(r["item_id"], r["text"]) for r in block.toLocalIterator()], window)))
    return out


def verbatim_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document row: its key, n_words and all maximal matches with items (place and length each)."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    parts = []
    every = _blocks(benchmark, item, item_text, window, block_chars)
    blocks = len(every)
    for tests in every:

        def scan(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            kind_of = pa.list_(
                pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())])
            )
            for part, data, offsets in pieces(batches):
                words, bounds = word_hashes(data, offsets, WORD)
                found = shard_matches(words, bounds, tests.value, window)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        *([part.column("print")] if "print" in part.schema.names else []),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([found.get(k, []) for k in range(part.num_rows)], kind_of),
                    ],
                    names=["key", *(["print"] if "print" in part.schema.names else []), "n_words", "matches"],
                )

        extra = "print long, " if blocks > 1 else ""
        source = rows.withColumn("print", F.xxhash64("text")) if blocks > 1 else rows
        parts.append(source.mapInArrow(scan, SCHEMA.replace("key binary, ", f"key {kind}, {extra}")))
    if blocks == 1:
        return parts[0].withColumnRenamed("key", key)
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    # Equal rows (same key and text) have equal matches: one is kept and repeated as often as it stood.
    return (
        together.groupBy("key", "print", "n_words")
        .agg(F.flatten(F.collect_set("matches")).alias("matches"), (F.count(F.lit(1)) / blocks).cast("int").alias("copies"))
        .withColumn("copies", F.explode(F.expr("array_repeat(0, copies)")))
        .select(F.col("key").alias(key), "n_words", F.array_distinct("matches").alias("matches"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per document row: n_words, n_hit, item_ids (sorted strings), longest match and its item, contaminated."""
    found = verbatim_matches(docs, benchmark, key=key, **options)
    # Matches by place: each adds the words beyond the furthest end so far.
    hit = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m["word"].alias("a"), (m["word"] + m["n_words"]).alias("b")))),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda s, m: F.struct(
            F.greatest(s["end"], m["b"]).alias("end"),
            (s["hit"] + F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(s["end"], m["a"]))).alias("hit"),
        ),
        lambda s: s["hit"],
    )
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long")).alias("longest"),
        "matches",
        (F.size("matches") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents without any match, with all their columns; every row is judged by its own text.

    Rows pass one filter for each block of the benchmark, without a shuffle.
    """
    clean = docs.withColumn("__text", F.col(text).cast("string"))
    for tests in _blocks(benchmark, item, item_text, window, block_chars):

        def scan(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in pieces(batches, "__text"):
                words, bounds = word_hashes(data, offsets, WORD)
                hit = np.zeros(part.num_rows, bool)
                hit[list(shard_matches(words, bounds, tests.value, window))] = True
                yield part.filter(pa.array(~hit))

        clean = clean.mapInArrow(scan, clean.schema)
    return clean.drop("__text")
