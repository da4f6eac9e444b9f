"""A probabilistic suffix tree over the bytes of texts, and word counts beside it.

A text is its lower-cased words joined by one space and closed by one end symbol; symbols
are bytes.  The tree is learnt from all training texts:

* Every context of up to ``DEPTH`` symbols with the symbol that follows is counted.
* A context is retained if it was seen ``MIN_COUNT`` times and its next-symbol distribution diverges
  from that of the context without its first symbol: the sum of n * ln(p / p_parent) over next
  symbols is at least ``MIN_GAIN``.  Neither bound rises with the input, so the tree grows with it.
* Distributions are smoothed towards the parent's by interpolation with as much weight as the context
  has distinct next symbols, and at the root with equal shares of all 256 symbols and the end.

Neither the tree nor the words have a bounded number, so neither is sent around whole.  Documents are
dealt into blocks by size; each block asks for its distinct words and grams (a context of ``DEPTH``
symbols with its next symbol) and gets totals of words and probabilities of grams back.  Grams are
asked for in packed rows, one per block and bucket; a bucket holds all grams whose last
``LOW`` + 1 context symbols agree, hence the whole subtree above them.  Only the statistics of
contexts of up to ``LOW`` symbols, at most 256 ** (LOW + 1) by the alphabet, are known to all buckets.

``suffix_tree`` and ``Automaton`` are the same model as a table and in one process, where it fits there.

Null or empty text is the end symbol alone.  A text repeated in training counts each time.
Without training text the distribution is uniform and every word is unknown.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.text import LOWER, SOLID, mix, pieces, word_hashes, word_spans
from matchspark.llm.workdir import scratch, stored

#: At most 7: a gram is one 64-bit number.
DEPTH = 6
MIN_COUNT = 2
MIN_GAIN = 10.0
LOW = 2
#: Words cannot hold a tab, so it stands for the end; a line feed stands for what precedes a text.
SPACE, END, BEFORE = 32, 9, 10
SYMBOLS = 256
BLOCK_BYTES = 16 << 20
SEGMENT = 1024
#: Codes that are merged or dealt into buckets at a time, and bytes of text that are read at a time.
RUN, READ = 1 << 20, 1 << 20


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, n+1 offsets): words, single spaces between, and the end symbol."""
    data = LOWER[data]
    starts, ends, bounds, inside = word_spans(data, offsets, SOLID)
    # Every word is followed by one symbol; a text without words is the end symbol alone.
    lengths = ends - starts
    words = np.diff(bounds)
    size = np.add.reduceat(np.append(lengths + 1, 0), np.minimum(bounds[:-1], len(lengths))) if len(words) else np.empty(0, np.int64)
    size = np.where(words > 0, size, 1)
    out_offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.full(out_offsets[-1], SPACE, np.uint8)
    if len(starts):
        text_of = np.repeat(np.arange(len(words)), words)
        before = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        empty_before = np.cumsum(words == 0)
        at = before + empty_before[text_of]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        out[np.repeat(at, lengths) + place] = data[inside]
    out[out_offsets[1:] - 1] = END
    return out, out_offsets


def _low(size: int) -> np.uint64:
    """A mask of the lowest ``size`` bytes."""
    return np.uint64((1 << 8 * size) - 1)


def _grams(seq: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For each symbol the code of the ``depth`` symbols before it, then itself: depth + 1 bytes."""
    padded = np.concatenate([np.full(7, BEFORE, np.uint8), seq])
    code = np.ndarray(len(seq), ">u8", padded.data, strides=(1,)).astype(np.uint64) & _low(depth + 1)
    nothing = np.uint64(int.from_bytes(bytes([BEFORE]) * 8, "big")) & _low(depth + 1)
    sizes = np.diff(offsets)
    for k in range(depth):
        at = offsets[:-1][sizes > k] + k
        code[at] = (code[at] & _low(k + 1)) | (nothing & ~_low(k + 1))
    return code


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sums of their counts, from runs of sorted codes.

    Runs are merged a range of about ``RUN`` codes at a time, so that little is held beside them.
    """
    ranges = -(-sum(len(c) for c, _ in held) // RUN)
    sample = np.sort(np.concatenate([c[min(512, len(c) // 2) :: 1024] for c, _ in held]))
    borders = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]) if ranges > 1 else sample[:0]
    cuts = [np.concatenate([[0], np.searchsorted(c, borders), [len(c)]]) for c, _ in held]
    out = [(np.empty(0, held[0][0].dtype), np.empty(0, np.int64))]
    for k in range(len(borders) + 1):
        codes = np.concatenate([c[at[k] : at[k + 1]] for at, (c, _) in zip(cuts, held)])
        if not len(codes):
            continue
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], np.concatenate([n[at[k] : at[k + 1]] for at, (_, n) in zip(cuts, held)])[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        out.append((codes[first], np.add.reduceat(n, first)))
    return np.concatenate([c for c, _ in out]), np.concatenate([n for _, n in out])


def gram_counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, n): every context of ``depth`` symbols with its next symbol, over all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held):
            codes, n = _merged(held)
            return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], names=["code", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, data, offsets in pieces(batches, limit=2 << 20):
            seq, at = symbols(data, offsets)
            if len(seq):
                held.append(np.unique(_grams(seq, at, depth), return_counts=True))
            if len(held) >= 8:
                held = [_merged(held)]
                if len(held[0][0]) > 3_000_000:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    counted = texts.mapInArrow(scan, "code long, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def suffix_tree(
    grams: DataFrame, depth: int = DEPTH, min_share: float = 0.0, min_gain: float = MIN_GAIN, keep: Callable[[DataFrame, str], DataFrame] = stored
) -> DataFrame:
    """(depth, context, symbol, n): counts of next symbols of the retained contexts, and of the root (depth 0).

    ``context`` holds the context's symbols as one integer, the latest in the lowest byte.
    ``keep`` writes the counts.
    """
    # Every gram counts for the contexts of all lengths; equal ones are summed before the shuffle.
    d = F.col("depth")
    mask = F.element_at(F.array(*[F.lit((1 << 8 * k) - 1).cast("long") for k in range(depth + 1)]), d + 1)
    counted = (
        grams.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "code", "n")
        .select("depth", F.shiftrightunsigned("code", 8).bitwiseAND(mask).alias("context"), F.col("code").bitwiseAND(255).alias("symbol"), "n")
        .groupBy("depth", "context", "symbol")
        .agg(F.sum("n").alias("n"))
        .withColumn("all", F.sum("n").over(Window.partitionBy("depth", "context")))
    )
    counted = keep(counted, "grams")
    least = max(1.0, min_share * (counted.where("depth = 0").agg(F.sum("n")).first()[0] or 0))
    rows = counted.where(F.col("all") >= least)
    share = rows.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("up"), "symbol", (F.col("n") / F.col("all")).alias("p_share"))
    below = F.element_at(F.array(*[F.lit((1 << 8 * max(0, k - 1)) - 1).cast("long") for k in range(depth + 1)]), d + 1)
    tested = rows.where("depth > 0").withColumn("up", F.col("context").bitwiseAND(below)).join(share, ["depth", "up", "symbol"])
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("all")) / F.col("p_share")))
    chosen = tested.groupBy("depth", "context").agg(gain.alias("gain")).where(F.col("gain") >= min_gain).select("depth", "context")
    kept = rows.where("depth > 0").join(chosen, ["depth", "context"], "left_semi").unionByName(counted.where("depth = 0"))
    return kept.select("depth", "context", "symbol", "n")


class Automaton:
    """States are the prefixes of retained contexts; each reads a symbol and knows its log10 probability."""

    def __init__(self, depths: np.ndarray, contexts: np.ndarray, following: np.ndarray, times: np.ndarray):
        order = np.lexsort((contexts, depths))
        depths, contexts, following, times = (np.asarray(x, np.int64)[order] for x in (depths, contexts, following, times))
        cuts = np.flatnonzero(np.append(True, (np.diff(depths) != 0) | (np.diff(contexts) != 0))) if len(depths) else np.empty(0, np.int64)
        # Where the next symbols of each context begin and end.
        at = {int(contexts[i]).to_bytes(8, "big")[8 - int(depths[i]) :] if depths[i] else b"": (i, j) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(depths)])}
        at.setdefault(b"", (0, 0))
        used = sorted(set(np.unique(following).tolist()) | set(b"".join(at)) | {SPACE, END, BEFORE})
        # Symbols that training never saw share one column.
        self.column = np.full(SYMBOLS, len(used), np.int64)
        self.column[used] = np.arange(len(used))
        width = len(used) + 1
        states = sorted({k[:i] for k in at for i in range(len(k) + 1)}, key=lambda k: (len(k), k))
        number = {k: i for i, k in enumerate(states)}
        self.next = np.zeros((len(states), width), np.int32)
        self.log10 = np.empty((len(states), width), np.float32)  # shares until the end
        children: list[list[tuple[int, int]]] = [[] for _ in states]
        for i, k in enumerate(states[1:], 1):
            children[number[k[:-1]]].append((int(self.column[k[-1]]), i))
        for i, k in enumerate(states):
            if k:  # symbols that no longer state reads go on as from the longest suffix that is a state
                self.next[i] = self.next[number[next(k[j:] for j in range(1, len(k) + 1) if k[j:] in number)]]
            for symbol, child in children[i]:
                self.next[i, symbol] = child
            if k in at:
                a, b = at[k]
                up = next((self.log10[number[k[j:]]] for j in range(1, len(k) + 1) if k[j:] in at), np.full(width, 1 / SYMBOLS, np.float32))
                own = np.zeros(width)
                own[self.column[following[a:b]]] = times[a:b]
                kinds = max(1, b - a)
                self.log10[i] = (own + kinds * up) / (own.sum() + kinds)
            else:
                self.log10[i] = self.log10[number[next(k[j:] for j in range(1, len(k) + 1) if k[j:] in at)]]
        np.log10(self.log10, out=self.log10)
        self.depth = max(len(k) for k in at)

    def scores(self, seq: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text, read in segments side by side."""
        sizes = np.diff(offsets)
        pieces_of = (sizes + SEGMENT - 1) // SEGMENT
        text = np.repeat(np.arange(len(sizes)), pieces_of)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
        start = offsets[:-1][text] + nth * SEGMENT
        end = np.minimum(start + SEGMENT, offsets[1:][text])
        columns = np.concatenate([self.column[seq], [0]])
        before = self.column[BEFORE]
        state = np.zeros(len(text), np.int64)
        for back in range(self.depth, 0, -1):
            at = start - back
            state = self.next[state, np.where(at >= offsets[:-1][text], columns[np.maximum(at, 0)], before)]
        order = np.argsort(start - end, kind="stable")  # longest first
        at, state, length = start[order], state[order], (end - start)[order]
        total = np.zeros(len(order))
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step, "left"))
            c = columns[at[:n] + step]
            total[:n] += self.log10[state[:n], c]
            state[:n] = self.next[state[:n], c]
        out = np.zeros(len(sizes))
        np.add.at(out, text[order], total)
        return out


def probabilities(
    codes: np.ndarray, n: np.ndarray, depths: range, p: np.ndarray, share: np.ndarray, min_count: float, min_gain: float
) -> tuple[np.ndarray, np.ndarray]:
    """(probability, share of the context's count) of each distinct gram's symbol after contexts of the last of ``depths``.

    ``n`` counts the grams in training; ``p`` and ``share`` are those one symbol before the first of ``depths``.
    """
    for d in depths:
        keys, first, of_code = np.unique(codes & _low(d + 1), return_index=True, return_inverse=True)
        _, of_key = np.unique(keys >> np.uint64(8), return_inverse=True)
        times = np.bincount(of_code, n, minlength=len(keys))
        total = np.bincount(of_key, times)[of_key]
        kinds = np.bincount(of_key, times > 0)[of_key]
        own, up = times / np.maximum(total, 1), p[first]
        if d:
            seen = times > 0
            gain = np.zeros(len(keys))
            gain[seen] = times[seen] * np.log(own[seen] / share[first][seen])
            kept = (total >= max(1, min_count)) & (np.bincount(of_key, gain)[of_key] >= min_gain)
        else:
            kept, kinds = np.ones(len(keys), bool), np.maximum(kinds, 1)
        p = np.where(kept, (times + kinds * up) / np.maximum(total + kinds, 1), up)[of_code]
        share = own[of_code]
    return p, share


def packed(values: np.ndarray) -> bytes:
    """The bytes of the values, first bytes first, compressed."""
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _steps(codes: np.ndarray) -> np.ndarray:
    return np.diff(codes, prepend=np.uint64(0))


class Places:
    """Where each of some distinct codes stands; only these codes are looked up."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(4, (2 * len(codes)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(codes), dtype=np.int32), self._slots(codes)
        while len(left):
            free = self.table[slot[left]] < 0
            self.table[slot[left[free]]] = left[free]
            left = left[self.table[slot[left]] != left]
            slot[left] = (slot[left] + 1) % len(self.table)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slots(codes)
        out = self.table[slot]
        left = np.flatnonzero(self.codes[out] != codes)
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.table)
            out[left] = self.table[slot[left]]
            left = left[self.codes[out[left]] != codes[left]]
        return out


def _blocked(docs: DataFrame, key: str, text: str, training: Column, block_bytes: int) -> tuple[DataFrame, int]:
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int")), blocks


def block_terms(blocked: DataFrame, blocks: int, depth: int = DEPTH) -> DataFrame:
    """(block, word, n, bucket, codes, times): what each block asks for, with counts in its training texts.

    A row is a distinct word, hashed, or the packed distinct grams of a bucket; there are as many
    buckets as ``blocks``, and bucket -1 has the grams of ``LOW`` + 1 symbols.
    """
    schema = pa.schema([("block", pa.int32()), ("word", pa.int64()), ("n", pa.int64()), ("bucket", pa.int32()), ("codes", pa.binary()), ("times", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        grams_of: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(held, block, codes, training):
            mine = held.setdefault(block, [])
            mine.append(np.unique(codes[training], return_counts=True))
            other = np.unique(codes[~training])
            mine.append((other, np.zeros(len(other), np.int64)))
            if sum(len(c) for c, _ in mine[1:]) > max(RUN, len(mine[0][0])):
                held[block] = [_merged(mine)]

        for part, data, offsets in pieces(batches, limit=READ):
            words, bounds = word_hashes(data, offsets, SOLID)
            seq, at = symbols(data, offsets)
            codes = _grams(seq, at, depth)
            training = part.column("training").to_numpy(zero_copy_only=False)
            owner = part.column("block").to_numpy(zero_copy_only=False)
            for block in np.unique(owner).tolist():
                mine = owner == block
                for held, terms, counts in ((words_of, words, np.diff(bounds)), (grams_of, codes, np.diff(at))):
                    here = np.repeat(mine, counts)
                    add(held, block, terms[here], np.repeat(training, counts)[here])
        for block in list(grams_of):
            words, n = _merged(words_of.pop(block))
            nothing = pa.nulls(len(words))
            columns = [np.full(len(words), block, np.int32), words.view(np.int64), n, *[nothing] * 3]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c is nothing else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            codes, n = _merged(grams_of.pop(block))
            short, bucket = [], np.empty(len(codes), np.int32)
            for at in range(0, len(codes), RUN):
                some = codes[at : at + RUN]
                endings, of_code = np.unique(some & _low(LOW + 1), return_inverse=True)
                short.append((endings, np.bincount(of_code, n[at : at + RUN]).astype(np.int64)))
                bucket[at : at + RUN] = mix((some >> np.uint64(8)) & _low(LOW + 1)) % np.uint64(blocks)
            rows = [(-1, *_merged(short))]
            order = np.argsort(bucket, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=blocks))])
            rows += [(k, codes[order[a:b]], n[order[a:b]]) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if a < b]
            columns = [[block] * len(rows), [None] * len(rows), [None] * len(rows), [r[0] for r in rows], [packed(_steps(r[1])) for r in rows], [packed(r[2]) for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    # A block is a task of its own: dealt out by hash, several would meet in one.
    return blocked.repartitionById(blocks, "block").mapInArrow(scan, "block int, word long, n long, bucket int, codes binary, times binary")


def gram_answers(asked: DataFrame, buckets: int, depth: int = DEPTH, min_count: float = MIN_COUNT, min_gain: float = MIN_GAIN) -> DataFrame:
    """(block, codes, logs): the grams that each block asked for, with log10 of their symbols' probabilities."""
    low = min(LOW, depth)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, times in zip(*(batch.column(c).to_pylist() for c in ("codes", "times"))):
                codes = np.cumsum(unpacked(codes, np.uint64), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(unpacked(times, np.int64))], names=["code", "n"])

    short = asked.where("bucket = -1").select("codes", "times").mapInArrow(spread, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # At most 256 ** (LOW + 1) rows, by the alphabet.
    code, n = (c.to_numpy() for c in short.orderBy("code").toArrow().columns)
    code = code.astype(np.uint64)
    start = np.full(len(code), 1 / SYMBOLS), np.ones(len(code))
    known = asked.sparkSession.sparkContext.broadcast((code, *probabilities(code, n, range(low + 1), *start, min_count, min_gain)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, codes, times = [], [], []
        for batch in batches:
            blocks += batch.column("block").to_pylist()
            codes += [np.cumsum(unpacked(c, np.uint64), dtype=np.uint64) for c in batch.column("codes").to_pylist()]
            times += [unpacked(t, np.int64) for t in batch.column("times").to_pylist()]
        if not blocks:
            return
        distinct, n = _merged(list(zip(codes, times)))
        short, p, share = known.value
        at = np.searchsorted(short, distinct & _low(LOW + 1))
        p, _ = probabilities(distinct, n, range(low + 1, depth + 1), p[at], share[at], min_count, min_gain)
        logs, places = np.log10(p).astype(np.float32), Places(distinct)
        for block, mine in zip(blocks, codes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([packed(_steps(mine))], pa.binary()), pa.array([packed(logs[places.find(mine)])], pa.binary())], names=["block", "codes", "logs"]
            )

    rows = asked.where("bucket >= 0").select("block", "bucket", "codes", "times").repartitionById(buckets, "bucket")
    return rows.mapInArrow(answer, "block int, codes binary, logs binary")


def score_texts(
    docs: DataFrame,
    training: Column,
    key: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    min_count: float = MIN_COUNT,
    min_gain: float = MIN_GAIN,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document row: key, n_tokens, n_known, train_tokens, vocabulary, base_score, score (log10).

    ``training`` marks the rows to learn from.  Tokens are words and one end for each text.
    """
    spark = docs.sparkSession
    learnt = docs.where(training).select(F.col(text).cast("string").alias("text"))
    blocked, buckets = _blocked(docs, key, text, training, block_bytes)
    with scratch(spark) as keep:
        asked = keep(block_terms(blocked, buckets, depth), "asked")
        of_word = Window.partitionBy("word")
        words = asked.where("word is not null").withColumn("c", F.sum("n").over(of_word)).where("c > 0")
        words = words.withColumn("first", F.min("block").over(of_word) == F.col("block"))
        answers = stored(words.select("block", "word", "n", "c", "first"), "answers")
        grams = stored(gram_answers(asked, buckets, depth, min_count, min_gain), "grams")
    vocabulary, words = answers.agg(F.coalesce(F.count_if("first"), F.lit(0)), F.sum("n")).first()
    texts = learnt.count()
    # The end is a token of the vocabulary too, once per training text.
    n_all, v_all = (words or 0) + texts, vocabulary + (texts > 0)
    answers = answers.select("block", "word", "c").unionByName(grams, allowMissingColumns=True)
    kind = docs.schema[key].dataType.simpleString()

    def score(documents: pa.Table, known: pa.Table) -> pa.Table:
        of_grams = known.filter(known.column("codes").is_valid())
        known = known.filter(known.column("word").is_valid())
        codes, logs = (
            np.concatenate([np.empty(0, t), *(f(unpacked(x, t)) for x in of_grams.column(c).to_pylist())])
            for c, t, f in (("codes", np.uint64, lambda x: np.cumsum(x, dtype=np.uint64)), ("logs", np.float32, lambda x: x))
        )
        places = Places(codes)
        words = known.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, counts = words[order], known.column("c").to_numpy()[order]
        log_all = math.log10(n_all + v_all + 1)
        # Sums of logarithms are taken over counts, so that equal words give equal terms.
        out = [[], [], [], []]
        for part, data, offsets in pieces(documents.to_batches(), limit=READ):
            seq, at = symbols(data, offsets)
            out[3].append(np.add.reduceat(logs[places.find(_grams(seq, at, depth))].astype(np.float64), at[:-1]))
            mine, bounds = word_hashes(data, offsets, SOLID)
            c = np.zeros(len(mine), np.int64)
            if len(words) and len(mine):
                spot = np.minimum(np.searchsorted(words, mine), len(words) - 1)
                c = np.where(words[spot] == mine, counts[spot], 0)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
            n = np.diff(bounds) + 1
            out[0].append(n)
            out[1].append(sums(c > 0) + (texts > 0))
            terms = np.log10(c + 1.0)
            cut = bounds[:-1][bounds[:-1] < bounds[1:]]
            base = np.zeros(len(n))
            if len(cut):
                base[np.diff(bounds) > 0] = np.add.reduceat(terms, cut)
            out[2].append(base + math.log10(texts + 1) - n * log_all)
        keys = documents.column("key")
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"key": keys, "n_tokens": join(out[0], pa.int64()), "n_known": join(out[1], pa.int64()), "base_score": join(out[2], pa.float64()), "score": join(out[3], pa.float64())})

    scored = blocked.repartition(buckets, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, f"key {kind}, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("key").alias(key), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), F.lit(v_all).cast("long").alias("vocabulary"), "base_score", "score"
    )
