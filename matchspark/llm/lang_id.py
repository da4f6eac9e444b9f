"""Language identification with error-correcting output codes.

Each learnt language has a codeword; a binary classifier per bit reads hashed byte n-grams (1 to 3
bytes of the lower-cased text, everything but letters as one blank class).  Up to
``EXHAUSTIVE`` languages get the exhaustive code, more get the best of some random codes of
``10 log2 L`` bits.  Decoding is loss-weighted: a bit's logistic loss counts by how often that bit is
right for the language in training, and the codeword of least loss is chosen.  The score is the soft
minimum's share; ``ambiguous`` marks scores whose runner-up is within ``MARGIN``.

Bits are fitted on at most ``SAMPLE`` labelled texts over all languages, an equal number of each (by the
smallest hash of id and text, equal rows once).  Prediction reads every whole text.  A null text or one without letters is
``und`` with score 0; so is every text if no language can be learnt.  With one language
that one is predicted.  Repeated rows are predicted row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.text import LOWER, pieces

BUCKETS = 1 << 13
SAMPLE = 2400
EXHAUSTIVE = 6
MARGIN = 0.2
ROUNDS = 80

_letter = np.zeros(256, bool)
_letter[97:123] = _letter[128:] = True
_blank = np.where(_letter, np.arange(256), 32).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of hashed n-gram weights per text, of length 1."""
    seq = _blank[LOWER[data]].astype(np.uint32)
    out = np.empty((len(offsets) - 1, BUCKETS), np.float32)
    factor, shift = np.uint32(2654435761), np.uint32(32 - 13)
    with np.errstate(over="ignore"):
        one = (seq + np.uint32(1)) * factor >> shift
        two = (seq[:-1] << np.uint32(8) | seq[1:]) + np.uint32(1 << 10)
        three = (two[:-1] << np.uint32(8) | seq[2:]) + np.uint32(1 << 26) if len(seq) > 2 else np.empty(0, np.uint32)
        two, three = two * factor >> shift, three * factor >> shift
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        grams = np.concatenate([one[a:b], two[a : max(a, b - 1)], three[a : max(a, b - 2)]])
        row = np.sqrt(np.bincount(grams, minlength=BUCKETS).astype(np.float32))
        out[i] = row / max(1e-6, float(np.sqrt(row @ row)))
    return out


def codewords(languages: int) -> np.ndarray:
    """A row of +1/-1 bits for each language."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (languages - 1))
        rows = [np.ones(len(bits)), *(np.where(bits >> k & 1, -1.0, 1.0) for k in range(languages - 1))]
        return np.array(rows)
    rng = np.random.default_rng(7)
    best, least = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, math.ceil(10 * math.log2(languages))))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        apart = (code[:, None, :] != code[None]).sum(axis=2)[~np.eye(languages, dtype=bool)].min()
        if apart > least:
            best, least = code, apart
    return best


class Model:
    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        """``x``: feature rows; ``y``: the language's place in ``languages`` for each."""
        self.languages, self.code = languages, codewords(len(languages))
        bits = self.code.shape[1]
        self.weights, self.bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
        if not bits:
            return
        goal = self.code[y].astype(np.float32)
        share = np.bincount(y, minlength=len(languages))[y].astype(np.float32)
        balance = (1 / share / len(languages))[:, None]
        speed = [np.zeros_like(self.weights), np.zeros_like(self.bias)]
        for _ in range(ROUNDS):
            push = -goal / (1 + np.exp(np.clip(goal * (x @ self.weights + self.bias), -30, 30))) * balance
            for k, (value, slope) in enumerate(((self.weights, x.T @ push + 1e-6 * self.weights), (self.bias, push.sum(axis=0)))):
                speed[k] = 0.9 * speed[k] + slope
                value -= 4.0 * speed[k]
        right = np.sign(x @ self.weights + self.bias) == goal
        hits = np.array([right[y == c].mean(axis=0) if (y == c).any() else np.ones(bits) for c in range(len(languages))])
        self.trust = hits / np.maximum(1e-9, hits.sum(axis=1, keepdims=True))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language's place, score, ambiguous) of each row."""
        if len(self.languages) < 2:
            return np.zeros(len(x), np.int64), np.ones(len(x)), np.zeros(len(x), bool)
        margin = np.clip(x @ self.weights + self.bias, -30, 30).astype(np.float64)
        loss = np.log1p(np.exp(-margin[:, None, :] * self.code[None])) * self.trust[None]
        loss = loss.sum(axis=2)
        share = np.exp(-self.code.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        ranked = np.sort(share, axis=1)
        return loss.argmin(axis=1), ranked[:, -1], ranked[:, -1] - ranked[:, -2] < MARGIN


def sampled(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, text) of at most ``sample`` rows of ``rows`` (doc_id, lang, text), as many of each.

    A language's rows with the smallest hashes of id and text are taken, equal rows once.  A bound
    on the hash, about four times what is asked for, comes first, so that a task gets few rows of
    a language however many there are.
    """
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    counts = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return [], rows.select("lang", "text")
    each = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * (each + 16) / n))])
    near = hashed.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "h"])
    first = Window.partitionBy("lang").orderBy("h")
    return sorted(counts), near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).orderBy("h", "lang").select("lang", "text")


def fit(docs: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    rows = docs.where(allowed).where("lang is not null").select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known, chosen = sampled(rows, sample)
    if not known:
        return Model([], np.empty((0, BUCKETS)), np.empty(0, np.int64))
    table = chosen.toArrow()
    place = {lang: i for i, lang in enumerate(known)}
    x = [features(data, offsets) for _, data, offsets in pieces(table.select(["text"]).to_batches())]
    y = np.array([place[lang] for lang in table.column("lang").to_pylist()], np.int64)
    return Model(known, np.concatenate(x) if x else np.empty((0, BUCKETS), np.float32), y)


def identify(docs: DataFrame, allowed: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) per document row; ``allowed`` marks rows to learn from."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, allowed, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, limit=1 << 20):
            ascii_letter = np.add.reduceat(np.append(((data | 32) >= 97) & ((data | 32) <= 122), False).astype(np.int64), offsets[:-1])
            ascii_letter[np.diff(offsets) == 0] = 0
            texts = part.column("text")
            spoken = [bool(n) or any(map(str.isalpha, texts[i].as_py() or "")) for i, n in enumerate(ascii_letter.tolist())]
            spoken = np.array(spoken) & bool(model.value.languages)
            which, score, ambiguous = model.value.predict(features(data, offsets))
            langs = [model.value.languages[w] if s else "und" for w, s in zip(which.tolist(), spoken.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(spoken, score, 0.0)), pa.array(np.where(spoken, ambiguous, True))],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
