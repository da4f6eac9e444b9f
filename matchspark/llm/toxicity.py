"""Toxicity by misspelling-tolerant lexicon search and context windows.

The lexicon holds ``BASE_TERMS`` and terms mined from labelled training rows.  Its trie and
the Levenshtein automata of its terms are intersected into one automaton, whose states are sets
of (trie node, edits so far) and are built when first needed: one edit for terms of
``ONE_EDIT`` letters or more, two from ``TWO_EDITS``.  A text's words are read through it.  Known
clean words (seen in clean training texts) match nothing except as exact terms.

Every hit is weighed by the ``AROUND`` words on either side: in quotation marks or beside
words of reporting it counts as quotation, beside other hits as abuse.  A logistic model over
those sums gives the score.

The lexicon and the model are fitted on at most ``SAMPLE`` toxic and twice as many clean labelled
texts (by the smallest hash of the id), one half mining terms and the other half weighing features;
terms of both halves are used afterwards.  Scoring covers every whole text.  Null or empty texts
have no hits and get the score of no hits.  Several labels for one id: the largest counts.
Without labelled rows of both classes the fixed ``FALLBACK`` weights hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English insults and words that report speech.
BASE_TERMS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
REPORTING = frozenset(b"said says saying wrote writes called calls quote quoted quotes reported reports according".split())

SAMPLE = 3000
PURITY = 0.98
ONE_EDIT, TWO_EDITS = 5, 9
AROUND = 8
THRESHOLD = 0.7
#: A misspelt hit counts as so much of an exact one.
MISSPELT = 0.6
#: Intercept and weights of abusive hits, the misspelt ones among them, quoted and crowded hits, where nothing can be learnt.
FALLBACK = np.array([-3.0, 4.5, 0.0, 0.6, 1.0])
CACHE = 100_000

_word = re.compile(rb"[0-9a-z\x80-\xff]+")
_quotes = re.compile("\"|«|»|“|”|„".encode())


class Automaton:
    """Levenshtein automata of all terms, intersected with the terms' trie."""

    def __init__(self, terms: set[bytes]):
        self.children: list[dict[int, int]] = [{}]
        self.term: list[bytes | None] = [None]
        self.budget = [0]
        for term in sorted(terms):
            allowed = 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0
            node = 0
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            self.term[node] = term
        self.allowed = {t: 2 if len(t) >= TWO_EDITS else 1 if len(t) >= ONE_EDIT else 0 for t in terms}
        self.reset()

    def reset(self) -> None:
        self.steps: dict[tuple[int, int], int] = {}
        self.sets: list[tuple[tuple[int, int], ...]] = []
        self.ids: dict[tuple[tuple[int, int], ...], int] = {}
        self.dead = self.state({})
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> int:
        """The number of a set of (node, least edits), closed under missing letters."""
        stack = list(nodes.items())
        while stack:
            node, edits = stack.pop()
            if nodes[node] < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.budget[child] and nodes.get(child, 9) > edits + 1:
                    nodes[child] = edits + 1
                    stack.append((child, edits + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
        return self.ids[key]

    def step(self, state: int, c: int) -> int:
        out: dict[int, int] = {}
        for node, edits in self.sets[state]:
            if edits + 1 <= self.budget[node] and out.get(node, 9) > edits + 1:
                out[node] = edits + 1  # a letter too many
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= self.budget[child] and out.get(child, 9) > cost:
                    out[child] = cost
        return self.state(out)

    def match(self, word: bytes) -> tuple[bytes, int] | None:
        """The nearest term within its edits (ties: the first by bytes) and the distance."""
        if len(self.sets) > CACHE:
            self.reset()
        state, steps = self.start, self.steps
        for c in word:
            nxt = steps.get((state, c))
            if nxt is None:
                nxt = steps[state, c] = self.step(state, c)
            state = nxt
            if state == self.dead:
                return None
        ends = [(edits, self.term[node]) for node, edits in self.sets[state] if self.term[node] and edits <= self.allowed[self.term[node]]]
        if not ends:
            return None
        edits, term = min(ends)
        return term, edits


class Lexicon:
    """Terms with their weights, and clean words that are near a term but not meant."""

    def __init__(self, weights: dict[bytes, float], clean: frozenset[bytes] = frozenset()):
        self.weights, self.clean = weights, clean
        self.automaton = Automaton(set(weights))
        self.known: dict[bytes, tuple[float, int] | None] = {}

    def __reduce__(self):
        return Lexicon, (self.weights, self.clean)

    def look(self, word: bytes) -> tuple[float, int] | None:
        """(weight, edits) of a word that is or misspells a term."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > CACHE:
            self.known.clear()
        found = None
        if word in self.weights:
            found = self.weights[word], 0
        elif word not in self.clean and len(word) >= ONE_EDIT - 1 and (m := self.automaton.match(word)):
            found = self.weights[m[0]], m[1]
        self.known[word] = found
        return found

    def features(self, text: str | None) -> tuple[float, ...]:
        """Sums over hits: abusive, misspelt, quoted, and crowded (other hits close by), log-scaled; one hit is about 1."""
        data = (text or "").encode().lower()
        words = _word.findall(data)
        look = self.look
        hit_words = {w: f for w in set(words) if (f := look(w))}
        if not hit_words:
            return 0.0, 0.0, 0.0, 0.0
        at = [i for i, w in enumerate(words) if w in hit_words]
        spans = [m.span() for m in _word.finditer(data)]
        marks = np.array([m.start() for m in _quotes.finditer(data)], np.int64)
        lines = np.array([m.start() for m in re.finditer(b"\n", data)], np.int64)
        exact = misspelt = quoted = crowded = 0.0
        for n, i in enumerate(at):
            weight, edits = hit_words[words[i]]
            near = words[max(0, i - AROUND) : i + AROUND + 1]
            start = spans[i][0]
            line = lines[k - 1] if (k := np.searchsorted(lines, start)) else -1
            inside = (np.searchsorted(marks, start) - np.searchsorted(marks, line)) % 2 == 1
            if inside or not REPORTING.isdisjoint(near):
                quoted += weight
            elif edits:
                misspelt += weight / edits
            else:
                exact += weight
            crowded += (n > 0 and i - at[n - 1] <= AROUND) or (n + 1 < len(at) and at[n + 1] - i <= AROUND)
        sums = (exact + MISSPELT * misspelt, misspelt, quoted, crowded)
        return tuple(math.log1p(4 * x) / math.log(5) for x in sums)


def mine_terms(texts: list[tuple[str, int]]) -> tuple[dict[bytes, float], Counter]:
    """(terms with weights in 0..1, texts of each clean word) from labelled texts.

    A term stands almost only in toxic texts, first of all between so many different neighbours (copies
    of a text count once) that chance would hardly give one such word in the whole vocabulary.
    """
    seen = (Counter(), Counter())
    for text, label in texts:
        seen[label].update(set(_word.findall((text or "").encode().lower())))
    bad, good = max(1, sum(y for _, y in texts)), max(1, sum(1 - y for _, y in texts))
    vocabulary = len(seen[0]) + sum(w not in seen[0] for w in seen[1])
    least = math.log(100 * max(1, vocabulary)) / math.log((bad + good) / bad)
    weights = {}
    for word, n in seen[1].items():
        rate = (n / bad) / (n / bad + seen[0][word] / good)
        if rate >= PURITY and len(word) >= 4 and n >= least:
            weights[word] = rate
    around: dict[bytes, set[tuple[bytes, bytes]]] = {w: set() for w in weights}
    for text, label in texts:
        if label:
            words = _word.findall((text or "").encode().lower())
            for word in weights.keys() & set(words):
                at = words.index(word)
                around[word].add((words[at - 1] if at else b"", words[at + 1] if at + 1 < len(words) else b""))
    weights = {w: rate for w, rate in weights.items() if len(around[w]) >= least}
    return weights, seen[0]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps, pulled towards FALLBACK's weights."""
    x = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array([0.1, 1.0, 1.0, 1.0, 1.0])

    def loss(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(prior * (w - FALLBACK) ** 2)

    w = FALLBACK.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + prior * (w - FALLBACK)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior), slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    w[[1, 3, 4]] = np.maximum(w[[1, 3, 4]], 0.1)  # a hit never speaks for a clean text
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], self.lexicon.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(texts: list[tuple[str, int]]) -> Model:
    """A model from (text, 0 or 1) rows; see the module for what it learns from which half."""
    base = {t.encode(): 1.0 for t in BASE_TERMS}
    if len({y for _, y in texts}) < 2:
        return Model(Lexicon(base), FALLBACK)

    def lexicon(rows):
        mined, clean = mine_terms(rows)
        terms = {t: w for t, w in base.items() if clean[t] * 50 <= sum(1 for _, y in rows if not y)} | mined
        near = Automaton(set(terms))
        return Lexicon(terms, frozenset(w for w in clean if w not in terms and near.match(w)))

    half, rest = texts[::2], texts[1::2]
    trial = lexicon(half if len({y for _, y in half}) == 2 else texts)
    y = np.array([label for _, label in rest], float)
    weights = _fit(np.array([trial.features(t) for t, _ in rest]), y) if len(set(y)) == 2 else FALLBACK
    return Model(lexicon(texts), weights)


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Callable[[Column], Column], sample: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``sample`` toxic and twice as many clean (text, label) among the ids that ``allowed`` admits."""
    marks = labels.select(F.col("doc_id").alias("__id"), "toxic").where("toxic in (0, 1)").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(allowed(F.col("__id")))
    order = F.xxhash64("__id")
    chosen = None
    for y in (0, 1):
        some = marks.where(F.col("toxic") == y).orderBy(order, "__id").limit(sample * (2 - y))
        chosen = some if chosen is None else chosen.unionByName(some)
    # 3 x sample ids: a bounded broadcast.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    table = rows.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    return list(zip(table.column("text").to_pylist(), table.column("toxic").to_pylist()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, allowed: Callable[[Column], Column], sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) per document row; ``allowed`` maps the id column to whether its label may be learnt from."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, allowed, sample)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                score = [model.value.score(t) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, allowed: Callable[[Column], Column], threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, allowed)))

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: model.value.score(t))

    return docs.where(score(F.col("text").cast("string")) < threshold)
