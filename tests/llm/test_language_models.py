import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_frames import frame, words
from pyspark.sql import functions as F

from matchspark.llm import lang_id, suffix_lm
from matchspark.llm.text import pieces

def train():
    return F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))


def test_base_score_and_counts(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.choice([0, 1, 40]), 50) + (" RARE%d" % i if i % 5 == 0 else "")) for i in range(60)] + [(61, None)]
    tokens = {d: (t or "").lower().split() + [""] for d, t in rows}
    count = Counter(w for d, ws in tokens.items() if d % 3 for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in suffix_lm.score_texts(frame(spark, rows), train(), block_bytes=500).collect()}
    assert len(got) == len(rows)
    for d, ws in tokens.items():
        r = got[d]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)


def tree(spark, texts, depth, share, gain):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return suffix_lm.suffix_tree(suffix_lm.gram_counts(rows, depth), depth, share, gain).collect()


def slow_tree(texts, depth, share, gain):
    counts = [Counter() for _ in range(depth + 1)]
    for t in texts:
        s = chr(10) * depth + " ".join((t or "").lower().split()) + chr(9)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts[d][s[i - d : i], s[i]] += 1
    total = sum(counts[0].values())
    sums = [Counter() for _ in counts]
    for d, c in enumerate(counts):
        for (context, _), n in c.items():
            sums[d][context] += n
    kept = {"": {s: n for (_, s), n in counts[0].items()}}
    for d in range(1, depth + 1):
        for context, n in sums[d].items():
            if n >= max(1, share * total):
                follow = {s: m for (c, s), m in counts[d].items() if c == context}
                up = context[1:]
                if sum(m * math.log(m / n / (counts[d - 1][up, s] / sums[d - 1][up])) for s, m in follow.items()) >= gain:
                    kept[context] = follow
    return kept


def test_tree_and_scores_equal_a_slow_model(spark, monkeypatch):
    monkeypatch.setattr(suffix_lm, "SEGMENT", 7)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aba", "abba", "Bab", "cab"]) for _ in range(rng.randrange(30))) for _ in range(40)] + [None, ""]
    kept = slow_tree(texts, 3, 0.002, 2.0)
    rows = tree(spark, texts, 3, 0.002, 2.0)
    got = {}
    for r in rows:
        got.setdefault(int(r["context"]).to_bytes(8, "big")[8 - r["depth"] :].decode() if r["depth"] else "", {})[chr(r["symbol"])] = r["n"]
    assert got == kept and len(kept) > 5
    model = suffix_lm.Automaton(*(list(c) for c in zip(*[tuple(r) for r in rows])))

    def share(context, symbol):
        longest = next(context[i:] for i in range(len(context) + 1) if context[i:] in kept)
        up = share(longest[1:], symbol) if longest else 1 / 256
        follow = kept[longest]
        return (follow.get(symbol, 0) + len(follow) * up) / (sum(follow.values()) + len(follow))

    new = ["abba cab zebra", "", "bab " * 20, "ABBA"]
    ((_, data, offsets),) = pieces([pa.RecordBatch.from_pydict({"text": new})])
    scores = model.scores(*suffix_lm.symbols(data, offsets))
    for t, got_score in zip(new, scores):
        s = chr(10) * 3 + " ".join(t.lower().split()) + chr(9)
        expected = sum(math.log10(share(s[i - 3 : i], s[i])) for i in range(3, len(s)))
        assert math.isclose(expected, got_score, rel_tol=1e-4)
    total = sum(10 ** model.log10[0, model.column[b]] for b in range(256))
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_held_out_text_is_likelier_than_by_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    got = suffix_lm.score_texts(docs, F.col("doc_id") % 5 != 0).where("doc_id % 5 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_odd_rows(spark, odd, none):
    got = suffix_lm.score_texts(odd, train()).collect()
    assert len(got) == odd.count()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(r["score"] < 0 for r in got)
    assert suffix_lm.score_texts(none, train()).count() == 0
    untrained = suffix_lm.score_texts(odd, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in untrained)


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    allowed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    got = lang_id.identify(docs, allowed).join(docs.where(~allowed).where("lang is not null"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.95


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 30):
        code = lang_id.codewords(n)
        apart = (code[:, None] != code[None]).sum(axis=2)[~np.eye(n, dtype=bool)]
        assert code.shape[0] == n and apart.min() >= (1 if n < 4 else 4)


def test_language_odd_rows(spark, odd, none):
    allowed = F.lit(True)
    got = {r["doc_id"]: r for r in lang_id.identify(odd, allowed).collect()}
    assert [got[d]["lang_pred"] for d in (1, 2, 3, 8)] == ["und"] * 4
    assert got[5]["lang_pred"] in ("en", "de") and 0 <= got[5]["score"] <= 1
    assert lang_id.identify(none, allowed).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(odd, F.lit(False)).collect()} == {"und"}
    one = lang_id.identify(odd.where("lang = 'en'"), allowed).where("doc_id = 5").first()
    assert (one["lang_pred"], one["score"]) == ("en", 1.0)


def test_rare_contexts_stay_beside_a_large_corpus(spark):
    """Scores equal those of the whole tree in one process; a rare language keeps its contexts whatever else is learnt."""
    rng = random.Random(4)
    rare = [(3 * i + 1, "qofzip " * 4) for i in range(2)]
    common = [(3 * i + 1, words(rng, 400, 60)) for i in range(100, 700)]
    new = [(0, "qofzip qofzip"), (3, words(rng, 50, 60)), (6, "Überfluß 漢字漢字"), (9, None)]
    rows = rare + common + new
    got = {r["doc_id"]: r["score"] for r in suffix_lm.score_texts(frame(spark, rows), train(), block_bytes=100_000).collect()}
    learnt = spark.createDataFrame([(t,) for _, t in rare + common], "text string")
    total = sum(len((t or "").split()) and len(" ".join(t.split()).encode()) + 1 for _, t in rare + common)
    whole = suffix_lm.suffix_tree(suffix_lm.gram_counts(learnt), min_share=suffix_lm.MIN_COUNT / total)
    model = suffix_lm.Automaton(*(c.to_numpy() for c in whole.toArrow().columns))
    ((_, data, offsets),) = pieces([pa.RecordBatch.from_pydict({"text": [t for _, t in new]})])
    for (d, _), expected in zip(new, model.scores(*suffix_lm.symbols(data, offsets))):
        assert math.isclose(got[d], expected, rel_tol=1e-4)
    assert got[0] > -15


def test_a_context_of_six_symbols_tells(spark):
    rows = [(3 * i + 1, w) for i in range(30) for w in ("akkkkkb", "ckkkkkd")] + [(0, "akkkkkb"), (3, "akkkkkd")]
    apart = lambda **options: (lambda s: s[0] - s[3])({r["doc_id"]: r["score"] for r in suffix_lm.score_texts(frame(spark, rows), train(), **options).collect() if r["doc_id"] % 3 == 0})
    assert abs(apart(depth=5)) < 0.1 and apart() > 1


def test_sample_of_repeated_ids_and_of_a_hot_language(spark):
    rows = [(1, f"text {i}", "en", "s") for i in range(1000)] + [(2, "same", "de", "s")] * 1000 + [(3, "allein", "fr", "s")]
    rows = frame(spark, rows).select("doc_id", "lang", "text")
    known, chosen = lang_id.sampled(rows, 300)
    got = chosen.groupBy("lang").count().collect()
    assert known == ["de", "en", "fr"] and {r["lang"]: r["count"] for r in got} == {"en": 100, "de": 1, "fr": 1}


def test_a_block_is_a_task_of_its_own(spark):
    rng = random.Random(6)
    docs = frame(spark, [(i, words(rng, 40)) for i in range(120)])
    blocked, blocks = suffix_lm._blocked(docs, "doc_id", "text", train(), 2000)
    asked = suffix_lm.block_terms(blocked, blocks).select("block", F.spark_partition_id().alias("task")).distinct().collect()
    assert blocks > 10 and len({r.block for r in asked}) == len(asked) == len({r.task for r in asked})


def test_runs_are_merged_range_by_range(monkeypatch):
    rng = np.random.default_rng(1)
    held = [np.unique(rng.integers(0, 60_000, 50_000).astype(np.uint64) ** 3, return_counts=True) for _ in range(8)]
    held += [(np.empty(0, np.uint64), np.empty(0, np.int64)), (np.arange(5, dtype=np.uint64), np.zeros(5, np.int64))]
    want = Counter()
    for codes, n in held:
        for c, k in zip(codes.tolist(), n.tolist()):
            want[c] += k
    monkeypatch.setattr(suffix_lm, "RUN", 1 << 14, raising=False)
    tracemalloc.start()
    codes, n = suffix_lm._merged(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert codes.tolist() == sorted(want) and n.tolist() == [want[c] for c in sorted(want)]
    assert peak < sum(c.nbytes + n.nbytes for c, n in held)


def test_texts_without_words_alone(spark):
    got = suffix_lm.score_texts(frame(spark, [(1, ""), (2, None), (3, " ")]), train()).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in got} == {1: (1, 1), 2: (1, 1), 3: (1, 1)}
