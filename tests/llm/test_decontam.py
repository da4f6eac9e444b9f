import random
import re

import numpy as np
from llm_frames import frame, words

from matchspark.llm import decontam
from matchspark.llm.text import WORD, pieces, word_hashes

LINE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return LINE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    have, hit, found = tokens(text), set(), set()
    for item, t in items:
        want = tokens(t)
        n = min(10, len(want))
        grams = {tuple(want[i : i + n]) for i in range(len(want) - n + 1)} if n else set()
        for i in range(len(have) - n + 1 if n else 0):
            if tuple(have[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(have), len(hit), sorted(found)


def planted(seed):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.choice([1, 3, 9, 10, 11, 40]), 60)) for i in range(25)] + [(98, None), (99, " ! "), (3, words(rng, 15, 60))]
    rows = []
    for d in range(60):
        text = words(rng, rng.choice([0, 4, 60, 200]), 60)
        if d % 2:
            item = tokens(rng.choice(items)[1])
            a = rng.randrange(len(item) + 1)
            text += "\n" + ", ".join(item[a : a + 14]).upper() + ". " + text
        rows.append((d, text))
    return items, rows


def result(df):
    return sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in df.collect())


def test_equals_brute_force(spark):
    items, rows = planted(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((d, *brute(t, items)[:2], tuple(brute(t, items)[2])) for d, t in rows)
    assert sum(bool(x[3]) for x in expected) > 20
    found = decontam.contamination(frame(spark, rows), bench)
    assert result(found) == expected
    # Blocks of the benchmark change nothing, nor do repeated rows.
    assert result(decontam.contamination(frame(spark, rows + rows[:5]), bench, block_chars=300)) == sorted(expected + expected[:5])


def test_matches_are_maximal_and_located(spark):
    rng = random.Random(2)
    item = words(rng, 40, 10**6)
    listed = item.split()
    rows = [(1, "x " + " ".join(listed[5:30]) + " y z"), (2, " ".join(listed[:9]))]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(frame(spark, rows), bench).collect()}
    assert [tuple(m) for m in got[1]["matches"]] == [("7", 5, 1, 25)]
    assert (got[1]["longest"], got[2]["contaminated"]) == (25, False)
    kept = decontam.decontaminate(frame(spark, rows), bench)
    assert [r["doc_id"] for r in kept.collect()] == [2]
    assert kept.columns == frame(spark, rows).columns


def test_suffixes_are_sorted():
    import pyarrow as pa

    rng = random.Random(4)
    batch = pa.RecordBatch.from_pydict({"text": [words(rng, 300, 5), words(rng, 200, 5), "", words(rng, 50, 3)]})
    ((_, data, offsets),) = pieces([batch])
    shard = decontam.Shard(*word_hashes(data, offsets, WORD))
    suffixes = [tuple(shard.seq[p : p + 10]) for p in shard.order]
    assert suffixes == sorted(suffixes) and len(suffixes) == 550
    assert np.array_equal(np.sort(shard.order), shard.place)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "mit license"), (None, "one"), (2, None)], "item_id long, text string")
    got = decontam.contamination(odd, bench).collect()
    assert len(got) == odd.count()
    assert [(r["doc_id"], r["n_hit"]) for r in got if r["contaminated"]] == [(7, 4)]
    assert decontam.decontaminate(odd, bench).count() == odd.count() - 1
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where("contaminated").count() == 0


def test_rows_are_judged_one_by_one(spark):
    """A contaminated row takes no other row with it, whether their id is null or repeated."""
    bad = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([("b", bad)], "item_id string, text string")
    rows = [(None, bad), (None, "clean words"), (None, None), (5, bad), (5, "clean"), (5, "")]
    for size in (8_000_000, 20):
        kept = decontam.decontaminate(frame(spark, rows), bench, block_chars=size)
        assert kept.columns == frame(spark, rows).columns
        assert sorted((r.doc_id or 0, r.text or "-") for r in kept.collect()) == [(0, "-"), (0, "clean words"), (5, "-"), (5, "clean")]
