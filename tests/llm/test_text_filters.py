import random
import re

import pytest
from llm_frames import frame, words
from pyspark.sql import functions as F

from matchspark.llm import licenses, line_dedup, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = {b"scum", b"idiot", b"moron", b"worthless", b"disgusting", b"pathetic", b"stupid"}
    automaton = toxicity.Automaton(terms)
    tried = set(terms)
    for t in terms:
        for _ in range(300):
            w = bytearray(t)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w) + 1)
                kind = rng.random()
                if kind < 0.4 and at < len(w):
                    w[at] = rng.choice(b"aeiostu")
                elif kind < 0.7 and at < len(w):
                    del w[at]
                else:
                    w.insert(at, rng.choice(b"aeiostu"))
            tried.add(bytes(w))
    near = 0
    for w in tried:
        allowed = [(distance(w, t), t) for t in terms if distance(w, t) <= automaton.allowed[t]]
        got = automaton.match(w)
        assert (got is None) == (not allowed)
        if allowed:
            assert got == min(allowed)[::-1]
            near += 1
    assert near > 400


def toxic_rows(seed, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.choice([20, 80, 300]), 3000).split()
        toxic = i % 8 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Moron", "grobnak", "WORTHLESS", "trollop"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"
LEARN = lambda key: F.coalesce(key % 2 == 0, F.lit(False))


def test_toxic_texts_are_found(spark):
    rows, labels = toxic_rows(3)
    rows = [(d if d % 8 else d + (d // 8 % 2), t) for d, t in rows]
    labels = [(d if d % 8 else d + (d // 8 % 2), q, y) for d, q, y in labels]
    seen = {}
    for (d, t), (_, _, y) in zip(rows, labels):
        seen.setdefault(d, (t, y))
    rows, labels = [(d, t) for d, (t, _) in seen.items()], [(d, 1, y) for d, (_, y) in seen.items()]
    extra = [(9001, "you are an idoit, a worthles moroon and an idi0t " + words(random.Random(1), 20)), (9003, words(random.Random(2), 50))]
    scored = toxicity.toxicity_scores(frame(spark, rows + extra), spark.createDataFrame(labels, LABELS), LEARN)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    toxic = {d for d, _, y in labels if y}
    held = [d for d in got if d % 2 and d < 9000]
    assert len([d for d in held if d in toxic]) > 10
    assert all((got[d] >= 0.7) == (d in toxic) for d in held)
    assert got[9001] >= 0.7 > got[9003]


def test_quotation_counts_less():
    lexicon = toxicity.Lexicon({b"idiot": 1.0, b"moron": 1.0})
    model = toxicity.Model(lexicon, toxicity.FALLBACK)
    abuse, quoted = "you idiot and moron", 'the report "you idiot and moron" was read'
    assert model.score(abuse) > model.score(quoted) > model.score("a text")
    assert model.score(None) == model.score("") == model.score("a text")


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 1), (5, 1, 0), (7, 1, 0)], LABELS)
    allowed = lambda key: F.lit(True)
    got = toxicity.toxicity_scores(odd, labels, allowed).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_scores(none, labels, allowed).count() == 0
    assert toxicity.toxicity_scores(odd, labels.limit(0), allowed).count() == odd.count()
    kept = toxicity.drop_toxic(odd, labels, allowed)
    assert kept.columns == odd.columns and kept.count() >= odd.count() - 1


def test_recurring_lines_go_and_the_first_stays(spark):
    rng = random.Random(5)
    passage = words(rng, 55, 10**6)
    near = passage.split()
    log = lambda n: f"page {n} of the report printed on day {n * 3} by the office"
    rows = []
    for i in range(12):
        varied = list(near)
        varied[-3 + i % 2] = f"other{i}"
        own = words(rng, 30, 10**6)
        rows.append((i, "\n".join([own, passage if i < 6 else " ".join(varied), log(i), "short line"])))
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(frame(spark, rows)).collect()}
    for i, t in rows:
        lines = t.split("\n")
        kept = got[i]["text"].split("\n")
        assert kept[0] == lines[0] and kept[-1] == "short line"
        assert (lines[1] in kept, lines[2] in kept) == (i == 0, i == 0)
        assert got[i]["removed_lines"] == len(lines) - len(kept)


def test_unlike_lines_stay(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(["the same start " + words(rng, 30, 10**6) for _ in range(5)])) for i in range(40)]
    got = line_dedup.drop_recurring_lines(frame(spark, rows))
    assert got.where("removed_lines > 0").count() == 0
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == rows


def test_templates_equal_a_slow_tree(spark):
    """The lines that go are those of paths held by enough texts, but for each path's first line."""
    rng = random.Random(7)
    pool = [words(rng, n, 30) for n in (4, 8, 9, 21, 25) for _ in range(4)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else words(rng, 9, 8) for _ in range(6))) for i in range(50)]
    holders, first, asked = {}, {}, {}
    for d, t in rows:
        for n, line in enumerate(t.split("\n")):
            for path, docs in line_dedup.line_paths(line.encode()):
                holders.setdefault(path, set()).add(d)
                first.setdefault(path, (d, n))
                asked[path] = docs
    expected = {}
    for d, t in rows:
        out = [line for n, line in enumerate(t.split("\n")) if not any(len(holders[p]) >= asked[p] and first[p] != (d, n) for p, _ in line_dedup.line_paths(line.encode()))]
        expected[d] = "\n".join(out)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring_lines(frame(spark, rows)).collect()}
    assert got == expected and got != dict(rows)


def test_line_odd_rows(spark, odd, none):
    got = line_dedup.drop_recurring_lines(odd)
    assert got.columns == [*odd.columns, "removed_lines"]
    assert got.where("removed_lines > 0").count() == 0 and got.count() == odd.count()
    assert got.where("doc_id = 1").first()["text"] is None
    assert line_dedup.drop_recurring_lines(none).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_phrases_equal_brute_force(spark):
    rng = random.Random(9)
    some = ["MIT", "license", "apache", "General", "public", "License", "word", "mit"]
    rows = [(i, rng.choice([" ", ",\n", "-"]).join(rng.choice(some) for _ in range(rng.randrange(40)))) for i in range(80)] + [(99, None)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    for d, t in rows:
        w = plain_words(t)
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == sorted({label for _, label in places})


def slow_blocks(text, frequency):
    """Every run of lines tried for every template, without any filter."""
    out = []
    lines = [plain_words(x) for x in text.split("\n")]
    for name, template in sorted(licenses.TEMPLATES.items()):
        tokens = set(plain_words(template))
        i = 0
        while i < len(lines):
            found = None
            for j in range(i, len(lines)):
                if j > i and sum(map(len, lines[i : j + 1])) > licenses.STRETCH * len(tokens):
                    break
                share = len(tokens & {w for x in lines[i : j + 1] for w in x}) / len(tokens)
                if share >= licenses.THRESHOLD and tokens & set(lines[i]):
                    found = (name, i, j, share)
                    break
            if found:
                out.append(found)
                i = found[2] + 1
            else:
                i += 1
    return out


def test_blocks_equal_brute_force(spark):
    rng = random.Random(10)
    rows = []
    for i in range(60):
        lines = [words(rng, rng.randrange(12)) for _ in range(4)]
        w = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.randrange(len(w) // 3 + 1)):
            w[rng.randrange(len(w))] = rng.choice(["changed", "license", "the"])
        cut = rng.randrange(len(w))
        lines[2:2] = [" ".join(w[:cut]), " ".join(w[cut:])]
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: [tuple(b) for b in r["blocks"]] for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    expected = {d: slow_blocks(t, {}) for d, t in rows}
    assert sum(map(len, expected.values())) > 30
    for d in expected:
        assert [b[:3] for b in got[d]] == [b[:3] for b in expected[d]]
        assert all(x[3] >= licenses.THRESHOLD for x in got[d])


def test_license_odd_rows(spark, odd, none):
    got = licenses.scan_licenses(odd).collect()
    assert len(got) == odd.count()
    assert [(r["doc_id"], r["n_base"]) for r in got if r["n_base"]] == [(7, 2)]
    assert licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(odd, templates={}).where(F.size("blocks") > 0).count() == 0


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found_in_itself(name):
    index = licenses.Templates(licenses.TEMPLATES, {})
    assert name in {b[0] for b in index.blocks("some line\n" + licenses.TEMPLATES[name])}


def test_lines_are_scanned_once(spark):
    line = "these words recur in many documents and are long enough to be dropped wherever they stand again so here"
    rows = frame(spark, [(i, f"{line}\nown{i} text\n{line} once more") for i in range(6)])
    out = line_dedup.drop_recurring_lines(rows)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert sorted(r["removed_lines"] for r in out.collect()) == [0, 2, 2, 2, 2, 2]
