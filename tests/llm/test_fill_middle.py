import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_frames import frame
from pyspark.sql import functions as F

from matchspark.llm import fill_middle as fm


def slow(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the rules of the contract."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(df):
    rows = df.select("doc_id", "text").collect()
    made = fm.fill_in_middle(df).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    want = order([(r.doc_id, *slow(r.doc_id, r.text), r.text or "") for r in rows])
    assert order([tuple(r) for r in made]) == want
    return want


def test_odd_rows(odd):
    check(odd)


def test_empty_table(none):
    assert fm.fill_in_middle(none).collect() == []


def test_forms_markers_and_all_kinds_of_characters(spark):
    texts = ["Hello, wörld! 漢字 emoji 🙂 done", "a<P>b", "<", "<S", "x<M", "words only here", "ﬀ\x00nul\r\n", "\U0001f600" * 5, "aB9_Zz"]
    want = check(frame(spark, [(i, texts[i % len(texts)] + " tail" * (i % 4)) for i in range(400)]))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_texts_of_all_containers(spark):
    rows = [(1, "a " * 50_000), (2, "é" * 70_000), (3, "word" * 40_000), (4, "long words here " * 9_000 + "1234567 " * 9_000), (5, "x"), (6, None)]
    check(frame(spark, rows))


@pytest.mark.parametrize("share", [0.001, 0.05, 0.3, 0.9, 1.0])
def test_rank_and_select_over_every_container(share):
    rng = np.random.default_rng(4)
    mask = np.repeat(rng.random(70_000), 3) < share
    mask[65_536:131_072] = False
    members = np.flatnonzero(mask)
    found = fm.BoundarySet(mask)
    assert len(found) == len(members)
    assert (found.select(np.arange(len(members))) == members).all()
    at = rng.integers(0, len(mask) + 1, 3000)
    assert (found.rank(at) == np.searchsorted(members, at)).all()


def test_containers_are_chosen_by_size():
    chunk = 1 << 16
    runs, array, bitmap = np.ones(chunk, bool), np.zeros(chunk, bool), np.zeros(chunk, bool)
    array[::100] = bitmap[::2] = True
    kinds = [type(c).__name__ for c in fm.BoundarySet(np.concatenate([runs, array, np.zeros(chunk, bool), bitmap])).containers]
    assert kinds == ["RunContainer", "ArrayContainer", "BitmapContainer"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=300))
def test_any_mask(bits):
    mask = np.array(bits, bool)
    found = fm.BoundarySet(mask)
    members = np.flatnonzero(mask)
    assert (found.select(np.arange(len(members))) == members).all()
    assert (found.rank(np.arange(len(mask) + 1)) == np.searchsorted(members, np.arange(len(mask) + 1))).all()
