import hashlib
import random

from pyspark.sql import functions as F

from matchspark.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, part string, formatted string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)


def conversations(seed):
    rng = random.Random(seed)
    bits = ["\\", "###", "#", "</turn>", "</", "turn>", "\n", "é", "漢", " ", ":", "### user:\n", "\\3", "\\e", "ok"]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
            rows.append((c, t, rng.choice(["user", "assistant", "sys:tem\n###"]), text if rng.random() < 0.95 else None))
    rows += [(None, 0, "user", "no id"), (50, None, "assistant", "first"), (50, 1, None, "x"), (51, 0, "assistant", "tie b"), (51, 0, "assistant", "tie a"), (51, 0, "assistant", "tie a")]
    return rows


def expected(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {
        c: (len(x), sha("".join(f"{r}\n{t}\n" for r, t in x)), sum(len(t) for r, t in x if r == "assistant"), sha("".join(t for r, t in x if r == "assistant")))
        for c, x in out.items()
    }


def test_digests_are_those_of_the_turns(spark, monkeypatch):
    rows = conversations(1)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.digests(chat_format.format_conversations(turns(spark, rows))).collect()}
    assert got == expected(rows)


def test_a_conversation_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE", 40)
    rows = [(7, i, "user" if i % 2 else "assistant", f"turn {i} ### \\") for i in range(300)] + [(8, 0, "user", "")]
    parts = chat_format.format_conversations(turns(spark, rows).repartition(5))
    assert parts.where("conv_id = 7").count() > 20
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.digests(parts).collect()}
    assert got == expected(rows)


def test_formatted_text_reads_back(spark):
    rows = conversations(2)
    for r in chat_format.format_conversations(turns(spark, rows)).where("conv_id is not null").collect():
        back = chat_format.read_back(r["formatted"])
        assert len(back) == r["n_turns"]
        assert r["formatted"].count("</turn>\n") == r["n_turns"] == r["formatted"].count("### ")
        said = [t for role, t in back if role == "assistant"]
        spans = [chat_format.unescape(r["formatted"][a : a + n]) for a, n in zip(r["loss_start"], r["loss_chars"])]
        assert spans == said


def test_empty(spark):
    assert chat_format.digests(chat_format.format_conversations(turns(spark, []))).count() == 0
    one = chat_format.digests(chat_format.format_conversations(turns(spark, [(1, 1, None, None)]))).first()
    assert (one["n_turns"], one["loss_chars"], one["formatted_chars"]) == (1, 0, len("### :\n</turn>\n"))
