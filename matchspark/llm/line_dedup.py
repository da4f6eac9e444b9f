"""Dropping recurring lines by a fixed-depth template tree.

A line's path in the tree is its token count, its ``LEADING`` first tokens, then ``PARTS``
segments of the rest.  Tokens with a digit are variable fields from the start.  One segment may
hold further variable fields: besides its exact path a line belongs to the paths in which one
segment is a wildcard.  Lines on one path share a template; its constant tokens are those
outside the wildcard and without digits.

A template recurs if enough different documents hold it, more for short templates than for
long ones (``RULES``: constant tokens, documents).  Its first line (smallest document, then
line) stays; all others are dropped.  Lines of fewer constant tokens than any rule asks for
always stay.  Counts are summed per task before the shuffle, so a line that a third
of all documents share costs a row per task.  Lines are scanned once; their templates are written
and read for the counts and for the lines to drop.

Null text stays null and empty text empty.  Rows that agree in id and text are one place:
all of them keep or lose the same lines.  A template counts once per row, however often it
stands there.  An input column ``removed_lines`` is replaced by the number of lines dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from matchspark.llm.workdir import stored

LEADING = 2
PARTS = 4
#: (least constant tokens, least documents): a line of words enough is removed when seen in this many.
RULES = ((20, 2), (8, 4), (4, 20))

_digit = re.compile(rb"\d")


def line_paths(line: bytes) -> list[tuple[int, int]]:
    """(template, documents asked for) of each path a line is on, its exact path first."""
    tokens = line.lower().split()
    least = RULES[-1][0]
    if len(tokens) < least:
        return []
    if _digit.search(line):
        tokens = [b"<*>" if _digit.search(t) else t for t in tokens]
    constant = len(tokens) - tokens.count(b"<*>")
    rest = tokens[LEADING:]
    cuts = [len(rest) * k // PARTS for k in range(PARTS + 1)]
    head = b"%d " % len(tokens) + b" ".join(tokens[:LEADING])
    nodes = [b" ".join(rest[a:b]) for a, b in zip(cuts, cuts[1:])]
    asked = next((docs for words, docs in RULES if constant >= words), 0)
    if not asked:
        return []
    out = [(xxh3_64_intdigest(b"\n".join([head, *nodes])) - (1 << 63), asked)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        fixed = constant - sum(t != b"<*>" for t in rest[a:b])
        asked = next((docs for words, docs in RULES if fixed >= words), 0)
        if asked and b > a:
            out.append((xxh3_64_intdigest(b"\n".join([head, *nodes[:k], b"<*> %d" % k, *nodes[k + 1 :]])) - (1 << 63), asked))
    return out


def line_templates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(template, asked, key, row, line, fresh): a row per line and path.

    ``row`` identifies (key, text); ``fresh`` is 1 for a template's first line in its text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found: list[tuple[int, int, int, int, bool]] = []
                for i, t in enumerate(some.column("text").to_pylist()):
                    seen: set[int] = set()
                    for n, line in enumerate((t or "").encode().split(b"\n")):
                        for path, asked in line_paths(line):
                            found.append((path, asked, i, n, path not in seen))
                            seen.add(path)
                if found:
                    path, asked, i, n, fresh = (np.array(x, np.int64) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(path), pa.array(asked, pa.int32()), some.column("key").take(pa.array(i)), some.column("row").take(pa.array(i)), pa.array(n, pa.int32()), pa.array(fresh, pa.int32())],
                        names=["template", "asked", "key", "row", "line", "fresh"],
                    )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(key, text).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scan, "template long, asked int, key long, row long, line int, fresh int")


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, lines): the numbers of lines to drop from each row that has any."""
    lines = stored(line_templates(docs, key, text), "lines")
    place = F.struct(F.coalesce("key", F.lit(-(1 << 63))).alias("key"), "row", "line")
    recurring = (
        lines.groupBy("template")
        .agg(F.sum("fresh").alias("docs"), F.max("asked").alias("asked"), F.min(place).alias("first"))
        .where("docs >= asked")
        .select("template", "first")
    )
    dropped = lines.join(recurring, "template").where((F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")))
    return dropped.groupBy("row").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns; recurring lines are gone from the text. See the module for the rules."""
    names = docs.columns
    marked = docs.withColumn("__row", F.xxhash64(key, text))
    gone = recurring_lines(docs, key, text).select(F.col("row").alias("__gone_row"), F.col("lines").alias("__lines"))
    joined = marked.join(gone, marked["__row"] == gone["__gone_row"], "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains("__lines", i))
    text_now = F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.concat_ws("\n", kept))
    removed = F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines"))
    return joined.select(
        *[text_now.alias(text) if c == text else F.col(c) for c in names if c != "removed_lines"], removed.alias("removed_lines")
    )
