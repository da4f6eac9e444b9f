"""License notices by an exact set-similarity join of text blocks with templates.

Tokens are the distinct words of a template, ordered by how many texts hold them, rarest first,
counted over all texts.  A block contains a template of n tokens if it holds at least
``ceil(THRESHOLD * n)`` of them.  Three filters skip what cannot reach that, without losing a block:

* prefix: a block must hold one of the template's ``n - need + 1`` rarest tokens, so texts
  holding none of any template's are passed over;
* length: a block of fewer than ``need`` words is extended or skipped;
* position: tokens are looked up rarest first, and the look-up ends once the tokens left cannot
  make up for those missing.

Blocks are runs of whole consecutive lines: one line, or as many as have at most
``STRETCH`` times the template's words.  Of overlapping blocks the first is kept.

Besides, ``PHRASES`` are counted wherever their words stand consecutively.  Null text is empty:
no words, no labels, score 0.  Repeated rows are scanned row by row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases with their labels, and the wording of public license notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    ),
    "apache-2.0-text": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met."
    ),
    "gpl-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or any later version."
    ),
}
THRESHOLD = 0.8
STRETCH = 2

_word = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _word.findall((text or "").encode().lower())


def token_texts(docs: DataFrame, tokens: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How many texts hold each of these tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for t in batch.column("text").slice(at, 500).to_pylist():
                    seen.update(tokens.intersection(words_of(t)))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(scan, "token binary, n long")
    # One row per template token: bounded by the templates.
    return {bytes(r["token"]): r["n"] for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Templates:
    """Templates with their tokens in global order and an index of their prefixes."""

    def __init__(self, texts: dict[str, str], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.tokens, self.need, self.prefix = {}, {}, {}
        for name, text in texts.items():
            tokens = sorted(set(words_of(text)), key=lambda t: (frequency.get(t, 0), t))
            if tokens:
                need = math.ceil(threshold * len(tokens) - 1e-9)
                self.tokens[name], self.need[name] = tokens, need
                for t in tokens[: len(tokens) - need + 1]:
                    self.prefix.setdefault(t, []).append(name)
        self.starts = frozenset(self.prefix)

    def overlap(self, name: str, block: set[bytes]) -> int:
        """Tokens of the template in the block, or 0 as soon as too many are missing."""
        tokens, missing = self.tokens[name], len(self.tokens[name]) - self.need[name]
        held = 0
        for t in tokens:
            if t in block:
                held += 1
            else:
                missing -= 1
                if missing < 0:
                    return 0
        return held

    def blocks(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first line, last line, containment) of every block that meets the threshold."""
        data = text.encode().lower()
        if self.starts.isdisjoint(_word.findall(data)):
            return []
        lines = [_word.findall(x) for x in data.split(b"\n")]
        sets = [set(x) for x in lines]
        names = {n for s in sets for t in self.starts & s for n in self.prefix[t]}
        out = []
        for name in sorted(names):
            tokens, need, most = set(self.tokens[name]), self.need[name], STRETCH * len(self.tokens[name])
            i = 0
            while i < len(lines):
                if tokens.isdisjoint(sets[i]):
                    i += 1
                    continue
                block, length, j, held = set(), 0, i, 0
                while j < len(lines) and (j == i or length + len(lines[j]) <= most):
                    block |= sets[j]
                    length += len(lines[j])
                    if length >= need and (held := self.overlap(name, block)):
                        break
                    j += 1
                if held:
                    out.append((name, i, j, held / len(tokens)))
                    i = j + 1
                else:
                    i += 1
        return out


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, int, str]]:
    """(first word, words, label) wherever a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                out.append((at, len(parts), label))
    return sorted(out)


SCANNED = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "blocks array<struct<template:string,first_line:int,last_line:int,containment:double>>"
)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """Per document row: key, n_words, phrase places (n_base, first and last start), base_labels, and all blocks."""
    vocabulary = {t for text in templates.values() for t in words_of(text)}
    index = docs.sparkSession.sparkContext.broadcast(Templates(templates, token_texts(docs, vocabulary), threshold))
    kind = docs.schema[key].dataType.simpleString()
    firsts = tuple(p.encode().split()[-1] for p in phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_type = pa.list_(pa.struct([("template", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("containment", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                n_words, n, first, last, labels, blocks = [], [], [], [], [], []
                for t in some.column("text").to_pylist():
                    words = words_of(t)
                    places = phrase_places(words, phrases) if any(w in words for w in firsts) else []
                    n_words.append(len(words))
                    n.append(len(places))
                    first.append(places[0][0] if places else None)
                    last.append(places[-1][0] if places else None)
                    labels.append(sorted({p[2] for p in places}))
                    blocks.append([dict(zip(("template", "first_line", "last_line", "containment"), b)) for b in index.value.blocks(t or "")])
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), long(n_words), long(n), long(first), long(last), pa.array(labels, pa.list_(pa.string())), pa.array(blocks, block_type)],
                    names=["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(scan, f"key {kind}, {SCANNED}")
    return rows.withColumnRenamed("key", key)
