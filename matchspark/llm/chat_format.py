"""Chat transcripts from turns by columnar byte assembly.

A turn is ``### role:\\n text </turn>\\n`` without the blanks.  Inside roles and texts a backslash
becomes ``\\\\``, ``###`` becomes ``\\3``, ``</turn>`` becomes ``\\e``, and in roles a line feed
``\\n`` and a colon ``\\c``; so no control string can occur there and ``unescape`` gives the
text back.

Turns are range-partitioned by conversation and turn, so a very long conversation is spread
over tasks.  Each task assembles runs of rows: the lengths of all segments, their cumulative
offsets and scatter indices are computed in numpy, and headers, texts and footers are copied
into one preallocated buffer, which becomes an Arrow column without another copy.  A conversation's
pieces come as ``part`` numbers in reading order, so no value grows without bound.

Rows stand by turn (null first), then role, then text.  Null roles and texts are empty; a null
conv_id is a conversation of its own.  Equal rows all count.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, FOOT = b"### ", b":\n", b"</turn>\n"
PIECE = 4 << 20
FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss_start array<long>, loss_chars array<long>"

_role_escapes = ((b"\\", b"\\\\"), (b"###", b"\\3"), (b"</turn>", b"\\e"), (b"\n", b"\\n"), (b":", b"\\c"))
_plain = {"\\": "\\", "3": "###", "e": "</turn>", "n": "\n", "c": ":"}
_escaped = re.compile(r"\\(.)")
_turn = re.compile(r"### ([^:]*):\n(.*?)</turn>\n", re.S)


def escape(text: bytes, escapes=_role_escapes[:3]) -> bytes:
    for plain, written in escapes:
        text = text.replace(plain, written)
    return text


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _plain[m[1]], text) if "\\" in text else text


def assemble(segments: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer holding, row after row, each column's segment; and the (rows, columns) + end offsets.

    ``segments`` is a list of columns: byte strings per row, or one repeated for every row.
    """
    n = max(len(c) for c in segments)
    lengths = np.empty((n, len(segments)), np.int64)
    for k, column in enumerate(segments):
        lengths[:, k] = [len(x) for x in column] if len(column) == n else len(column[0])
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    buffer = np.empty(int(offsets[-1]), np.uint8)
    starts = offsets[:-1].reshape(n, -1)
    for k, column in enumerate(segments):
        size = lengths[:, k]
        source = np.frombuffer(b"".join(column if len(column) == n else column * n), np.uint8)
        within = np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size)
        buffer[np.repeat(starts[:, k], size) + within] = source
    return buffer, offsets


def _formatted_run(ids: list, roles: list[bytes], texts: list[bytes], assistant: bytes) -> dict:
    """Parts of a run of rows sorted by conversation: texts as an Arrow array, and the assistants' spans."""
    contents = [escape(t) if b"\\" in t or b"###" in t or b"</turn>" in t else t for t in texts]
    buffer, offsets = assemble([[HEAD], [escape(r, _role_escapes) for r in roles], [MIDDLE], contents, [FOOT]])
    first = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
    part_at = offsets[np.array([*(5 * i for i in first), len(offsets) - 1])]
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(part_at.astype(np.int64)), pa.py_buffer(buffer)])
    # Code points before each byte: continuation bytes do not begin one.
    chars = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
    begin, end = chars[offsets[3:-1:5]], chars[offsets[4::5]]
    loss = np.array([r == assistant for r in roles])
    starts, sizes = [], []
    for a, b in zip(first, [*first[1:], len(ids)]):
        mine = np.flatnonzero(loss[a:b]) + a
        starts.append((begin[mine] - chars[offsets[5 * a]]).tolist())
        sizes.append((end[mine] - begin[mine]).tolist())
    return {
        "conv_id": pa.array([ids[i] for i in first], pa.int64()),
        "n_turns": pa.array(np.diff([*first, len(ids)]), pa.int64()),
        "formatted": formatted.cast(pa.string()),
        "loss_start": pa.array(starts, pa.list_(pa.int64())),
        "loss_chars": pa.array(sizes, pa.list_(pa.int64())),
    }


def format_conversations(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Rows of ``FORMATTED``: a conversation's formatted text in parts, with the loss mask as character spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = batch.to_pydict()
            at = 0
            while at < batch.num_rows:
                size, end = 0, at
                while end < batch.num_rows and (end == at or size < PIECE):
                    size += len(rows["text"][end])
                    end += 1
                run = _formatted_run(rows["conv_id"][at:end], [r.encode() for r in rows["role"][at:end]], [t.encode() for t in rows["text"][at:end]], assistant.encode())
                n = len(run["conv_id"])
                run["part"] = pa.array(np.arange(part, part + n), pa.int64())
                part, at = part + n, end
                yield pa.RecordBatch.from_arrays([run[c] for c in ("conv_id", "part", "n_turns", "formatted", "loss_start", "loss_chars")], names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_chars"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    return (
        rows.repartitionByRange("conv_id", "turn", "role")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(scan, FORMATTED)
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a part."""
    return [(unescape(role), unescape(text)) for role, text in _turn.findall(formatted)]


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the parts.

    Parts stream past in order; a task holds one batch and two running hashes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now: list | None = None

        def closed(x):
            return [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]

        done: list[list] = []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    if now is not None:
                        done.append(closed(now))
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in read_back(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for start, size in zip(row["loss_start"], row["loss_chars"]):
                    learnt = unescape(text[start : start + size])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode())
                now[5] += len(text)
            if done:
                yield pa.RecordBatch.from_pydict({c: [d[i] for d in done] for i, c in enumerate(names)}, schema=schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(names, closed(now))}, schema=schema)

    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    return (
        parts.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .mapInArrow(scan, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
