"""Fill-in-middle: texts cut at two token boundaries and put together in another order.

A token is a run of A-Z and a-z, or any other single code point.  The token starts of a piece
of text are one ``BoundarySet``: positions in chunks of 2**16, each chunk an array, a bitmap
or a list of runs, whichever is smallest, with cumulative cardinalities over the chunks.  The
starts before a document's first byte are its base rank; a cut after u tokens is the member of
rank base + u, found by a search for its container and a select inside it.

The cuts and the form of a document come from the sha256 of ``salt`` and its id, so a rerun
agrees.  ``plain`` leaves the text as it is: for empty texts, texts that hold a marker, and
the share ``plain_from`` of the others; of the rest ``spm_below`` per cent take the form spm.

Null text is empty; a null id counts as empty text.  Equal ids cut their texts by the same
numbers, each row by its own text.  Extra columns are not read.  Memory is bounded by a piece
of some megabytes or the longest text, with a few bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
CHUNK = 1 << 16
#: Members up to which an array takes no more bytes than a bitmap.
ARRAY_MOST = 4096


class ArrayContainer:
    """Sorted 16-bit members."""

    def __init__(self, members: np.ndarray):
        self.members = members.astype(np.uint16)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        return self.members[ranks].astype(np.int64)

    def rank(self, below: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.members, below)


class RunContainer:
    """First members and lengths of runs of consecutive members."""

    def __init__(self, members: np.ndarray, first: np.ndarray):
        self.starts = members[first]
        self.before = np.append(first, len(members))

    def select(self, ranks: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, ranks, "right") - 1
        return self.starts[run] + ranks - self.before[run]

    def rank(self, below: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.starts, below) - 1
        inside = np.minimum(below - self.starts[run], np.diff(self.before)[run])
        return np.where(run < 0, 0, self.before[run] + inside)


class BitmapContainer:
    """2**16 bits as words, and the members before each word."""

    def __init__(self, mask: np.ndarray):
        bits = np.zeros(CHUNK, bool)
        bits[: len(mask)] = mask
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def _bits(self, words: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.words[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    def select(self, ranks: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, ranks, "right") - 1
        seen = np.cumsum(self._bits(word), axis=1)
        return 64 * word + (seen > (ranks - self.before[word])[:, None]).argmax(axis=1)

    def rank(self, below: np.ndarray) -> np.ndarray:
        word = np.minimum(below >> 6, len(self.words) - 1)
        bits = self._bits(word) * (np.arange(64) < (below - 64 * word)[:, None])
        return self.before[word] + bits.sum(axis=1, dtype=np.int64)


class BoundarySet:
    """Positions of the true places of a mask, with ``rank`` and ``select`` over many at once."""

    def __init__(self, mask: np.ndarray):
        self.keys: list[int] = []
        self.containers: list[ArrayContainer | RunContainer | BitmapContainer] = []
        counts = [0]
        for at in range(0, len(mask), CHUNK):
            members = np.flatnonzero(mask[at : at + CHUNK])
            if not len(members):
                continue
            first = np.flatnonzero(np.diff(members, prepend=-2) != 1)
            if 4 * len(first) <= 2 * min(len(members), ARRAY_MOST):
                container = RunContainer(members, first)
            elif len(members) <= ARRAY_MOST:
                container = ArrayContainer(members)
            else:
                container = BitmapContainer(mask[at : at + CHUNK])
            self.keys.append(at // CHUNK)
            self.containers.append(container)
            counts.append(len(members))
        self.chunks = np.array(self.keys, np.int64)
        self.before = np.cumsum(counts, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The members of these ranks (from 0, below the size)."""
        at = np.searchsorted(self.before, ranks, "right") - 1
        out = np.empty(len(ranks), np.int64)
        for c in np.unique(at).tolist():
            which = at == c
            out[which] = self.keys[c] * CHUNK + self.containers[c].select(ranks[which] - self.before[c])
        return out

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """How many members lie before each position."""
        chunk = positions // CHUNK
        at = np.searchsorted(self.chunks, chunk)
        out = self.before[at].copy()
        present = at < len(self.chunks)
        present[present] = self.chunks[at[present]] == chunk[present]
        for c in np.unique(at[present]).tolist():
            which = present & (at == c)
            out[which] += self.containers[c].rank(positions[which] - self.keys[c] * CHUNK)
        return out


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask of the bytes at which tokens start; every text starts anew."""
    letter = (data | np.uint8(32)) - np.uint8(97) < 26
    start = (data & np.uint8(0xC0)) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return start


def _numbers(salt: str, keys: list) -> list[tuple[int, ...]]:
    """The first four groups of eight hex digits of each id's hash."""
    digests = (hashlib.sha256(f"{salt}{'' if k is None else k}".encode()).hexdigest() for k in keys)
    return [tuple(int(d[i : i + 8], 16) for i in (0, 8, 16, 24)) for d in digests]


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    salt: str = "1:",
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
) -> DataFrame:
    """Per document: key, n (tokens), form, prefix_chars, middle_chars (null where plain), output (the new text).

    An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            boundaries = BoundarySet(token_starts(data, offsets))
            base = boundaries.rank(offsets)
            n = np.diff(base)
            hashes = _numbers(salt, part.column("name").to_pylist())
            cuts = np.array([sorted((h[0] % (u + 1), h[1] % (u + 1))) for h, u in zip(hashes, n.tolist())], np.int64).reshape(-1, 2)
            ranks = base[:-1, None] + cuts
            places = np.repeat(offsets[1:, None], 2, axis=1)
            inner = cuts < n[:, None]
            places[inner] = boundaries.select(ranks[inner])
            lead = (data & np.uint8(0xC0)) != 0x80
            raw = memoryview(np.ascontiguousarray(data))
            forms, prefixes, middles, outputs = [], [], [], []
            for i, h in enumerate(hashes):
                a, b = int(offsets[i]), int(offsets[i + 1])
                x, y = places[i].tolist()
                whole = bytes(raw[a:b])
                if not whole or h[2] % 100 >= plain_from or any(m in whole for m in markers):
                    form, joined = "plain", whole
                elif h[3] % 100 < spm_below:
                    form, joined = "spm", b"".join([markers[1], raw[y:b], markers[0], raw[a:x], markers[2], raw[x:y]])
                else:
                    form, joined = "psm", b"".join([markers[0], raw[a:x], markers[1], raw[y:b], markers[2], raw[x:y]])
                forms.append(form)
                prefixes.append(None if form == "plain" else int(np.count_nonzero(lead[a:x])))
                middles.append(None if form == "plain" else int(np.count_nonzero(lead[x:y])))
                outputs.append(joined)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array(n, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(prefixes, pa.int64()),
                    pa.array(middles, pa.int64()),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(scan, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.

    A text in form psm or spm holds no marker, and no marker starts with the end of another,
    so the markers of the output are those that were put there.
    """
    parts = F.split(output, "<[PSM]>", -1)
    joined = lambda *order: F.concat(*[F.element_at(parts, i) for i in order])
    return F.when(form == "psm", joined(2, 4, 3)).when(form == "spm", joined(3, 4, 2)).otherwise(output)
