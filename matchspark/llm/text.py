"""Words and their hashes for whole Arrow batches of text, as numpy arrays.

A batch is cut into pieces of about ``PIECE`` bytes at document borders, so memory is
bounded by a piece or the longest document.  Only A-Z are lower-cased.  ``WORD`` marks
the bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower-cased UTF-8 and ``SOLID``
those of ``[^\\x20\\x09-\\x0D]+``.  Null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
SOLID = np.ones(256, dtype=bool)
SOLID[9:14] = SOLID[32] = False

BASE = np.uint64(0x9E6C63D0876A9A63)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the 0th .. (n-1)th power, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE, dtype=np.uint64))])
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, n+1 offsets) for runs of rows of about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        _, ends, data = texts.buffers()
        offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total, mask) of lower-cased bytes."""
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets), inside


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text and the total)."""
    data = LOWER[data]
    starts, ends, bounds, inside = word_spans(data, offsets, kind)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        terms = (data[inside].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, at) + lengths.astype(np.uint64)), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    A text of fewer words is one shingle, the whole sequence; one without words has none.
    """
    words, bounds = word_hashes(data, offsets, SOLID)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            full += words[k : k + len(full)] * factors[k]
        full = mix(full + np.uint64(n))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= n:
                yield np.unique(full[a : b - n + 1])
            elif b > a:
                yield mix(np.array([np.sum(words[a:b] * factors[: b - a])], np.uint64) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)
