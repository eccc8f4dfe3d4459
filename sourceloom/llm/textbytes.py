"""Vectorised work on the UTF-8 bytes of many texts at once: an Arrow string column is one buffer with offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Letters and bytes of characters beyond ASCII.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = IS_LETTER[65:91] = IS_LETTER[128:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len + 1) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) with at most `most` bytes, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """batches cut into runs of rows with at most `most` bytes of text, or one longer text: what a function holds at a time."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        for i, j in chunks(offsets, most):
            yield batch.slice(i, j - i)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        step = np.full(size, BASE, np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers


def word_hashes(data: np.ndarray, inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, 64-bit hash) of the maximal runs of bytes where `inside` holds; runs also end at breaks."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = breaks[(breaks > 0) & (breaks < len(data))]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    position = np.arange(len(data), dtype=np.int64)
    owner = np.cumsum(first) - 1
    own = np.flatnonzero(inside)
    owner = owner[own]
    within = position[own] - starts[owner]
    term = BYTE[data[own]] * powers(int(within.max()) + 1)[within]
    edges = np.searchsorted(owner, np.arange(len(starts)))
    lengths = np.diff(np.append(edges, len(own)))
    return starts, lengths, mix(np.add.reduceat(term, edges) + lengths.astype(np.uint64))


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on from task to task."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
