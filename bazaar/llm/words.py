"""Word and shingle hashes of whole Arrow text columns, vectorised.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]`` of the UTF-8 text
with A-Z lower-cased, so byte and code point definitions agree. Texts go
through in slices of whole rows, which bounds the memory of the temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than letters and digits: separators of plain words.
_OTHER = np.zeros(256, bool)
_OTHER[:128] = [not chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_ODD = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that all bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]))
    return _powers


class Words(NamedTuple):
    """Words of rows ``first`` to ``first + len(ptr) - 2`` of a column; the
    words of row i are those from ``ptr[i]`` to ``ptr[i + 1]``. ``starts`` and
    ``ends`` are byte positions in the slice, ``base`` those of its rows."""
    first: int
    ptr: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    base: np.ndarray
    data: np.ndarray


def rows_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return off.astype(np.int64), (np.frombuffer(data, np.uint8) if data is not None
                                  else np.zeros(0, np.uint8))


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row offsets from 0, bytes) of runs of whole rows of at most
    SLICE_BYTES, or of one longer row."""
    off, data = rows_of(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        yield at, off[at:to + 1] - off[at], data[off[at]:off[to]]
        at = to


def words_of(column: pa.Array | pa.ChunkedArray, plain: bool = False) -> Iterator[Words]:
    """Words of a column, slice by slice; ``plain`` words also end at ASCII
    punctuation."""
    apart = _OTHER if plain else _SPACE
    for first, base, data in slices(column):
        if not len(data):
            none = np.zeros(0, np.int64)
            yield Words(first, np.zeros(len(base), np.int64), none.astype(np.uint64), none, none,
                        base, data)
            continue
        word = ~apart[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[base] = True
        starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]) | word & cut[:-1])
        after = np.concatenate([~word[1:], [True]])
        ends = np.flatnonzero(word & (after | cut[1:])) + 1
        lens = ends - starts
        at = np.cumsum(lens) - lens
        inside = data[word]
        place = np.arange(len(inside)) - np.repeat(at, lens)
        value = _BYTE_LOWER[inside]
        value *= _power(int(lens.max()) if len(lens) else 1)[place]
        hashes = mix(np.add.reduceat(value, at)) if len(at) else np.zeros(0, np.uint64)
        yield Words(first, np.searchsorted(starts, base), hashes, starts, ends, base, data)
    # Workers live on for other tasks: give back what this column took.
    pa.default_memory_pool().release_unused()


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total += hashes[i:len(hashes) - n + 1 + i] * _ODD[i]
    return mix(total)


def shingle_rows(w: Words, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its number in the column and its sorted distinct n-word
    shingle hashes; a row of fewer words has its whole sequence as one, a row
    without words none."""
    grams = ngrams(w.hashes, n)
    for i in range(len(w.ptr) - 1):
        lo, hi = int(w.ptr[i]), int(w.ptr[i + 1])
        if hi - lo >= n:
            yield w.first + i, np.unique(grams[lo:hi - n + 1])
        elif hi > lo:
            yield w.first + i, ngrams(w.hashes[lo:hi], hi - lo) ^ np.uint64(hi - lo)
        else:
            yield w.first + i, np.zeros(0, np.uint64)
