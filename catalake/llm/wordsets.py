"""Words and word shingles of Arrow text columns as 64-bit hashes, computed with numpy over whole batches.

Words are maximal runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z. UTF-8 bytes of other characters
are never white space, so bytes suffice. Text is handled in pieces of about a mebibyte, never cutting a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        full = np.full(max(n, PIECE + PIECE // 4), base, dtype=np.uint64)
        full[0] = 1
        known = np.multiply.accumulate(full)
        if len(known) <= 2 * PIECE:
            _powers[base] = known
    return known[:n]


def slices(column: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[pa.Array]:
    """Runs of rows of about ``size`` bytes, never cutting a text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    row = 0
    while row < len(column):
        done = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield column.slice(row, end - row)
        row = end


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of rows of about ``size`` bytes; a null text counts as empty."""
    for part in slices(column, size):
        part = pc.fill_null(part, "").cast(pa.large_string())
        _, places, data = part.buffers()
        offsets = np.frombuffer(places, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        yield data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return span_hashes(data, begin, end), np.searchsorted(begin, offsets)


class ByteHashes:
    """Hashes of spans of some bytes; equal spans have equal hashes wherever they are."""

    def __init__(self, data: np.ndarray):
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=self._sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        hashes = (self._sums[end] - self._sums[begin]) * _power(_INVERSE, len(self._sums))[begin]
        return mix(hashes + (end - begin).astype(np.uint64))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; equal spans have equal hashes wherever they are."""
    return ByteHashes(data).of(begin, end)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words of each text and the index of each text's first run.

    A text of fewer words has its whole sequence as one run; a text without words has none.
    """
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    start = np.concatenate([[0], np.cumsum(counts)])
    where = np.repeat(first[:-1] - start[:-1], counts) + np.arange(start[-1])
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    size = np.repeat(np.minimum(n, width), counts)
    total = np.zeros(start[-1], dtype=np.uint64)
    for place in range(width):
        total += np.where(size > place, padded[where + place] * _PLACES[place], np.uint64(0))
    return mix(total + size.astype(np.uint64) * _PLACES[63]), start


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column, in row order."""
    for data, offsets in pieces(column):
        values, start = shingle_hashes(*word_hashes(data, offsets), width)
        for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            part = np.sort(values[a:b])
            if b - a > 1:
                keep = np.empty(b - a, dtype=bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
            yield part
