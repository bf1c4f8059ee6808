"""Vectorised word hashing over Arrow string columns.

Texts stay UTF-8 bytes in one buffer. A word is a run of bytes that are not separators; since all
separators are ASCII this never cuts a character. Word hashes come from one cumulative sum, so the cost is a
few numpy passes over the bytes, whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _power_tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < count:
        _tables["up"] = _powers(_BASE, count)
        _tables["down"] = _powers(_INVERSE, count)
    return _tables["up"], _tables["down"]


class Alphabet:
    """Which bytes belong to words, and the value each byte adds to a hash."""

    def __init__(self, separators: bytes, lower: bool):
        self.inside = np.ones(256, dtype=bool)
        self.inside[np.frombuffer(separators, dtype=np.uint8)] = False
        fold = np.arange(256, dtype=np.uint64)
        if lower:
            fold[65:91] += np.uint64(32)
        self.value = mix64((fold + np.uint64(1)) * np.uint64(_ODD))


#: Words as [^\x20\x09-\x0D]+, A-Z folded.
SPACED = Alphabet(b"\x20\x09\x0a\x0b\x0c\x0d", lower=True)
#: Words of letters and non-ASCII characters only, A-Z folded.
LETTERS = Alphabet(bytes(b for b in range(128) if not chr(b).isalpha()), lower=True)
#: Words of letters, digits and non-ASCII characters, A-Z folded.
ALNUM = Alphabet(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows [i, j) of at most ``most`` bytes together, or one longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of a block of texts: ``hash`` and byte ``start``/``end`` of each, and ``first[d]`` = index of the first
    word of text d (with a final total)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
        size = len(data)
        self.data, self.offsets = data, offsets
        if size == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        inside = alphabet.inside[data]
        before = np.empty(size, bool)
        before[0] = False
        before[1:] = inside[:-1]
        heads = offsets[:-1]
        before[heads[heads < size]] = False
        after = np.empty(size, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        tails = offsets[1:]
        after[tails[tails > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        up, down = _power_tables(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(alphabet.value[data] * up[:size], out=sums[1:])
        self._sums, self._down = sums, down
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix64(raw + (self.end - self.start).astype(np.uint64) * np.uint64(_ODD))
        self.first = np.searchsorted(self.start, offsets)

    def stems(self, width: int) -> np.ndarray:
        """Hash of the first ``width`` bytes of each word (of all of a shorter one), unlike any word's own hash."""
        if len(self.start) == 0:
            return np.zeros(0, np.uint64)
        size = np.minimum(self.end - self.start, width)
        raw = (self._sums[self.start + size] - self._sums[self.start]) * self._down[self.start]
        return mix64(raw ^ np.uint64(0x5851F42D4C957F2D))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values; the caller drops runs across texts."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    count = len(hashes) - width + 1
    total = np.full(count, np.uint64(width), np.uint64)
    for k in range(width):
        total = total * np.uint64(_BASE) + hashes[k : k + count] * np.uint64(2 * k + 3)
        total ^= total >> np.uint64(29)
    return mix64(total)


def sequence_hash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of each slice hashes[first[i]:first[i + 1]]; empty slices give equal values."""
    up, down = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    if len(hashes):
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    raw = (sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]]
    return mix64(raw + np.diff(first).astype(np.uint64) * np.uint64(_ODD))
