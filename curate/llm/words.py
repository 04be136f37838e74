"""Words and hashes of many texts at once, as numpy arrays over one buffer of UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are polynomial
(a substring's hash is a difference of two prefix sums), with random 64-bit byte values and a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to this many bytes; a longer text comes alone.
CHUNK = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Polynomial hashes modulo 2**64 with an odd base, so that every power has an inverse."""

    def __init__(self, seed: int):
        self.base = int(_mixed(np.array([seed * 2 + 1], np.uint64))[0]) | 1
        self.byte = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.up = self.down = np.empty(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def rows(base, size):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                return np.cumprod(steps)

            self.up, self.down = rows(self.base, max(n, CHUNK + 2)), rows(pow(self.base, -1, 2**64), max(n, CHUNK + 2))
        return self.up[:n], self.down[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values times powers, one longer than the values."""
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(len(values) + 1)[0][:-1], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.powers(len(sums))[1][start])

    def windows(self, values: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of ``k`` values."""
        n = len(values) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        sums = self.sums(values)
        return _mixed((sums[k:] - sums[:-k]) * self.powers(len(sums))[1][:n])


def lower_ascii() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


def spaces() -> np.ndarray:
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    return gap


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def cuts(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, bytes, offsets) of runs of texts."""
    data, offsets = buffers(texts)
    for first, last in cuts(offsets, limit):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


class Words:
    """Start, end and hash of each word of some texts; ``first[d]`` is the first word of text ``d``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher | None, gap: np.ndarray, low: np.ndarray | None = None):
        if low is not None:
            data = low[data]
        inside = ~gap[data]
        full = offsets[1:] > offsets[:-1]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[offsets[:-1][full]] = inside[offsets[:-1][full]]
        ends[:-1] &= ~inside[1:]
        ends[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
        self.offsets = offsets
        self.data, self.start, self.end = data, np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.hash = hasher.spans(hasher.sums(hasher.byte[data]), self.start, self.end) if hasher else None

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int) -> np.ndarray:
        """Which words start a run of ``k`` words of one text."""
        left = np.repeat(self.first[1:], self.count) - np.arange(len(self.start))
        return left >= k
