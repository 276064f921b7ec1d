"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D. Its 64-bit hash is a
polynomial over its bytes, taken as a difference of prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation: for operators that look at bare words.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i <= n."""
    key = str(base)
    if key not in _powers or len(_powers[key][0]) <= n:
        size = max(1 << 20, n + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[key] = tuple(both)
    return _powers[key]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Mixed hash of values[start:end] for every pair of bounds."""
    up, down = powers(len(values), base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of some texts: hash, bounds in bytes, and for each text its words' bounds."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(data: np.ndarray, bounds: np.ndarray, lower: bool = False, gap: np.ndarray = SPACE) -> Words:
    """data: bytes of the texts one after another; bounds: len(texts) + 1 offsets."""
    n = len(data)
    word = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & ~(before & ~edge[:n]))
    end = np.flatnonzero(word & ~(after & ~edge[1:])) + 1
    values = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    return Words(run_hashes(values, start, end), start, end, np.searchsorted(start, bounds))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts of up to ``limit``
    bytes; a longer text comes alone, whole."""
    data, bounds = texts_of(column)
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of every run of ``width`` words in one text."""
    n = len(words.hash)
    last = np.repeat(words.first[1:], words.counts) - width
    at = np.flatnonzero(np.arange(n) <= last)
    return at, run_hashes(words.hash, at, at + width, 0xD6E8FEB86659FD93 | 1)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
