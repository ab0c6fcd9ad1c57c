"""Words of Arrow string batches by numpy, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Words are named by a 64-bit
fingerprint: with n distinct words, about n * n / 2**65 pairs share one (10**9 words: 0.03 pairs).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE[_SPACE] = 0
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_power = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _power
    if len(_power) < n:
        size = max(n, 2 * len(_power), 1024)
        steps = np.full(size, _BASE % (1 << 64), np.uint64)
        steps[0] = 1
        _power = np.multiply.accumulate(steps)
    return _power


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (and the last ends); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n, at = len(texts), texts.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    """start, end: byte places of each word in data; first: of each document, its first word's index (and, last, the number of words)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    ink = ~_SPACE[data]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = ink[edge]
    ends[edge - 1] = ink[edge - 1]
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def fingerprints(w: Words) -> np.ndarray:
    """A 64-bit value for each word, equal for equal lower-cased words; never 0."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    lo = w.start[0]
    at = np.arange(lo, len(w.data)) - np.repeat(w.start, np.diff(np.append(w.start, len(w.data))))
    value = _VALUE[w.data[lo:]] * powers(int(at.max()) + 1)[at]
    h = mix(np.add.reduceat(value, w.start - lo))
    h[h == 0] = 1
    return h


def slices(n_bytes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together, at least one row each."""
    ends = np.cumsum(n_bytes)
    i = 0
    while i < len(ends):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield i, j
        i = j


def batches(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """The words of the rows, in slices of bounded size."""
    data, offsets = raw(texts)
    for i, j in slices(np.diff(offsets), most):
        yield i, j, split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
