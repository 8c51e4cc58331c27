"""Words of many texts at once, as NumPy arrays.

A word is a maximal run of characters other than space and U+0009 to U+000D.
Those are single bytes in UTF-8 and never part of another character, so words
are found in the bytes of an Arrow column without decoding it.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The separators, for regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _SAME.copy()
_LOWER[ord("A") : ord("Z") + 1] = _SAME[ord("a") : ord("z") + 1]
#: Words hashed in one go; bounds the working memory for long texts.
_WORDS_AT_ONCE = 200_000
#: Bytes of text that :func:`slices` puts together.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit values."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + start) | np.uint64(1)


@dataclass
class Words:
    """The words of a block of texts.

    ``data`` are the bytes; word ``i`` is ``data[starts[i]:ends[i]]``; the words
    of text ``d`` are ``first[d]`` to ``first[d + 1]``.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False, seed: int = 1) -> np.ndarray:
        """A 64-bit hash per word; ``lower`` folds A to Z."""
        values = _LOWER if lower else _SAME
        out = np.empty(len(self.starts), np.uint64)
        longest = int((self.ends - self.starts).max(initial=0))
        weights = keys(longest, seed)
        for a in range(0, len(out), _WORDS_AT_ONCE):
            starts, ends = self.starts[a : a + _WORDS_AT_ONCE], self.ends[a : a + _WORDS_AT_ONCE]
            low, high = int(starts[0]), int(ends[-1])
            block = self.data[low:high]
            place = np.arange(low, high) - np.repeat(starts, np.diff(np.append(starts, high)))
            space = _IS_SPACE[block]
            place[space] = 0
            terms = values[block] * weights[place]
            terms[space] = 0
            out[a : a + _WORDS_AT_ONCE] = np.add.reduceat(terms, starts - low)
        return mix(out)


def words_of(texts: pa.Array) -> Words:
    """Find the words of each text; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_IS_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


class Numbers:
    """Numbers kept by 64-bit hashes, in a table with open addressing that stays half free. The hashes are odd."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.hashes, self.numbers = np.zeros(1 << bits, np.uint64), np.empty(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.hashes[at]
        found = np.where(there == hashes, self.numbers[at], -1)
        left = np.flatnonzero((found < 0) & (there > 0))
        while len(left):
            at[left] = (at[left] + 1) % len(self.hashes)
            there = self.hashes[at[left]]
            hit = there == hashes[left]
            found[left[hit]] = self.numbers[at[left[hit]]]
            left = left[~hit & (there > 0)]
        return found

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Keep new, distinct hashes; of several that want a free slot one gets it."""
        self.n += len(hashes)
        if 2 * self.n > len(self.hashes):
            used = np.flatnonzero(self.hashes)
            hashes, numbers = np.append(self.hashes[used], hashes), np.append(self.numbers[used], numbers)
            self.bits = (2 * self.n).bit_length()
            self.hashes, self.numbers = np.zeros(1 << self.bits, np.uint64), np.empty(1 << self.bits, np.int32)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.hashes[at] == 0
            self.hashes[at[free]] = hashes[free]
            won = self.hashes[at] == hashes
            self.numbers[at[won]] = numbers[won]
            hashes, numbers, at = hashes[~won], numbers[~won], (at[~won] + 1) % len(self.hashes)


def give_back() -> None:
    """Return to the system what earlier tasks of this Python worker left free."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def giving_back(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``read``, then :func:`give_back`, when nothing of the task is held any more: idle Python workers stay beside those of later stages."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from read(parts)
        give_back()

    return run


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text each, without copying."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash for each run of ``width`` neighbouring words; runs across texts are for the caller to drop."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    base = int(keys(1, seed)[0])
    inverse = pow(base, -1, 1 << 64)
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers, out=sums[1:])
    back = np.full(n - width + 1, inverse, np.uint64)
    back[0] = 1
    return mix((sums[width:] - sums[:-width]) * np.multiply.accumulate(back))


def inside_text(first: np.ndarray, width: int) -> np.ndarray:
    """Which starts of :func:`windows` lie with all their words in one text."""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))
    return (np.arange(n) + width <= last)[: max(0, n - width + 1)]
