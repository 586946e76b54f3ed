"""Numpy kernels over the words of many texts at once: boundaries, hashes, shingles.

Words are maximal runs of bytes other than space and 0x09-0x0D, which in UTF-8 equals
``[^\\x20\\x09-\\x0D]+`` over code points. All kernels take concatenated UTF-8 bytes and offsets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from threadloom.llm.common import mix

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BASE = 0x9E3779B97F4A7C15 | 1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n (BASE is odd, so it has an inverse)."""
    with np.errstate(over="ignore"):
        up = np.ones(n, np.uint64)
        up[1:] = BASE % (1 << 64)
        down = np.ones(n, np.uint64)
        down[1:] = pow(BASE, -1, 1 << 64)
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=solid[1:-1])
    first = np.zeros(len(data) + 1, bool)
    first[off[(off > 0) & (off < len(data))]] = True  # a text's first byte begins a word even after a word
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    return start, end, np.searchsorted(start, off)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, from one running sum of polynomial terms."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes; the result has size - 1 fewer values."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ words[k:k + n]) * GOLDEN
            out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles (lower-cased A-Z).

    A text with fewer than ``size`` words has its whole sequence as its one shingle; one without
    words has none.
    """
    start, end, at = word_spans(data, off)
    words = span_hash(LOWER[data], start, end)
    shingles = window_hash(words, size)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(shingles[lo:hi - size + 1]))
        elif hi > lo:
            short = window_hash(words[lo:hi], hi - lo)
            out.append(mix(short + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def counts_per(at: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each range [at[i], at[i + 1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated_words(words: np.ndarray, at: np.ndarray, size: int = 8) -> np.ndarray:
    """For each text, how many words lie in a ``size``-word window found twice or more in it."""
    windows = window_hash(words, size)
    out = np.zeros(len(at) - 1, np.int64)
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        n = hi - lo - size + 1
        if n < 2:
            continue
        own = windows[lo:lo + n]
        order = np.sort(own)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            continue
        mark = np.zeros(hi - lo + 1, np.int64)
        hit = np.flatnonzero(np.isin(own, twice))
        mark[hit] += 1
        np.subtract.at(mark, hit + size, 1)
        out[i] = int((np.cumsum(mark[:-1]) > 0).sum())
    return out
