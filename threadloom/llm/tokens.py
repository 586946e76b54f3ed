"""Encoding through distinct pieces: a task looks up each piece of text once and gathers its ids.

Texts are mostly pieces (words) that were seen before. ``PieceCodes`` numbers pieces as they come,
encodes the new ones together, and turns whole batches of texts into flat ids with numpy gathers.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

MAX_PIECES = 1_000_000  # pieces a worker remembers; beyond it the memory starts anew, results are the same


def ragged_take(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenate pool[start[i]:start[i] + length[i]] over i."""
    total = int(length.sum())
    shift = np.cumsum(length) - length
    return pool[np.repeat(start - shift, length) + np.arange(total)]


class PieceCodes(dict):
    """A dict that numbers unseen pieces; ``encode`` maps a list of pieces to a list of id arrays."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]]):
        super().__init__()
        self._encode = encode
        self._fresh: list = []
        self._start = np.zeros(0, np.int64)
        self._length = np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.uint32)

    def __missing__(self, piece):
        code = self[piece] = len(self)
        self._fresh.append(piece)
        return code

    def ids(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (each a list of pieces) and the number of ids of each text."""
        if len(self) > MAX_PIECES:
            self.clear()
            self._start = self._start[:0]
            self._length = self._length[:0]
            self._pool = self._pool[:0]
        counts = np.array([len(t) for t in texts], np.int64)
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if self._fresh:
            flat, lengths = self._encode(self._fresh)
            self._start = np.concatenate([self._start, len(self._pool) + np.cumsum(lengths) - lengths])
            self._length = np.concatenate([self._length, lengths])
            self._pool = np.concatenate([self._pool, flat])
            self._fresh = []
        length = self._length[codes]
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        at = np.concatenate([[0], np.cumsum(counts)])
        return ragged_take(self._pool, self._start[codes], length), np.diff(total[at])
