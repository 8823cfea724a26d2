"""A worker's memory of what it has computed for a pre-token, by hash.

Texts repeat their pre-tokens; each is computed once per worker and then looked up by a
sorted array. When it holds more than ``limit`` entries, those that no later lookup has
found go (all entries, if those are too few), so it is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

import numpy as np


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make gives, kept by this worker until it runs an operator of another key."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Workers are used again by other operators: these let go of what the last one held."""
    _held.clear()


class Known:
    """Maps 64-bit hashes to runs of unsigned integers."""

    def __init__(self, compute: Callable[[list[bytes], np.ndarray], list], dtype, limit: int = 500_000):
        self._compute, self._dtype, self._limit = compute, dtype, limit
        self._clear()

    def _clear(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._at, self._size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._again = np.zeros(0, bool)
        self._flat, self._used = np.zeros(1 << 16, self._dtype), 0

    def _shrink(self) -> None:
        keep = np.flatnonzero(self._again)
        if 2 * len(keep) > self._limit:
            self._clear()
            return
        self._hashes, size = self._hashes[keep], self._size[keep]
        self._flat = gather(self._at[keep], size, self._flat)
        self._used = len(self._flat)
        self._at, self._size = np.cumsum(size, dtype=np.int64) - size, size
        self._again = np.zeros(len(keep), bool)

    def _add(self, hashes: np.ndarray, values: list) -> None:
        sizes = np.array([len(v) for v in values], np.int32)
        total = int(sizes.sum())
        if self._used + total > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros(max(len(self._flat), total), self._dtype)])
        self._flat[self._used : self._used + total] = np.fromiter((x for v in values for x in v), self._dtype, total)
        at = self._used + np.cumsum(sizes) - sizes
        self._used += total
        place = np.searchsorted(self._hashes, hashes)
        self._hashes = np.insert(self._hashes, place, hashes)
        self._at, self._size = np.insert(self._at, place, at), np.insert(self._size, place, sizes)
        self._again = np.insert(self._again, place, False)

    def look(self, hashes: np.ndarray, word: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each hash: where its run starts in the third result, and its length. word: the bytes of the i-th."""
        if len(self._hashes) > self._limit:
            self._shrink()
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self._hashes, unique)
        fresh = np.ones(len(unique), bool)
        fits = place < len(self._hashes)
        fresh[fits] = self._hashes[place[fits]] != unique[fits]
        self._again[place[~fresh]] = True
        new = np.flatnonzero(fresh)
        if len(new):
            self._add(unique[new], self._compute([word(i) for i in first[new].tolist()], first[new]))
            place = np.searchsorted(self._hashes, unique)
        return self._at[place][inverse], self._size[place][inverse], self._flat


def gather(at: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs one after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(at - (ends - size), size)]
