"""Vectorised words, rolling window hashes and byte slices over Arrow string batches.

All functions work on whole texts. A batch is cut into chunks of about ``CHUNK`` bytes
at document ends, so the memory in use does not depend on the batch; a single longer
document is one chunk. A word's hash is a chain of bijective mixing steps over its 8-byte
pieces and its length, or from ``LONG`` bytes on a cryptographic digest, so no pattern of
bytes makes words collide; each seed gives another hash. Runs of words have polynomial hashes
(mod 2**64) of these. All are the same in every process.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18

#: Gives memory that NumPy has freed back to the system, where the C library can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)

_U = np.uint64
#: Odd bases of runs of words by seed, with their inverses mod 2**64.
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes from which on a word is hashed by a digest.
LONG = 128

#: Bytes that separate words, by the name of the word rule.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: 1 ASCII letters and digits, 2 ASCII marks but for the apostrophe and the bar, 0 the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"]] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Cumulative powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self._base, self._inverse, self._n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self._n:
            size = max(n, CHUNK + 2)
            tables = []
            for b in (self._base, self._inverse):
                t = np.full(size, b, np.uint64)
                t[0] = 1
                tables.append(np.cumprod(t))
            if size > CHUNK + 2:  # kept only when it is of the usual size
                return tuple(tables)
            self._up, self._down = tables
            self._n = size
        return self._up[:n], self._down[:n]


_POWERS = tuple(map(_Powers, _BASES))


def chunks(array: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, document offsets) over an Arrow string array; null is empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    pa.default_memory_pool().release_unused()
    _trim(0)


class Words:
    """The words of one chunk: byte places, 64-bit hashes, and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False, cut: bool = False):
        """lower: in ASCII. cut: also between an ASCII letter or digit and an ASCII mark but ' and |."""
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        size = len(data)
        inside = ~separators[self.data]
        before = np.zeros(size, bool)
        before[1:] = inside[:-1]
        cuts = offsets[offsets < size]
        before[cuts] = False
        if cut:
            kind = _KIND[self.data]
            turn = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1
            before[turn] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(size, bool)
        after[:-1] = inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        after[ends] = False
        if cut:
            after[turn - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: first[d] : first[d + 1] are the words of document d of the chunk.
        self.first = np.searchsorted(self.starts, offsets)
        self.n = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word's bytes; those of different seeds are independent."""
        size = self.ends - self.starts
        h = mix(size.astype(np.uint64) + _U((0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF))
        if not len(h):
            return h
        raw = np.concatenate([self.data, np.zeros(8, np.uint8)])
        pieces = np.ndarray((len(self.data) + 1,), "<u8", raw, strides=(1,))
        live, k = np.flatnonzero(size < LONG), 0
        while len(live):
            piece = pieces[self.starts[live] + k]
            rest = size[live] - k
            short = rest < 8
            piece[short] &= (_U(1) << (rest[short].astype(np.uint64) * _U(8))) - _U(1)
            h[live] = mix(h[live] ^ piece)
            k += 8
            live = live[rest > 8]
        for i in np.flatnonzero(size >= LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8, salt=bytes([seed])).digest(), "little")
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


class Rolling:
    """Hashes of runs of words, from a prefix sum; each seed has a base of its own."""

    def __init__(self, hashes: np.ndarray, seed: int = 0):
        n = len(hashes) + 1
        up, self._down = _POWERS[seed].upto(n)
        self._total = np.zeros(n, np.uint64)
        np.cumsum(hashes * up[:-1], out=self._total[1:])

    def at(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        raw = (self._total[starts + length] - self._total[starts]) * self._down[starts]
        return mix(raw + np.asarray(length).astype(np.uint64) * _U(0xA24BAED4963EE407))


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """The places at which ``length`` consecutive words of one document start."""
    n = np.diff(first)
    room = np.maximum(n - length + 1, 0)
    base = np.cumsum(room) - room
    return np.repeat(first[:-1] - base, room) + np.arange(int(room.sum()))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        k = width - have
        out = pick(out[: len(out) - k], out[k:])
    return out


def covered(starts: np.ndarray, lengths: int | np.ndarray, size: int) -> np.ndarray:
    """Marks the words that runs cover."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return np.cumsum(marks[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
