"""Words, word hashes and shingles of a whole Arrow batch of texts at once.

A batch is cut into slices of whole texts of about ``SLICE`` bytes (a longer
text is a slice of its own), so that memory is bounded by the slice and the
longest text, whatever the batch, and is given back after each batch. Hashes have 64 bits: a polynomial over random
byte values modulo 2**64 from prefix sums, then a finaliser. Two given
different words or shingles collide with a chance of about 2**-60.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the word."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


SPACE = _table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-case
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)
#: first bytes of code points
POINT = _table(lambda b: b & 0xC0 != 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)])


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and its inverses, grown by doubling."""
    while len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = _powers[i]
            _powers[i] = np.concatenate([p, p * U64(pow(base, len(p), 1 << 64))])
    return _powers[0][: n + 1], _powers[1][: n + 1]


@dataclass
class Texts:
    """Consecutive texts of a batch: ``bounds[i]:bounds[i+1]`` are the bytes of text i."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def segments(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes where ``inside``; no run crosses a text's end."""
        n = len(inside)
        begins = self.bounds[:-1]
        begins = begins[begins < n]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[begins] = False
        after[begins[begins > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """The text that each byte position belongs to."""
        return np.searchsorted(self.bounds[1:], starts, "right")

    def totals(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        sums = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Of the byte ranges, in stretches of about a slice, so that a very long text takes no more memory."""
        table = _BYTE[_LOWER] if lower else _BYTE
        if len(self.data) <= 2 * SLICE:
            return mix(_sums(table[self.data], starts, ends))
        order = np.argsort(starts, kind="stable")
        begin, out, i = starts[order], np.zeros(len(starts), U64), 0
        while i < len(order):
            base = begin[i]
            some = order[i : int(np.searchsorted(begin, base + SLICE, "right"))]
            long = ends[some] - base > 2 * SLICE
            for k in some[long]:
                out[k] = _long(table, self.data[starts[k] : ends[k]])
            short = some[~long]
            if len(short):
                out[short] = _sums(table[self.data[base : ends[short].max()]], starts[short] - base, ends[short] - base)
            i += len(some)
        return mix(out)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial sums of ranges of values."""
    n = len(values)
    if not n:
        return np.zeros(len(starts), U64)
    up, down = _power(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def _long(table: np.ndarray, data: np.ndarray) -> np.uint64:
    """The polynomial sum of one long range, piece by piece."""
    up, _ = _power(SLICE)
    total = 0
    for at in range(0, len(data), SLICE):
        part = table[data[at : at + SLICE]]
        total += int((part * up[: len(part)]).sum(dtype=U64)) * pow(_BASE, at, 1 << 64)
    return U64(total % (1 << 64))


@dataclass
class Words:
    """Hashes of all words; ``bounds[i]:bounds[i+1]`` are the words of text i."""

    hashes: np.ndarray
    bounds: np.ndarray
    owner: np.ndarray

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which k words of one text follow each other, and the hashes of those k."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.owner[:n] == self.owner[k - 1 :])
        return at, roll(self.hashes, at, k)


def roll(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on, in order."""
    out = np.full(len(at), k, U64)
    for j in range(k):
        out = out * U64(_BASE) + hashes[at + j]
    return mix(out)


def texts(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Texts]:
    """The texts of an Arrow string column in slices; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield Texts(whole[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i)
        i = j
    del column, data, whole, bounds
    release()


def release() -> None:
    """Give memory that a batch has freed back to the system: a worker is kept for later tasks, and several are."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def words_of(t: Texts, lower: bool = True) -> Words:
    """Lower-cased alphanumeric words, or those between white space as they are."""
    starts, ends = t.segments(ALNUM[t.data] if lower else ~SPACE[t.data])
    owner = t.owner(starts)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(t)))])
    return Words(t.hashes(starts, ends, lower), bounds, owner)


def word_hash(word: str) -> int:
    """The hash that ``words_of`` gives to one lower-cased word."""
    t = next(texts(pa.array([word])))
    return int(t.hashes(np.array([0]), np.array([len(t.data)]), True)[0])
