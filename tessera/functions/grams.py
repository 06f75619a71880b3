"""Hashes of all grams of a text at once, by doubling, and what they find.

A gram of 2k characters is hashed from its two halves, so that the hashes of all grams of 1, 2, 4, ...
characters take a few array operations each. Two different grams have one hash with a chance of about
2**-64; whoever needs certainty compares the texts.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np

U64 = np.uint64
SLICE = 1 << 20


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def levels(points: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """k and the hashes of all grams of k characters, for k = 1, 2, 4, ... up to ``most`` (and the text's length)."""
    k, h = 1, mixed(points.astype(U64) + U64(0x9E3779B97F4A7C15))
    while k <= most and len(h):
        yield k, h
        h = mixed(h[:-k] * U64(0xD1B54A32D192ED03) + h[k:]) if len(h) > k else h[:0]
        k *= 2


def selected(h: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the least of some ``window`` hashes in a row (a power of two).

    Which positions of a passage are selected depends on the passage alone, apart from its last and first ``window``
    - 1, and of any ``window`` in a row at least one is.
    """
    least, k = h, 1
    while k < window and len(least) > k:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if len(h) < window:
        return np.zeros(0, np.int64)
    # a position is selected if the greatest of its windows' minima is its own hash
    top = np.zeros(len(h) + window - 1, U64)
    top[window - 1 : window - 1 + len(least)] = least
    k = 1
    while k < window:
        top, k = np.maximum(top[:-k], top[k:]), 2 * k
    return np.flatnonzero(top[: len(h)] == h)


def _gram(length: int) -> int:
    return 1 << (length.bit_length() - 1)


class Places:
    """Where pieces occur in a text, found in one pass over it.

    A piece is known by its first and its last gram of the largest power of two that it holds; together they cover it.
    """

    def __init__(self, pieces: Collection[str], text: str, start: int = 0):
        self.text, self.number = text, {p: i for i, p in enumerate(dict.fromkeys(filter(None, pieces)))}
        names = list(self.number)
        length = np.array([len(p) for p in names], np.int64)
        gram = np.array([_gram(len(p)) for p in names], np.int64)
        first, last = _ends(names, length, gram)
        self.of, self.at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        groups = []
        for g in np.unique(gram).tolist():
            order = np.flatnonzero(gram == g)
            order = order[np.argsort(first[order], kind="stable")]
            filled = np.zeros(1 << 16, bool)
            filled[first[order] >> U64(48)] = True
            groups.append((g, order, first[order], last[order], length[order], filled))
        reach, most = int(length.max(initial=0)), int(gram.max(initial=0))
        for begin in range(start, len(text), SLICE):
            part = codes(text[begin : begin + SLICE + reach])
            hashes = {g: h for g, h in levels(part, most) if g in set(gram.tolist())}
            for g, *group in groups:
                if g in hashes:
                    self._meet(begin, len(part), g, hashes[g], *group)
        of, at = np.concatenate(self.of), np.concatenate(self.at)
        order = np.lexsort((at, of))
        self.of, self.at = of[order], at[order]
        self.bounds = np.searchsorted(self.of, np.arange(len(names) + 1))

    def _meet(self, begin: int, size: int, g: int, h: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray, length: np.ndarray, filled: np.ndarray) -> None:
        own = h[:SLICE]
        at = np.flatnonzero(filled[own >> U64(48)])
        low, high = np.searchsorted(first, own[at], "left"), np.searchsorted(first, own[at], "right")
        at, low, high = (x[low < high] for x in (at, low, high))
        while len(at):  # pieces that share their first gram, one after the other
            whole = at + length[low] <= size
            same = np.zeros(len(at), bool)
            same[whole] = h[at[whole] + length[low[whole]] - g] == last[low[whole]]
            self.of.append(order[low[same]])
            self.at.append(begin + at[same])
            more = low + 1 < high
            at, low, high = at[more], low[more] + 1, high[more]

    def next(self, piece: str, start: int) -> int:
        """The first place of the piece from ``start`` on, or -1."""
        i = self.number[piece]
        j, end = self.bounds[i] + np.searchsorted(self.at[self.bounds[i] : self.bounds[i + 1]], start), self.bounds[i + 1]
        while j < end and not self.text.startswith(piece, int(self.at[j])):
            j += 1
        return int(self.at[j]) if j < end else -1


def _ends(pieces: list[str], length: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each piece's first and last gram."""
    first, last = np.zeros(len(pieces), U64), np.zeros(len(pieces), U64)
    ends = np.cumsum(length)
    i = 0
    while i < len(pieces):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE)))
        points, start = codes("".join(pieces[i:j])), ends[i:j] - length[i:j]
        start = start - start[0]
        for g, h in levels(points, int(gram[i:j].max())):
            mine = np.flatnonzero(gram[i:j] == g)
            first[i + mine], last[i + mine] = h[start[mine]], h[start[mine] + length[i:j][mine] - g]
        i = j
    return first, last
