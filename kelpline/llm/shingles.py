"""Words and word shingles of texts as 64-bit hashes, in numpy.

A word is a longest run of letters and digits, lower-cased. A text of fewer than ``WIDTH`` words has one shingle, all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import CharClass, slices

WIDTH = 5
#: Code points that one numpy pass holds; a longer text is one pass of its own.
PIECE = 1 << 19
#: Letters and numbers of any plane.
_WORD = CharClass(str.isalnum)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)])


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, row) in text order."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    is_word = _WORD(codes)
    edge = np.diff(np.r_[False, is_word, False].astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(is_word)
    lengths = stops - starts
    within = at - np.repeat(starts, lengths)
    powers = _powers(0xD6E8FEB86659FD93, int(lengths.max()))
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    hashes = np.add.reduceat((codes[at].astype(np.uint64) + np.uint64(1)) * _M1 * powers[within], first)
    return mixed(hashes + lengths.astype(np.uint64)), np.searchsorted(ends, starts, "right")


def shingled(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of ``texts``: first row, rows, shingle hashes sorted within each row, their rows, words a row and two hashes of all words a row."""
    for a, b in slices([len(t or "") + 1 for t in texts], PIECE):
        n = b - a
        w, row = words(texts[a:b])
        count = np.bincount(row, minlength=n)
        start = np.r_[0, np.cumsum(count)[:-1]]
        place = np.arange(len(w)) - start[row] if len(w) else np.zeros(0, np.int64)
        keys = []
        for base in (0xD1342543DE82EF95, 0xAEF17502108EF2D9):
            sums = np.zeros(n, np.uint64)
            if len(w):
                filled = np.flatnonzero(count)
                sums[filled] = np.add.reduceat(w * _powers(base, int(count.max()))[place], start[filled])
            keys.append(mixed(sums + count.astype(np.uint64)))
        h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(w):
            p = _powers(0xDA942042E4DD58B5, WIDTH)
            full = np.flatnonzero(place + WIDTH <= count[row])
            h = sum((w[full + k] * p[k] for k in range(1, WIDTH)), w[full])
            few = np.flatnonzero((count > 0) & (count < WIDTH))
            h, of = mixed(np.r_[h, keys[0][few]]), np.r_[row[full], few]
            if len(few):
                order = np.argsort(of, kind="stable")
                h, of = h[order], of[order]
            cuts = np.r_[0, np.cumsum(np.bincount(of, minlength=n))]
            for i in range(n):
                h[cuts[i] : cuts[i + 1]].sort()
        yield a, n, h, of, count, keys[0], keys[1]


def weighted(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, times it occurs there) of hashes sorted within rows."""
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new], of[new], np.diff(np.r_[new, len(h)])
