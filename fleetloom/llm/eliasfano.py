"""Monotone sequences in the form of Elias and Fano, as plain arrays that can lie in a memory map.

Of ``n`` values up to ``u`` the low ``log2(u / n)`` bits are packed side by side; the rest is written in
unary, a one for each value after as many zeros as its high part, in ``2 n`` bits. A running count of
ones for each word of 64 bits finds the k-th one or zero. All queries take arrays of numbers at once.
"""

from __future__ import annotations

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: ``_SELECT[byte, k]``: where the k-th one of a byte is.
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)
_ZERO, _ONE, _64 = np.uint64(0), np.uint64(1), np.uint64(64)


def _packed(low: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each number, side by side."""
    words = np.zeros(len(low) * width // 64 + 2, dtype=np.uint64)
    if not width or not len(low):
        return words
    at = np.arange(len(low), dtype=np.uint64) * np.uint64(width)
    word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(low << off, first)
    over = np.flatnonzero(off + np.uint64(width) > _64)  # at most one of a word runs over into the next
    words[word[over] + 1] |= low[over] >> (_64 - off[over])
    return words


class EliasFano:
    """A sequence of ``n`` numbers that never fall, none above ``most``."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.width, self.low, self.high, self.before = n, width, low, high, before
        self._zeros = None

    @classmethod
    def of(cls, values: np.ndarray, most: int) -> EliasFano:
        values = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(values)
        width = max(0, (int(most) // max(n, 1)).bit_length() - 1)
        top = values >> np.uint64(width) if width < 64 else np.zeros(n, np.uint64)
        size = n + (int(most) >> width) + 1
        flags = np.zeros(-(-(size + 1) // 64) * 64, dtype=bool)
        flags[top.astype(np.int64) + np.arange(n)] = True
        high = np.packbits(flags, bitorder="little").view("<u8").astype(np.uint64)
        before = np.zeros(len(high) + 1, dtype=np.uint32 if n < 1 << 32 else np.uint64)
        np.cumsum(np.bitwise_count(high), out=before[1:])
        low = values & np.uint64((1 << width) - 1)
        return cls(n, width, _packed(low, width), high, before)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], dtype=np.int64), self.low, self.high, self.before]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> EliasFano:
        n, width = map(int, arrays[0])
        return cls(n, width, *arrays[1:])

    def _in_word(self, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where the k-th one of each word is."""
        parts = words.astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.uint8)
        part = (counts <= k[:, None]).sum(axis=1)
        rows = np.arange(len(words))
        k = k - np.where(part > 0, counts[rows, part - 1], 0)
        return part * 8 + _SELECT[parts[rows, part], k]

    def _one(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, side="right") - 1
        return word * 64 + self._in_word(self.high[word], k - self.before[word].astype(np.int64))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        if self._zeros is None:
            self._zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before.astype(np.int64)
        word = np.searchsorted(self._zeros, k, side="right") - 1
        return word * 64 + self._in_word(~self.high[word], k - self._zeros[word])

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        # a shift by a whole word is none
        over = np.where(off > _ZERO, self.low[word + 1] << ((_64 - off) & np.uint64(63)), _ZERO)
        return ((self.low[word] >> off) | over) & np.uint64((1 << self.width) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the places ``at``."""
        at = np.asarray(at, dtype=np.int64)
        return ((self._one(at) - at).astype(np.uint64) << np.uint64(self.width % 64)) | self._lows(at)

    def successor(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that is not below each value, from ``first`` up to before ``last``, and whether it is that value.

        Values must not be above ``most``; where nothing is that large the place is ``last``.
        """
        values = np.asarray(values, dtype=np.uint64)
        top = (values >> np.uint64(self.width)).astype(np.int64) if self.width < 64 else np.zeros(len(values), np.int64)
        start = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) - top + 1, 0)
        end = self._zero(top) - top
        if first is not None:
            start, end = np.maximum(start, first), np.maximum(end, first)
        if last is not None:
            start, end = np.minimum(start, last), np.minimum(end, last)
        low = values & np.uint64((1 << self.width) - 1)
        a, b = start.copy(), end.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) // 2
            under = self._lows(middle) < low[open_]
            a[open_[under]] = middle[under] + 1
            b[open_[~under]] = middle[~under]
            open_ = open_[a[open_] < b[open_]]
        inside = a < end
        same = np.zeros(len(values), dtype=bool)
        same[inside] = self._lows(a[inside]) == low[inside]
        return a, same
