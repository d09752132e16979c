"""A compressed FM-index over integer symbols: wavelet matrix, backward search, repeat search."""

from __future__ import annotations

import numpy as np


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` symbols (or more) that start there.

    Backward search with patterns shorter than ``depth`` needs no deeper order.
    """
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        k *= 2
        if k >= depth:
            return order
        steps = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order


class FMIndex:
    """Counts of patterns in ``x`` (small non-negative integers), for patterns below ``depth``."""

    def __init__(self, x: np.ndarray, depth: int):
        self.n = n = len(x)
        sigma = int(x.max(initial=0)) + 1
        self.levels = max(int(sigma - 1).bit_length(), 1)
        bwt = x[suffix_order(x, depth) - 1]
        self.words, self.ones, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (bwt >> level & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            word = np.zeros(n // 64 + 1, np.uint64)
            word.view(np.uint8)[: len(packed)] = packed
            self.words.append(word)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word[:-1]), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        counts = np.bincount(x, minlength=sigma)
        before = np.cumsum(counts) - counts
        every = np.arange(sigma)
        self.shift = before - self._down(every, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            word = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[level][word] + np.bitwise_count(self.words[level][word] & mask)
            i = np.where(c >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, i - ones)
        return i

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``c`` + pattern from the rows ``low`` to ``high`` of each pattern."""
        both = self._down(np.concatenate([c, c]), np.concatenate([low, high])) + np.tile(self.shift[c], 2)
        return both[: len(c)], both[len(c) :]


def repeated(x: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """For every place of ``x``: does a window start there that occurs twice or more?

    Windows lie in the sequences from ``begin`` to ``end``; ``x`` has a separator (0) between
    them. Each sequence is streamed against the index of all: a backward search from ``stop``
    goes left while two rows or more are left, which is the matching statistic of ``stop``.
    If it reaches ``first``, all windows between repeat. If it ends at ``q``, [q, stop) is unique:
    windows right of q repeat, windows that hold [q, stop) don't, and the search goes on with
    [first, q) and with the windows that hold q but end before ``stop``.
    """
    longest = int((end - begin).max(initial=0))
    mark = np.zeros(len(x) + 1, np.int32)
    out = np.zeros(len(x), bool)
    if not len(begin) or longest < window:
        return out
    index = FMIndex(x, longest + 1)
    live = np.flatnonzero(end - begin >= window)
    first, limit = begin[live].astype(np.int64), end[live].astype(np.int64)  # windows that end after limit are settled
    stop, at = limit.copy(), limit.copy()
    low, high = np.zeros(len(live), np.int64), np.full(len(live), index.n)
    while len(first):
        low, high = index.step(x[at - 1], low, high)
        alive = high - low > 1
        at = at - alive
        done = ~alive | (at == first)
        if done.any():
            d = np.flatnonzero(done)
            f, s, a = first[d], stop[d], at[d]  # [a, s) repeats; [a - 1, s) doesn't, unless a == f
            good = s - a >= window
            np.add.at(mark, a[good], 1)
            np.add.at(mark, s[good] - window + 1, -1)
            full = alive[d]
            q = a - 1
            lost, single = ~full, s - f == window
            # reached first: all windows that end by stop are settled, go on behind them;
            # a single window lost at q: the next that can repeat starts behind q
            f2 = np.where(full, np.maximum(s - window + 1, f + 1), np.where(single, q + 1, f))
            # a stretch up to the limit lost at q: windows that end there or later are settled
            l2 = np.where(lost & ~single & (s == limit[d]), s - 1, limit[d])
            # then what lies left of q, if that holds a window, or window by window
            jump = np.minimum(f2 + 2 * window, l2)
            s2 = np.where(lost & ~single & (q - f >= window), q, np.where(lost & single, np.maximum(jump, f2 + window), f2 + window))
            first[d], limit[d], stop[d], at[d] = f2, l2, s2, s2
            low[d], high[d] = 0, index.n
            keep = first + window <= limit
            if not keep.all():
                first, limit, stop, at, low, high = first[keep], limit[keep], stop[keep], at[keep], low[keep], high[keep]
    return np.cumsum(mark[:-1]) > 0
