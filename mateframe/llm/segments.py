"""Cutting sequences so that equal windows meet: shared by the two repeat finders.

A window of ``W`` symbols belongs to the smallest hash among its ``m``-grams (its minimizer).
Neighbouring windows mostly share it, so a text falls into segments: runs of windows with one
occurrence of a minimizer. Equal windows have equal minimizers at equal places wherever they stand, hence a window can only
repeat among the segments of its own minimizer; a minimizer seen once needs no further work.
Segments also carry a hash of their whole content, so equal ones are counted, not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the rolling hash, and the mixing constants (fixed values).
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Symbols handled at once; longer sequences are cut with an overlap of W - 1.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def symbol_hashes(n: int, seed: int) -> np.ndarray:
    """``n`` fixed random 64-bit values."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


class Powers:
    def __init__(self, n: int):
        inverse = pow(BASE, -1, 1 << 64)
        self.up, self.down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
        self.up[0] = self.down[0] = 1
        self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)


class Segmenter:
    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.powers = window, gram, Powers(2 * CHUNK + window)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.powers.up[: len(x)], dtype=np.uint64)])

    def hashes(self, prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of each slice, wherever it stands."""
        return mix((prefix[start + length] - prefix[start]) * self.powers.down[start])

    def _pieces(self, sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of (symbols, owner, owner's first place, its first place in its sequence)."""
        parts, owners, firsts, held = [], [], [], 0
        for owner, x in enumerate(sequences):
            for at in range(0, max(len(x) - self.window + 1, 0), CHUNK):
                part = x[at : at + CHUNK + self.window - 1]
                parts.append(part)
                owners.append(owner)
                firsts.append(at)
                held += len(part)
                if held >= CHUNK:
                    yield self._joined(parts, owners, firsts)
                    parts, owners, firsts, held = [], [], [], 0
        if parts:
            yield self._joined(parts, owners, firsts)

    @staticmethod
    def _joined(parts: list, owners: list, firsts: list) -> tuple:
        lengths = np.array([len(p) for p in parts])
        return np.concatenate(parts), np.array(owners), np.cumsum(lengths) - lengths, np.array(firsts)

    def segments(self, sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, start, windows, minimizer, content hash) arrays; hashes as int64."""
        w, m = self.window, self.gram
        for x, owners, begins, firsts in self._pieces(sequences):
            prefix = self.prefix(x)
            grams = low = self.hashes(prefix, np.arange(len(x) - m + 1), m)
            span, want = 1, w - m + 1
            while span * 2 <= want:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if want > span:
                low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
            part = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(x)))
            whole = part[: len(low)] == part[w - 1 : w - 1 + len(low)]
            # a new minimizer, or the same one again after its first occurrence has left the window
            opens = whole & np.concatenate([[True], ~whole[:-1] | (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1])])
            start = np.flatnonzero(opens)
            n = np.flatnonzero(whole & np.concatenate([~whole[1:] | opens[1:], [True]])) + 1 - start
            p = part[start]
            yield owners[p], start - begins[p] + firsts[p], n, low[start].view(np.int64), self.hashes(prefix, start, n + w - 1).view(np.int64)
