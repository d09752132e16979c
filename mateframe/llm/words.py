"""Splitting columns of texts into words, a column at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .segments import Powers, mix, symbol_hashes

#: Bytes of text that are split at once; a longer text is a part of its own.
TOGETHER = 4 << 20


def parts(batch: pa.RecordBatch, text: int, limit: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of column ``text`` each, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    done, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        end = max(int(np.searchsorted(done, (done[begin - 1] if begin else 0) + (limit or TOGETHER), side="right")), begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, words): text i holds the words of ``codes[offsets[i]:offsets[i + 1]]``.

    Words are maximal runs of anything but the six ASCII blanks; null has none. Each different
    word stands once in ``words``.
    """
    found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = found.flatten().dictionary_encode()
    offsets = found.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    codes, words = coded.indices.to_numpy(), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # a blank at either end of a text leaves an empty string there
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return offsets, codes, words


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(edges, bytes): the UTF-8 bytes of text i are ``bytes[edges[i]:edges[i + 1]]``; null has none."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if not len(texts):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return edges - edges[0], data


class ByteHashes:
    """Texts as arrays of 64-bit values of their UTF-8 bytes."""

    def __init__(self):
        self.table = symbol_hashes(256, 5)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        edges, data = raw(texts)
        return edges, self.table[data]


class WordHashes:
    """Texts as arrays of 64-bit hashes of their words, from the bytes of a whole column at once.

    ``lower`` makes A-Z equal to a-z. A word's hash is a sum over its bytes, taken as the
    difference of two running sums, so no word is ever made a Python object.
    """

    def __init__(self, lower: bool = False):
        self.table = symbol_hashes(256, 9)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.powers = Powers(TOGETHER + 1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, hashes): the words of text i are ``hashes[offsets[i]:offsets[i + 1]]``; null has none."""
        edges, data = raw(texts)
        word = ~self.blank[data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = edges[(edges > 0) & (edges < len(data))]
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):  # ranges of words that stand within a bounded number of bytes
            end = max(int(np.searchsorted(stop, start[at] + TOGETHER, side="right")), at + 1)
            low, high = start[at], stop[end - 1]
            if high - low >= len(self.powers.up):
                self.powers = Powers(int(high - low) + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.table[data[low:high]] * self.powers.up[: high - low], out=total[1:])
            a, b = start[at:end] - low, stop[at:end] - low
            out[at:end] = mix((total[b] - total[a]) * self.powers.down[a] + (b - a).astype(np.uint64))
            at = end
        return np.searchsorted(start, edges), out
