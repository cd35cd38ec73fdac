"""A compressed full-text index of words: Burrows-Wheeler transform, wavelet matrix and backward search, all in numpy."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits packed into 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WordIndex:
    """Index of a text of word codes from 1 up; 0 stands between pieces and is never searched for.

    Suffixes are ordered by their first ``depth`` words, which is all that a backward search of that many steps looks at.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        rank, order, h = text.astype(np.int64), None, 1
        while True:
            order = np.argsort(rank, kind="stable")
            if h >= depth:
                break
            ranked = rank[order]
            dense = np.empty(n, dtype=np.int64)
            dense[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
            behind = np.zeros(n, dtype=np.int64)
            behind[:n - h] = dense[h:] + 1 if h < n else 0
            rank, h = dense * (n + 1) + behind, 2 * h
        self.order = order
        self.first = np.searchsorted(text[order], np.arange(int(text.max(initial=0)) + 2))
        levels = max(1, int(text.max(initial=0)).bit_length())
        row = text[order - 1]                       # the word before each suffix; the last word stands before the first
        self.bits, self.zeros, base = [], [], np.zeros(len(self.first), dtype=np.int64)
        codes = np.arange(len(self.first))
        for level in range(levels - 1, -1, -1):
            ones = (row >> level & 1).astype(bool)
            rank_ = BitRank(ones)
            self.bits.append(rank_)
            self.zeros.append(int(n - ones.sum()))
            up, hit = rank_.ones(base), (codes >> level & 1).astype(bool)
            base = np.where(hit, self.zeros[-1] + up, base - up)
            row = np.concatenate([row[~ones], row[ones]])
        self.base = base                            # where each word's run begins on the lowest level

    def _place(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows before ``i`` whose preceding word is ``word``."""
        at, levels = i, len(self.bits)
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            up = bits.ones(at)
            at = np.where(word >> (levels - 1 - k) & 1, zeros + up, at - up)
        return at - self.base[word]

    def search(self, text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) that begin with the ``size`` words at each start, by backward search, last word first.

        A search stops as soon as one row is left: its match is then the only one, however long it gets.
        """
        last = text[starts + size - 1]
        low, high = self.first[last].astype(np.int64), self.first[last + 1].astype(np.int64)
        open_ = np.flatnonzero(high - low > 1)
        for step in range(size - 2, -1, -1):
            word = text[starts[open_] + step]
            low[open_] = self.first[word] + self._place(word, low[open_])
            high[open_] = self.first[word] + self._place(word, high[open_])
            open_ = open_[high[open_] - low[open_] > 1]
            if not len(open_):
                break
        return low, high
