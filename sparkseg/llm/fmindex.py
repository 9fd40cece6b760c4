"""FM-index of a shard of word sequences: BWT in a wavelet matrix of packed bits, backward search, matching statistics.

All queries advance in lockstep, so that each step is a few array operations.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class _Bits:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=U64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.zeros(len(ones) + 1, dtype=np.int32)
        np.cumsum(ones, out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of several sequences, each with a weight: how many equal sequences it stands for."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray):
        self.symbols = np.unique(np.concatenate(sequences))
        lengths = np.array([len(x) for x in sequences])
        n = int(lengths.sum()) + len(sequences)
        text = np.zeros(n, dtype=np.int64)  # 0 ends each sequence
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        text[inside] = np.searchsorted(self.symbols, np.concatenate(sequences)) + 1
        owner = np.repeat(np.arange(len(sequences)), lengths + 1)
        order, ranks = self._sort(text, ends, int(lengths.max()) + 1)
        self.lcp = self._common(order, ranks, n)
        self.least = self._minima(self.lcp)
        total = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.where(text[order] > 0, weights[owner[order]], 0), out=total[1:])
        self.total, self.n = total, n
        bwt = text[order - 1]
        self.starts = np.zeros(len(self.symbols) + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=len(self.symbols) + 1), out=self.starts[1:])
        self.levels = max(1, int(len(self.symbols)).bit_length())
        self.bits = []
        for level in range(self.levels - 1, -1, -1):
            one = (bwt >> level & 1).astype(bool)
            self.bits.append(_Bits(one))
            bwt = np.concatenate([bwt[~one], bwt[one]])
        self.base = np.zeros(len(self.symbols) + 1, dtype=np.int64)  # where each symbol's run begins in the last level
        self.base = self._down(np.arange(len(self.symbols) + 1), np.zeros(len(self.symbols) + 1, dtype=np.int64))

    @staticmethod
    def _sort(text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix order by prefix doubling; sequence ends differ from each other, so no suffix is compared beyond its own."""
        n = len(text)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        ranks, width = [], 1
        while True:
            order = np.argsort(rank, kind="stable")
            ordered = rank[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1])]))
            ranks.append(rank.astype(np.int32))
            if width >= longest or rank[order[-1]] == n - 1:
                return order, ranks
            after = np.zeros(n, dtype=np.int64)
            after[:-width] = rank[width:] + 1 if width < n else 0
            rank = rank * (n + 1) + after
            width *= 2

    @staticmethod
    def _common(order: np.ndarray, ranks: list[np.ndarray], n: int) -> np.ndarray:
        """Symbols that each suffix shares with the one before it in order."""
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), dtype=np.int32)
        for level in range(len(ranks) - 1, -1, -1):
            width = 1 << level
            same = (a + width <= n) & (b + width <= n)
            rank = ranks[level]
            same &= rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
            common += same * width
            a += same * width
            b += same * width
        return np.concatenate([[0], common]).astype(np.int32)

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        """Minima of runs of 1, 2, 4, ... values."""
        out = [np.minimum(values, 255).astype(np.uint8)]
        while 2 << len(out) - 1 <= len(values):
            half = 1 << len(out) - 1
            out.append(np.minimum(out[-1][:-half], out[-1][half:]))
        return out

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            one = (symbol >> level & 1).astype(bool)
            ones = bits.rank(at)
            at = np.where(one, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: suffix intervals of symbol + match.  symbol counts from 1."""
        m = len(symbol)
        at = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high])) - np.concatenate([self.base[symbol]] * 2) + np.concatenate([self.starts[symbol]] * 2)
        return at[:m], at[m:]

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest wider interval, and the length of its common prefix."""
        length = np.maximum(self.lcp[low], np.where(high < self.n, self.lcp[np.minimum(high, self.n - 1)], 0))
        low, high, goal = low.copy(), high.copy(), np.minimum(length, 255)
        for level in range(len(self.least) - 1, -1, -1):
            width, least = 1 << level, self.least[level]
            can = low - width >= 0  # rows low-width+1 .. low share goal symbols with the row before
            at = np.where(can, low - width + 1, 0)
            low = np.where(can & (least[np.minimum(at, len(least) - 1)] >= goal) & (at < len(least)), low - width, low)
            can = high + width <= self.n
            at = np.where(can, high, 0)
            high = np.where(can & (at < len(least)) & (least[np.minimum(at, len(least) - 1)] >= goal), high + width, high)
        return low, high, length

    def matching_statistics(self, queries: list[np.ndarray], least: int = 2) -> list[np.ndarray]:
        """For each word of each query, the longest match from it on that the indexed sequences hold least times by weight."""
        lengths = np.array([len(q) for q in queries])
        first = np.cumsum(lengths) - lengths
        flat = np.concatenate(queries)
        code = np.searchsorted(self.symbols, flat)
        code = np.where((code < len(self.symbols)) & (self.symbols[np.minimum(code, len(self.symbols) - 1)] == flat), code + 1, 0)
        out = np.zeros(len(flat), dtype=np.int32)
        at, live = lengths - 1, np.flatnonzero(lengths > 0)
        low, high, length = np.zeros(len(queries), np.int64), np.full(len(queries), self.n, np.int64), np.zeros(len(queries), np.int32)
        while len(live):
            symbol = code[first[live] + at[live]]
            lo, hi = self.extend(symbol, low[live], high[live])
            good = (symbol > 0) & (hi > lo) & (self.total[np.maximum(hi, lo)] - self.total[lo] >= least)
            yes = live[good]
            low[yes], high[yes] = lo[good], hi[good]
            length[yes] += 1
            out[first[yes] + at[yes]] = length[yes]
            at[yes] -= 1
            no = live[~good]
            bare = no[length[no] == 0]
            at[bare] -= 1
            held = no[length[no] > 0]
            low[held], high[held], length[held] = self.shorten(low[held], high[held])
            low[held[length[held] == 0]], high[held[length[held] == 0]] = 0, self.n
            live = live[at[live] >= 0]
        return np.split(out, np.cumsum(lengths)[:-1])
