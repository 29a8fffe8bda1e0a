"""An FM-index over a sequence of small integers: wavelet-tree ranks, batched backward search, sampled locate."""

from __future__ import annotations

import numpy as np

#: Every SAMPLE-th position of the sequence has its place kept.
SAMPLE = 8


class BitRank:
    """Bits with the number of ones before each position, counted per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = n - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        w, r = at >> 6, (at & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Ranks of symbols below 2**levels; each level keeps one bit of all symbols, zeros moved before ones (matrix form)."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        for k in range(levels - 1, -1, -1):
            bit = (symbols >> k) & 1
            self.levels.append((k, BitRank(bit.astype(np.uint8))))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position at."""
        low, high = np.zeros_like(at), at
        for k, bits in self.levels:
            one = ((symbol >> k) & 1).astype(bool)
            a, b = bits.ones(low), bits.ones(high)
            low, high = np.where(one, bits.zeros + a, low - a), np.where(one, bits.zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, how often it occurs before it)."""
        symbol, low = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for k, bits in self.levels:
            one = bits.get(at)
            a, b = bits.ones(low), bits.ones(at)
            symbol |= one.astype(np.int64) << k
            low, at = np.where(one, bits.zeros + a, low - a), np.where(one, bits.zeros + b, at - b)
        return symbol, at - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a cyclic sequence in order, by doubling; rotations that are alike throughout, by position."""
    rank, width, n = symbols.astype(np.int64), 1, len(symbols)
    order = np.argsort(rank, kind="stable")
    while width < n:
        pair = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """Counts and places of patterns in `symbols` (1 or more; 0 parts texts and never occurs in a pattern)."""

    def __init__(self, symbols: np.ndarray):
        text = np.concatenate([np.asarray(symbols) + 1, [0]]).astype(np.int64)  # an end that occurs once: no two rotations are alike
        self.n = len(text)
        order = suffix_order(text)
        last = text[order - 1]
        self.tree = WaveletTree(last, max(1, int(text.max()).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 2))])
        marked = order % SAMPLE == 0
        self.marks, self.places = BitRank(marked.astype(np.uint8)), order[marked]
        self.top = int(text.max())

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of the suffixes that begin with each pattern (rows, padded at the end)."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[(lengths[alive] >= back) & (low[alive] < high[alive])]
            now = alive
            symbol = patterns[now, lengths[now] - back].astype(np.int64) + 1
            known = symbol <= self.top
            low[now[~known]] = high[now[~known]] = 0
            now, symbol = now[known], symbol[known]
            start = self.before[symbol]
            low[now], high[now] = start + self.tree.rank(symbol, low[now]), start + self.tree.rank(symbol, high[now])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes at these rows, by steps back to a sampled one."""
        place = np.full(len(rows), -1, dtype=np.int64)
        at, todo = rows.copy(), np.arange(len(rows))
        steps = 0
        while len(todo):
            hit = self.marks.get(at)
            place[todo[hit]] = self.places[self.marks.ones(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, nth = self.tree.access(at)
            at = self.before[symbol] + nth
            steps += 1
        return place % self.n
