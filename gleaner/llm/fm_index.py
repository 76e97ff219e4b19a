"""A compressed FM-index: a wavelet matrix of bit vectors over the Burrows-Wheeler transform of a collection.

Symbols are numbers; each text of the collection ends in a separator of its own. Searches run for many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes of a sequence whose symbols are unique at least every ``longest + 1`` places, by doubling ranks."""
    rank, step = symbols.astype(np.int64), 1
    while True:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        if step > longest:
            return order
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        step *= 2


class Bits:
    """A bit vector in words of 64 with a count before each: 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1])).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, ends: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = ends >> 6
        low = (np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """``texts``: arrays of symbols from 1 to ``top``; ``owner``: a number per text. Separators count as symbol 0."""

    def __init__(self, texts: list[np.ndarray], owner: np.ndarray, top: int):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        n = int(lengths.sum()) + len(texts)
        ends = np.cumsum(lengths + 1) - 1
        symbols = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = np.concatenate(texts) if texts else 0
        plain = symbols.copy()
        plain[ends] = 0
        symbols[inside] += len(texts)
        symbols[ends] = np.arange(len(texts))
        sa = suffix_array(symbols, int(lengths.max()) + 1)
        bwt = plain[sa - 1]
        counts = np.bincount(plain, minlength=top + 2)
        self.first = np.concatenate(([0], np.cumsum(counts)))[:top + 2]
        self.levels, self.n = [], n
        self.depth = max(1, int(top).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bits = ((bwt >> level) & 1).astype(np.uint8)
            self.levels.append(Bits(bits))
            bwt = np.concatenate((bwt[bits == 0], bwt[bits == 1]))
        # Least owner over ranges of suffixes: tables of doubling width.
        least = np.repeat(owner, lengths + 1)[sa].astype(np.int32)
        self.least = [least]
        while 2 << len(self.least) - 1 <= n:
            half = 1 << len(self.least) - 1
            last = self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with ``symbol`` and go on as those in the given ranges."""
        base = np.zeros_like(low)
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels):
            one = ((symbol >> level) & 1).astype(bool)
            ranks = [bits.ones(x).astype(np.int64) for x in (base, low, high)]
            base, low, high = (np.where(one, bits.zeros + r, x - r) for r, x in zip(ranks, (base, low, high)))
        return self.first[symbol] + low - base, self.first[symbol] + high - base

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner in each range; ranges must not be empty."""
        out = np.empty(len(low), np.int32)
        width = np.floor(np.log2(high - low)).astype(np.int64)
        for w in np.unique(width):
            at = np.nonzero(width == w)[0]
            table = self.least[w]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(w))])
        return out
