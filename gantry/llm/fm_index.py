"""A compressed full-text index over numbers: Burrows-Wheeler transform in a wavelet matrix.

The text is a list of sequences of symbols. Its suffixes are sorted, the symbol before each is
kept in a wavelet matrix (a bitmap for each bit of the symbols, with counts before each 64-bit
word), and backward search finds the range of suffixes that begin with a pattern by two counts
for each symbol. All searches of a batch advance together, so a step is a few array operations.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


class Bits:
    """A bitmap with rank: 64-bit words and the number of set bits before each."""

    def __init__(self, flags: np.ndarray):
        words = -(-(len(flags) + 1) // 64)
        padded = np.zeros(words * 64, np.uint8)
        padded[:len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Counts of a symbol before a place, one level for each bit, the highest first."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels = []
        for bit in range(width - 1, -1, -1):
            flags = (symbols >> bit) & 1
            self.levels.append((bit, Bits(flags), len(flags) - int(flags.sum())))
            symbols = np.concatenate((symbols[flags == 0], symbols[flags == 1]))

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Where a symbol's own run begins on the last level: what its rank at place 0 comes to."""
        return self._descend(symbols, np.zeros(len(symbols), np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - starts


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling the compared length until all differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    step = 1
    while n and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        step *= 2
    return order


class FMIndex:
    """An index over `lengths` sequences that lie one after the other in `symbols` (any 64-bit values)."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        n = len(self.lengths)
        self.alphabet, codes = np.unique(symbols, return_inverse=True)
        # A separator follows each sequence; for sorting each is a symbol of its own, the first ones of all.
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        total = int((self.lengths + 1).sum())
        owner = np.repeat(np.arange(n), self.lengths + 1)
        text = np.empty(total, np.int64)
        is_symbol = np.ones(total, bool)
        is_symbol[self.starts + self.lengths] = False
        text[is_symbol] = codes + n
        text[~is_symbol] = np.arange(n)
        self.suffixes = suffix_array(text)
        plain = np.where(is_symbol, text - n + 1, SEPARATOR)
        self.text, self.owner = plain, owner
        width = max(1, int(len(self.alphabet)).bit_length())
        self.matrix = WaveletMatrix(plain[self.suffixes - 1], width)
        counts = np.bincount(plain, minlength=len(self.alphabet) + 1)
        self.first = np.cumsum(counts) - counts
        self.level_starts = self.matrix.starts(np.arange(len(self.alphabet) + 1))

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of symbols as the index has them, -1 for unknown ones."""
        at = np.searchsorted(self.alphabet, symbols)
        inside = at < len(self.alphabet)
        known = np.zeros(len(symbols), bool)
        known[inside] = self.alphabet[at[inside]] == symbols[inside]
        return np.where(known, at + 1, -1)

    def matching(self, codes: np.ndarray, ends: np.ndarray, most: int, least_range: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the text `codes` at the given last places, up to `most` symbols.

        Returns (length, lo, hi): how many symbols up to and with each place occur in the index at
        least `least_range` times in a row, and the range of the suffixes that begin with them. A
        search stops at the beginning of its text, at a separator and at an unknown symbol.
        """
        n = len(ends)
        length = np.zeros(n, np.int64)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.text), np.int64)
        active = np.arange(n)
        for step in range(most):
            place = ends[active] - step
            active = active[place >= 0]
            code = codes[ends[active] - step]
            keep = code > SEPARATOR
            active, code = active[keep], code[keep]
            if not len(active):
                break
            if step == 0:
                low, high = self.first[code], self.first[code] + self._count(code)
            else:
                start = self.level_starts[code]
                low = self.first[code] + self.matrix.rank(code, lo[active], start)
                high = self.first[code] + self.matrix.rank(code, hi[active], start)
            found = high - low >= least_range
            active = active[found]
            lo[active], hi[active] = low[found], high[found]
            length[active] += 1
        return length, lo, hi

    def _count(self, code: np.ndarray) -> np.ndarray:
        ends = np.append(self.first[1:], len(self.text))
        return ends[code] - self.first[code]

    def owners(self, places: np.ndarray) -> np.ndarray:
        """The sequence in which each suffix of the order begins."""
        return self.owner[self.suffixes[places]]
