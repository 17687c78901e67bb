"""FM-index over many short sequences of symbols, with matching statistics up to a depth.

Sequences are joined with the end mark 0.  Suffixes are sorted by their first symbols only, by doubling,
which is enough for patterns up to that length.  The Burrows-Wheeler transform lies in a wavelet matrix of
bit vectors with counts per 64 bits.  Backward search extends all patterns by one symbol at a time; where a
match can't be extended its interval widens to that of its longest shorter prefix, as the LCP array tells.
"""

import numpy as np


class FMIndex:
    def __init__(self, symbols: np.ndarray, depth: int):
        """``symbols`` are above 0 within sequences and 0 after each; matches are followed up to ``depth``."""
        self.depth, self.n = depth, len(symbols)
        self.sigma = int(symbols.max(initial=0)) + 1  # a symbol that doesn't occur stands for unknown ones
        suffixes = self._sort(symbols.astype(np.int64))
        self.rows = suffixes
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.sigma + 1))])[:self.sigma + 1]
        self._wavelet(symbols[suffixes - 1])
        self.base = self._walk(np.arange(self.sigma + 1), np.zeros(self.sigma + 1, np.int64))

    def _sort(self, rank: np.ndarray) -> np.ndarray:
        ranks, width = [rank], 1
        order = np.arange(self.n)
        while width <= self.depth:
            key = rank * (rank.max(initial=0) + 2)
            key[:max(self.n - width, 0)] += rank[width:] + 1
            order = np.argsort(key)
            fresh = np.ones(self.n, np.int64)
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(fresh)
            ranks.append(rank)
            width *= 2
        self.lcp = np.zeros(self.n + 1, np.int64)
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 2, -1, -1):  # common prefixes by halves
            padded = np.concatenate([ranks[k], np.zeros(2 * width, np.int64)])
            same = (padded[a] == padded[b]) & (np.maximum(a, b) < self.n)
            step = same * (1 << k)
            a, b = a + step, b + step
        self.lcp[1:self.n] = np.minimum(a - order[:-1], self.depth)
        self.lcp[[0, self.n]] = -1  # nothing stands before the first row or after the last
        self._starts: dict[int, np.ndarray] = {}
        return order

    def _wavelet(self, sequence: np.ndarray) -> None:
        self.levels = []
        for level in range(self.sigma.bit_length() - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            packed = np.zeros(self.n // 64 * 8 + 8, np.uint8)
            bits = np.packbits(bit, bitorder="little")
            packed[:len(bits)] = bits
            lanes = packed.view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(lanes), dtype=np.int64)])
            self.levels.append((level, lanes, ones, self.n - int(ones[-1])))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, lanes, ones, zeros in self.levels:
            lane = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            rank = ones[lane] + np.bitwise_count(lanes[lane] & below)
            at = np.where(symbol >> level & 1, zeros + rank, at - rank)
        return at

    def extend(self, symbol, low, high):
        """Intervals of the matches with one more symbol in front; empty where there are none."""
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.before[symbol] - self.base[symbol]
        return start + both[:len(symbol)], start + both[len(symbol):]

    def classes(self, depth: int) -> np.ndarray:
        """First rows of the runs of suffixes that agree on their first ``depth`` symbols, and the number of rows."""
        if depth not in self._starts:
            self._starts[depth] = np.append(np.flatnonzero(self.lcp[:self.n] < depth), self.n)
        return self._starts[depth]

    def class_of(self, row: np.ndarray, depth: int) -> np.ndarray:
        return np.searchsorted(self.classes(depth), row, "right") - 1

    def _widen(self, low, high, depth):
        """The intervals of the matches' prefixes of the given depths."""
        low, high = low.copy(), high.copy()
        for d in np.unique(depth):
            here = np.flatnonzero(depth == d)
            found = self.class_of(low[here], d)
            starts = self.classes(d)
            low[here], high[here] = starts[found], starts[found + 1]
        return low, high

    def matching_statistics(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray):
        """For each position of the patterns ``flat[first:first + size]`` the length of the longest match that
        starts there (``depth`` at most) and a row of the index that has it."""
        order = np.argsort(-size, kind="stable")
        falling = -size[order]
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        length = np.zeros(len(size), np.int64)
        lengths, rows = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(falling, -step, "left"))
            at = first[order[:live]] - falling[:live] - 1 - step
            symbol = flat[at]
            todo = np.arange(live)
            while todo.size:
                new_low, new_high = self.extend(symbol[todo], low[todo], high[todo])
                found = new_low < new_high
                good, bad = todo[found], todo[~found]
                low[good], high[good] = new_low[found], new_high[found]
                length[good] += 1
                bad = bad[length[bad] > 0]
                length[bad] = np.maximum(np.maximum(self.lcp[low[bad]], self.lcp[high[bad]]), 0)
                low[bad], high[bad] = self._widen(low[bad], high[bad], length[bad])
                todo = bad
            over = np.flatnonzero(length[:live] > self.depth)
            length[over] = self.depth
            low[over], high[over] = self._widen(low[over], high[over], length[over])
            lengths[at], rows[at] = length[:live], low[:live]
        return lengths, rows
