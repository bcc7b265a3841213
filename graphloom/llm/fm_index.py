"""FM-index over a sequence of integers: sorted suffixes, wavelet-matrix ranks and sampled places, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling of ranks. Symbols are non-negative."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while True:
        key = rank * (n + 2)
        key[: n - width] += rank[width:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        step = np.concatenate([[True], key[1:] != key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if step.all():
            return order
        width *= 2


class WaveletMatrix:
    """Ranks of symbols below 2**bits in any prefix of a sequence."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            bit = (seq >> b & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~bit)]).astype(np.int64)
            self.levels.append((b, zeros))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, zeros in self.levels:
            one = (symbol >> b & 1).astype(bool)
            at = np.where(one, zeros[-1] + at - zeros[at], zeros[at])
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self._down(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for b, zeros in self.levels:
            one = zeros[at + 1] == zeros[at]
            symbol |= one.astype(np.int64) << b
            at = np.where(one, zeros[-1] + at - zeros[at], zeros[at])
        return symbol


class FMIndex:
    """Index of runs of symbols 1 to n_symbols; a 0 ends each run, and no match crosses it."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 8):
        ends = seq == 0
        self.n_ends = int(ends.sum())
        ranked = seq.astype(np.int64) + self.n_ends
        ranked[ends] = np.arange(self.n_ends)  # every end differs, so suffixes never tie across runs
        sa = suffix_array(ranked)
        before = seq[sa - 1].astype(np.int64)  # of place 0: the last symbol, an end
        self.matrix = WaveletMatrix(before, max(1, n_symbols.bit_length()))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))]).astype(np.int64)
        self.n = len(seq)
        self.known = (sa % sample == 0) | (before == 0)
        self.slot = np.cumsum(self.known) - 1
        self.places = sa[self.known]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns, which stand at the right of their rows."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if len(live):
                c = patterns[live, patterns.shape[1] - 1 - k].astype(np.int64)
                ranks = self.matrix.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
                lo[live], hi[live] = self.starts[c] + ranks[: len(c)], self.starts[c] + ranks[len(c) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: steps back until one whose place is kept."""
        rows, back, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.known[rows[live]]
            hit = live[done]
            out[hit] = self.places[self.slot[rows[hit]]] + back[hit]
            live = live[~done]
            c = self.matrix.access(rows[live])
            rows[live] = self.starts[c] + self.matrix.rank(c, rows[live])
            back[live] += 1
        return out
