"""An FM-index over a sequence of small integers, in arrays.

The suffix array comes from prefix doubling on what is not yet told apart; the
Burrows-Wheeler text is held as a wavelet matrix of rank tables.  Searches take
many patterns at once.  Symbol 0 separates; each 0 is smaller than the next one,
so no two suffixes are equal and a match never runs over a 0.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order; text ends with a 0."""
    n = len(text)
    zero = text == 0
    n_zero = int(zero.sum())
    first = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + n_zero - 1)
    sa = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = first[sa[1:]] != first[sa[:-1]]
    rank[sa] = np.flatnonzero(head)[np.cumsum(head) - 1]
    # rows of groups with more than one suffix
    tail = np.append(head[1:], True)
    open_ = np.flatnonzero(~(head & tail))
    k = 1
    while len(open_):
        at = sa[open_]
        key = rank[at + k]  # a group's suffixes share k symbols without a 0, so at + k is inside
        group = rank[at]
        order = np.lexsort((key, group))
        at, key, group = at[order], key[order], group[order]
        sa[open_] = at
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        rank[at] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        last = np.append(new[1:], True)
        open_ = open_[~(new & last)]
        k *= 2
    return sa


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: symbols 1 to ``symbols`` and separators 0; a last 0 is added."""
        self.text = np.append(np.asarray(text, np.int64), 0)
        self.n = len(self.text)
        self.sa = suffix_array(self.text)
        bwt = self.text[self.sa - 1]
        self.levels = max(1, int(symbols).bit_length())
        self.ranks, self.zeros = [], []
        now = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            c = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=c[1:])
            self.ranks.append(c)
            self.zeros.append(self.n - int(c[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.before = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(self.text, minlength=symbols + 1), out=self.before[1:])
        self.bwt = bwt
        # sampled suffix positions: every SAMPLE-th place, and the first after a separator, where the walk back must end
        begins = np.append(True, self.text[:-1] == 0)
        self.sampled = ((self.sa % SAMPLE) == 0) | begins[self.sa]
        self.samples = np.where(self.sampled, self.sa, -1)
        del self.sa

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the Burrows-Wheeler text before each row."""
        low, high = np.zeros(len(row), np.int64), row.astype(np.int64)
        for c, zeros, level in zip(self.ranks, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = c[low], c[high]
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (rows of a matrix, filled from the left)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = live[high[live] > low[live]]
            here = live[lengths[live] > j]
            if not len(here):
                continue
            s = patterns[here, j]
            low[here] = self.before[s] + self.rank(s, low[here])
            high[here] = self.before[s] + self.rank(s, high[here])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in some rows, by walking back to sampled ones."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[at[live]]
            hit = live[done]
            out[hit] = self.samples[at[hit]] + steps[hit]
            live = live[~done]
            s = self.bwt[at[live]]
            at[live] = self.before[s] + self.rank(s, at[live])
            steps[live] += 1
        return out
