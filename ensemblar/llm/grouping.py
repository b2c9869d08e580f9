"""Linear-time suffix sorting by grouping.

Suffixes are put into groups by a prefix that is a Lyndon word and has no longer
Lyndon word after it.  Groups are handled from the largest to the smallest: each
suffix of a group points to the nearest earlier one of a smaller group, and the
suffixes pointed to take the group's word to the end of theirs, so they leave for
a new group just above, further up the more of these words follow.  What a suffix's
group stands for in the end is its longest Lyndon prefix.  Then one pass
from the smallest suffix on puts each suffix's left neighbour, and those it points
to, at the next free place of their groups.
"""

from __future__ import annotations

import numpy as np


def grouped(text: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The first phase, of text as below: each suffix's group (the place of its first suffix), the suffix
    it points to (-1: none), and the length of its longest Lyndon prefix."""
    n = len(text)
    by_symbol = np.argsort(text, kind="stable")
    new = np.append(True, text[by_symbol[1:]] != text[by_symbol[:-1]])
    starts = np.flatnonzero(new)
    first_of = starts[np.cumsum(new) - 1]
    group_of = np.empty(n, np.int64)
    group_of[by_symbol] = first_of
    place_of = np.empty(n, np.int64)
    place_of[by_symbol] = np.arange(n)
    ends = np.zeros(n, np.int64)
    ends[starts] = np.append(starts[1:], n)
    row, group, place, end = by_symbol.tolist(), group_of.tolist(), place_of.tolist(), ends.tolist()
    smaller, length = [-1] * n, [1] * n

    top = n
    while top > 0:
        start = group[row[top - 1]]
        if top - start == 1:
            i = row[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                g = group[p]
                last = end[g] - 1
                if last > g:
                    k, other = place[p], row[last]
                    row[k], row[last] = other, p
                    place[other], place[p] = k, last
                    group[p] = last
                    end[g], end[last] = last, last + 1
                length[p] += length[i]
        else:
            times: dict[int, int] = {}
            for i in sorted(row[start:top]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            # the more words of this group follow, the higher: the highest leave first
            most = max(times.values(), default=0)
            size = length[row[start]]
            for p, c in times.items():
                length[p] += c * size
            for level in range(most, 0, -1) if most > 1 else (1,):
                taken: dict[int, int] = {}
                for p in times if most == 1 else [p for p, c in times.items() if c == level]:
                    g = group[p]
                    t = taken.get(g, end[g]) - 1
                    k, other = place[p], row[t]
                    row[k], row[t] = other, p
                    place[other], place[p] = k, t
                    taken[g] = t
                for g, t in taken.items():
                    if t > g:
                        e = end[g]
                        for x in row[t:e]:
                            group[x] = t
                        end[t], end[g] = e, t
        top = start

    return group, smaller, length


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order.  text: integers; the last one is smaller than all others."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    group, smaller, _ = grouped(text)
    out, free, done = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = 1
            i = smaller[i]
    return np.array(out)
