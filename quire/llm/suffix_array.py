"""Suffix sorting by linear grouping, after Baier (2016), over integer symbols.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix. Groups are
taken in descending order; every suffix of the current group finds its previous
smaller suffix (the nearest earlier one in a lower group), and the suffixes so
reached move, those reached most often first, into new groups right above their
old ones. Phase 2 walks the array from the smallest suffix up and emits each
group's order from the previous-smaller pointers alone: what has not been
emitted before a suffix and ends its Lyndon prefix there comes next in its
group. No symbol is renamed and nothing recurses.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Start positions of the suffixes of ``symbols`` in lexicographic order (a prefix comes first)."""
    n = len(symbols)
    if not n:
        return []
    _, rank, sizes = np.unique(symbols, return_inverse=True, return_counts=True)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(rank, kind="stable")
    slots = order.tolist()  # group by group; a group is known by its first slot
    group = starts[rank].tolist()
    slot_of = np.empty(n, np.int64)
    slot_of[order] = np.arange(n)
    slot_of = slot_of.tolist()
    end = dict(zip(starts.tolist(), (starts + sizes).tolist()))
    previous = [-1] * n

    top = n
    while top:
        first = group[slots[top - 1]]
        reached: Counter[int] = Counter()
        for s in sorted(slots[first:top]):
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                reached[p] += 1
        times = defaultdict(list)
        for p, k in reached.items():
            times[k].append(p)
        for k in sorted(times, reverse=True):
            moved = defaultdict(int)
            for p in times[k]:
                own = group[p]
                moved[own] += 1
                to = end[own] - moved[own]
                at, other = slot_of[p], slots[to]
                slots[at], slots[to] = other, p
                slot_of[other], slot_of[p] = at, to
            for own, count in moved.items():
                stop = end[own]
                new = stop - count
                if new > own:
                    end[own], end[new] = new, stop
                    for slot in range(new, stop):
                        group[slots[slot]] = new
        top = first

    out, placed, free = [-1] * n, [False] * n, list(range(n))
    for i in range(-1, n):
        s = n - 1 if i < 0 else out[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            own = group[s]
            out[free[own]] = s
            free[own] += 1
            s = previous[s]
    return out


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in ``order`` with the one before it (0 for the first)."""
    n = len(order)
    rank, out, k = [0] * n, [0] * n, 0
    for i, s in enumerate(order):
        rank[s] = i
    for s in range(n):
        i = rank[s]
        if not i:
            k = 0
            continue
        t = order[i - 1]
        while s + k < n and t + k < n and symbols[s + k] == symbols[t + k]:
            k += 1
        out[i] = k
        k = max(0, k - 1)
    return out


class Sorted:
    """The sorted suffixes of ``symbols``, asked for the ones that begin alike."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        shared = np.array(common_prefixes(symbols.tolist(), order), np.int64)
        self.rank = np.empty(len(order), np.int64)
        self.rank[np.array(order, np.int64)] = np.arange(len(order))
        # least[j][i]: what the suffixes i - 2^j to i of the order have in common; -1 beyond the ends
        self.least = [np.append(np.where(np.arange(len(order)) > 0, shared, -1), -1)]
        while 1 << len(self.least) <= len(order):
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            wide = np.full(len(last), -1, np.int64)
            wide[step:] = np.minimum(last[step:], last[:-step])
            wide[-1] = -1
            self.least.append(wide)

    def interval(self, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank, and number, of the suffixes that share the first ``size`` symbols of the one at ``place``."""
        low, high = self.rank[place].copy(), self.rank[place].copy()
        for j in reversed(range(len(self.least))):
            table = self.least[j]
            low = np.where(table[low] >= size, low - (1 << j), low)
            to = np.minimum(high + (1 << j), len(table) - 1)
            high = np.where(table[to] >= size, to, high)
        return low, high - low + 1
