"""Linear suffix sorting by Lyndon-prefix groups (no recursion, no renaming of a reduced string).

Phase 1 keeps the suffixes in groups that share a prefix, ordered lexicographically, as intervals
of one array. Groups are finished from the largest to the smallest. A finished group's suffixes
look up their previous smaller suffix through the pointers found so far; the suffixes they find
are moved to the upper end of their own groups, those found more often higher up. What is left
groups the suffixes by their longest Lyndon prefix. Phase 2 emits the order: walking the result
from the smallest suffix, every suffix whose next smaller suffix has just been placed takes the
next free place of its group.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def lyndon_groups(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """(group start of each suffix, previous smaller suffix of each suffix or -1)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = np.asarray(symbols)[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(fresh)
    sizes = np.zeros(n, np.int64)
    sizes[starts] = np.diff(np.append(starts, n))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group_of = np.empty(n, np.int64)
    group_of[order] = starts[np.cumsum(fresh) - 1]
    at, place, group, size = order.tolist(), place.tolist(), group_of.tolist(), sizes.tolist()
    prev = [-1] * n
    top = n
    while top > 0:
        low = group[at[top - 1]]
        if top - low == 1:
            s = at[low]
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[s] = p
            top = low
            if p >= 0:
                g = group[p]
                last = g + size[g] - 1
                if last > g:
                    q, here = at[last], place[p]
                    at[here], place[q], at[last], place[p] = q, here, p, last
                    size[g] -= 1
                    group[p], size[last] = last, 1
            continue
        found: Counter[int] = Counter()
        for s in sorted(at[low:top]):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                found[p] += 1
        top = low
        by_group: dict[int, list[tuple[int, int]]] = {}
        for p, count in found.items():
            by_group.setdefault(group[p], []).append((count, p))
        for g, moved in by_group.items():
            whole = size[g]
            if whole == 1:
                continue
            moved.sort(reverse=True)
            last, i = g + whole - 1, 0
            while i < len(moved):
                j, count = i, moved[i][0]
                while j < len(moved) and moved[j][0] == count:
                    p = moved[j][1]
                    q, here = at[last], place[p]
                    at[here], place[q], at[last], place[p] = q, here, p, last
                    last -= 1
                    j += 1
                begin = last + 1
                for _, p in moved[i:j]:
                    group[p] = begin
                size[begin] = j - i
                i = j
            if last >= g:
                size[g] = last - g + 1
    return group, prev


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of an integer sequence in lexicographic order."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    group, prev = lyndon_groups(symbols)
    free = list(range(n))
    out = [-1] * n
    placed = bytearray(n)
    for i in range(-1, n):
        p = (out[i] if i >= 0 else n) - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = prev[p]
    return np.array(out, np.int64)
