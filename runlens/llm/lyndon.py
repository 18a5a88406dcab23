"""Suffix arrays by linear grouping, for many short strings in step.

Suffixes are grouped by their Lyndon prefix first. Groups are processed from the highest to the lowest; for each suffix ``i`` of a
group the previous smaller pointer ``prev(i)`` leads to the last earlier suffix of a lower group. Suffixes that are pointed to by
``l`` members of the processed group get a new group right above their old one, those with more pointers higher. No group is ever
renamed: a group is the first slot of its interval in the array, and a split only moves suffixes to the interval's end. Afterwards
the order follows in one sweep: the suffix before the one just emitted, and its chain of pointers, are the next of their groups.

Every string must end with a 0 that occurs nowhere else in it. All strings take one step at a time together, so a step costs a few
array operations for all of them.
"""

from __future__ import annotations

import numpy as np


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] numbers, then the same for the next."""
    out = np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)
    return out


def group_suffixes(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, prev) of every suffix; a group's number is the slot where its interval starts."""
    n = len(sym)
    sid = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((sym, sid))
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (sym[order][1:] != sym[order][:-1]) | (sid[order][1:] != sid[order][:-1])
    starts = np.flatnonzero(new)
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(starts, append=n)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, size[starts])
    prev = np.full(n, -1, np.int64)
    mark = np.zeros(n, bool)
    at, base = first[1:] - 1, first[:-1].copy()
    while len(at):
        low = group[order[at]]
        count = at - low + 1
        el = order[ragged(low, count)]
        own, floor = np.repeat(low, count), np.repeat(base, count)
        cur = np.where(el - 1 >= floor, el - 1, -1)
        on = np.flatnonzero(cur >= 0)
        on = on[group[cur[on]] > own[on]]
        while len(on):                            # skip suffixes of higher groups along their own pointers
            cur[on] = prev[cur[on]]
            on = on[cur[on] >= 0]
            on = on[group[cur[on]] > own[on]]
        prev[el] = cur
        on = np.flatnonzero(cur >= 0)
        on = on[group[cur[on]] == own[on]]
        while len(on):                            # members of the same group share their predecessor's pointer
            cur[on] = prev[cur[on]]
            prev[el[on]] = cur[on]
            on = on[cur[on] >= 0]
            on = on[group[cur[on]] == own[on]]
        q = cur[cur >= 0]
        if len(q):
            u, times = np.unique(q, return_counts=True)
            _split(u, times, group, size, order, where, mark)
        at = low - 1
        go = at >= base
        at, base = at[go], base[go]
    return group, prev


def _split(u, times, group, size, order, where, mark) -> None:
    """Move the suffixes ``u`` to the ends of their groups' intervals, by ``times`` pointed to, as groups of their own."""
    o = np.lexsort((times, group[u]))
    u, times = u[o], times[o]
    g = group[u]
    new_block = np.diff(g, prepend=-1) != 0
    block = np.flatnonzero(new_block)
    m = np.diff(block, append=len(u))
    end = np.repeat(g[block] + size[g[block]] - m, m)
    slot = end + np.arange(len(u)) - np.repeat(block, m)
    mark[u] = True
    there = order[slot]
    stay = there[~mark[there]]                    # others in the target slots swap with members further down
    at = where[u]
    free = at[at < end]
    order[free], where[stay] = stay, free
    order[slot], where[u] = u, slot
    mark[u] = False
    part = np.flatnonzero(new_block | (np.diff(times, prepend=-1) != 0))
    count = np.diff(part, append=len(u))
    size[g[block]] -= m
    size[slot[part]] = count
    group[u] = np.repeat(slot[part], count)


def suffix_arrays(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of every string in order; string k fills first[k] : first[k + 1]."""
    group, prev = group_suffixes(sym, first)
    n = len(sym)
    out = np.full(n, -1, np.int64)
    front = np.arange(n)
    placed = np.zeros(n, bool)
    out[first[:-1]] = first[1:] - 1
    placed[first[1:] - 1] = True
    length = np.diff(first)
    rank = np.argsort(-length, kind="stable")
    base = first[:-1][rank]
    running = len(length) - np.searchsorted(np.sort(length), np.arange(int(length.max()) if len(length) else 0), "right")
    for i, m in enumerate(running):
        j = out[base[:m] + i] - 1
        j = j[j >= base[:m]]
        j = j[~placed[j]]
        while len(j):
            slot = front[group[j]]
            front[group[j]] += 1
            out[slot] = j
            placed[j] = True
            j = prev[j]
            j = j[j >= 0]
            j = j[~placed[j]]
    return out
