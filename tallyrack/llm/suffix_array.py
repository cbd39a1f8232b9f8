"""Suffix array by linear grouping, without recursive renaming.

Suffixes start in groups of their first symbol.  Groups are processed in
descending order; a processed group is final, and its context is the longest
Lyndon word its suffixes start with.  A member's previous-smaller pointer names
the nearest suffix before it in a lower group; that suffix's context grows by
the processed one, so it moves up in its group, higher the more copies it
gains.  When all are processed, one ascending pass emits each group's order:
a placed suffix places those whose Lyndon word ends where it starts.
"""

from __future__ import annotations

from array import array

import numpy as np


def suffix_array(values: np.ndarray) -> array:
    """Order of the suffixes of ``values`` (any integers), as if a least symbol stood behind them."""
    n = len(values) + 1
    text = np.empty(n, dtype=np.int64)
    text[:-1] = np.unique(values, return_inverse=True)[1] + 1 if n > 1 else 0
    text[-1] = 0
    first = np.argsort(text, kind="stable")
    ranked = text[first]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    ends = np.append(starts[1:], n)
    which = np.searchsorted(starts, np.arange(n), side="right") - 1
    group_of = np.empty(n, dtype=np.int64)
    group_of[first] = starts[which]
    place_of = np.empty(n, dtype=np.int64)
    place_of[first] = np.arange(n)
    order, group, place = (array("q" if n >> 31 else "i", x.astype("i8" if n >> 31 else "i4").tobytes()) for x in (first, group_of, place_of))
    kind = order.typecode
    end = array(kind, bytes(order.itemsize * (n + 1)))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        end[a] = b
    prev = array(kind, [-1]) * n

    high = n
    while high > 0:
        g = group[order[high - 1]]
        if high - g == 1:
            s = order[g]
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                a = group[p]
                top = end[a] - 1
                if top > a:  # alone in its new group, above the rest of the old one
                    q, at = order[top], place[p]
                    order[at], place[q] = q, at
                    order[top], place[p] = p, top
                    end[a], end[top], group[p] = top, top + 1, top
            high = g
            continue
        gained: dict[int, int] = {}
        for s in sorted(order[g:high]):
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                gained[p] = gained.get(p, 0) + 1
        high = g
        if not gained:
            continue
        by_copies: dict[int, list[int]] = {}
        for p, c in gained.items():
            by_copies.setdefault(c, []).append(p)
        for c in sorted(by_copies, reverse=True):
            moved, tops = by_copies[c], {}
            for p in moved:
                a = group[p]
                top = end[a] - 1
                if a not in tops:
                    tops[a] = top + 1
                q, at = order[top], place[p]
                order[at], place[q] = q, at
                order[top], place[p] = p, top
                end[a] = top
            for p in moved:
                group[p] = end[group[p]]
            for a, b in tops.items():
                low = end[a]
                end[low] = b  # also restores a group that moved as a whole
    result = array(kind, bytes(order.itemsize * n))
    slot = array(kind, range(n))
    result[0] = n - 1
    for i in range(n):
        s = result[i]
        p, stop = s - 1, prev[s]
        while p != stop:
            g = group[p]
            result[slot[g]] = p
            slot[g] += 1
            p = prev[p]
    return result[1:]
