"""Suffix array in linear time by grouping suffixes under their longest Lyndon prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order.  The last symbol must be smaller than all others and occur once.

    First phase: suffixes begin in one group for each symbol.  Groups are taken
    from the highest to the lowest.  Every suffix of a group points to the
    nearest suffix before it in a lower group; those move to new groups right
    behind their own, later the more suffixes of the group point to them, since
    their prefix is continued by the group's that often.  In the end each group
    holds the suffixes with one longest Lyndon prefix.

    Second phase: the order inside a group is the order of what follows the
    prefix.  Going through the array from its smallest suffix, the suffix before
    each and the chain of pointers from there are put at the front of their
    groups, up to one that has its place.  Nothing is renamed and no level is
    sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    heads = np.flatnonzero(np.diff(text[order], prepend=-1))
    sizes = np.diff(heads, append=n)
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(heads, sizes)
    group: list[int] = group_of.tolist()
    members: dict[int, list[int]] = {h: part.tolist() for h, part in zip(heads.tolist(), np.split(order, heads[1:]))}
    size = [0] * n
    head_of_end = [0] * n
    for h, s in zip(heads.tolist(), sizes.tolist()):
        size[h] = s
        head_of_end[h + s - 1] = h
    before = [-1] * n

    end = n - 1
    while end >= 0:
        head = head_of_end[end]
        end = head - 1
        counts: dict[int, int] = {}
        for s in members.pop(head):
            if group[s] != head:
                continue  # moved to a later group
            p = s - 1
            while p >= 0 and group[p] > head:
                p = before[p]
            if p >= 0 and group[p] == head:
                p = before[p]
            before[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if not counts:
            continue
        times = max(counts.values())
        lots = [list(counts)] if times == 1 else [[p for p, k in counts.items() if k == level] for level in range(times, 0, -1)]
        for lot in lots:
            moved: dict[int, list[int]] = {}
            for p in lot:
                moved.setdefault(group[p], []).append(p)
            for old, own in moved.items():
                left = size[old] - len(own)
                if not left:
                    continue  # the whole group: it keeps its place
                new = old + left
                size[old], size[new] = left, len(own)
                head_of_end[new + len(own) - 1] = new
                head_of_end[new - 1] = old
                members[new] = own
                for p in own:
                    group[p] = new

    array = [-1] * n
    array[0] = n - 1
    front = list(range(n))
    front[group[n - 1]] += 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        s = array[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            array[front[g]] = s
            front[g] += 1
            placed[s] = 1
            s = before[s]
    return np.array(array)
