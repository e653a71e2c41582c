"""Suffix arrays by linear grouping.

Suffixes are kept in groups whose order is final between groups. The groups are taken in descending order: each member
points to the nearest earlier position of a smaller group, and the positions pointed at are split off their own group,
above what is left of it, by how many members point at them. In the end a group holds the suffixes with one Lyndon word as
longest Lyndon prefix. A second sweep, upwards, places each suffix behind the next smaller suffix that follows its Lyndon
prefix, which orders the members of every group. Nothing is renamed and nothing recurs.
"""

from __future__ import annotations


def suffix_order(symbols: list[int]) -> list[int]:
    """Positions of the suffixes in order. The last symbol has to be smaller than all others."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start, before = 0, None
    for at, i in enumerate(order):
        if symbols[i] != before:
            start, before = at, symbols[i]
        place[i] = at
        group[i] = start
        size[start] += 1
    smaller = _lyndon_groups(order, place, group, size)
    return _placed(n, group, smaller)


def _lyndon_groups(order: list[int], place: list[int], group: list[int], size: list[int]) -> list[int]:
    """Splits the groups until each has one Lyndon prefix; returns the previous-smaller pointers."""
    smaller = [-1] * len(order)
    end = len(order)
    while end:
        i = order[end - 1]
        start = group[i]
        if end - start == 1:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                # p goes to the top of its group, as a group of its own
                g = group[p]
                last = g + size[g] - 1
                if last > g:
                    other, here = order[last], place[p]
                    order[here], place[other] = other, here
                    order[last], place[p], group[p] = p, last, last
                    size[g] -= 1
                    size[last] = 1
            end = start
            continue
        pointed: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = start
        by_count: dict[int, list[int]] = {}
        for p, times in pointed.items():
            by_count.setdefault(times, []).append(p)
        for times in sorted(by_count, reverse=True):
            moved = by_count[times]
            for p in moved:
                g = group[p]
                size[g] -= 1
                last, here = g + size[g], place[p]
                other = order[last]
                order[here], place[other] = other, here
                order[last], place[p] = p, last
            above = [group[p] + size[group[p]] for p in moved]
            for p, g in zip(moved, above, strict=True):
                group[p] = g
                size[g] += 1
    return smaller


def _placed(n: int, group: list[int], smaller: list[int]) -> list[int]:
    """The order of suffixes from the final groups: upwards, each suffix places those whose Lyndon prefix it ends."""
    out, free, done = [n - 1] * n, list(range(n)), bytearray(n)
    if n:
        done[n - 1] = 1
    for at in range(n):
        p = out[at] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = smaller[p]
    return out
