"""Suffix array by linear grouping.

Suffixes start out grouped by their first symbol.  Groups are visited in
descending order.  For each suffix of a group, the pointer to its previous
smaller suffix (the nearest one to its left that lies in a lower group) is
found by following pointers already known.  The suffixes pointed at have the
visited group's prefix behind their own, so they move to the upper end of
their groups, those pointed at most often last.  In the end a group holds the
suffixes with one longest Lyndon prefix.  A second scan, in ascending order,
emits each group's suffixes in their final order: whoever ends its Lyndon
prefix at the suffix just placed comes next in its group.  Nothing is renamed
and nothing recurses.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of `text` in ascending order.

    Symbols are positive integers of any size; an empty text gives an empty
    list.
    """
    n = len(text) + 1
    text = [*text, 0]
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        place[i] = k
        group[i] = start
        size[start] += 1

    smaller = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[start:end]) if end - start > 1 else order[start:end]:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, times in pointed.items():
            levels.setdefault(times, []).append(j)
        for times in sorted(levels, reverse=True):
            moved = levels[times]
            for j in moved:
                g = group[j]
                last = g + size[g] - 1
                at, other = place[j], order[last]
                order[at], place[other] = other, at
                order[last], place[j] = j, last
                size[g] -= 1
            fresh: dict[int, int] = {}
            for j in moved:
                g = group[j]
                fresh[g] = fresh.get(g, 0) + 1
            for j in moved:
                group[j] += size[group[j]]
            for g, count in fresh.items():
                size[g + size[g]] = count
        end = start

    placed = [False] * n
    free = list(range(n))
    order[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = free[g]
            order[at] = j
            free[g] = at + 1
            placed[j] = True
            j = smaller[j]
    return order[1:]
