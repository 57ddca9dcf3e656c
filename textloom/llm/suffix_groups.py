"""Suffix arrays by linear grouping.

First suffixes are grouped by their Lyndon prefix (what stands before their next smaller suffix) and the groups put in
order: starting from groups of equal first symbols, groups are taken in descending order, and each member lengthens the
prefix of the nearest earlier suffix of a smaller group, found through previous-smaller pointers. Members that are
lengthened leave their group for a new one right above it. Then the suffixes are emitted in ascending order: members of
a group differ only in their next smaller suffixes, so each suffix, once placed, places those it is next smaller to at
the front of their groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations

from itertools import accumulate


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text``, whose last symbol must be 0 and the only 0; symbols are small whole numbers."""
    n = len(text)
    counts = [0] * (max(text) + 2)
    for c in text:
        counts[c + 1] += 1
    first = list(accumulate(counts))
    order, place, group = [0] * n, [0] * n, [0] * n
    size = [0] * n  # of the group that starts here
    free = first[:]
    for i, c in enumerate(text):
        at = free[c]
        free[c] = at + 1
        order[at], place[i], group[i] = i, at, first[c]
    for c in set(text):
        size[first[c]] = free[c] - first[c]
    length = [1] * n  # of the Lyndon prefix
    before = [-1] * n  # nearest earlier suffix of a smaller group
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end]
        end = start
        if len(members) > 1:
            members.sort()
        grow: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                grow[j] = grow.get(j, 0) + 1
        if not grow:
            continue
        step = length[members[0]]
        if len(grow) == 1:
            levels = [list(grow)]
            for j, times in grow.items():
                length[j] += times * step
        else:
            by_times: dict[int, list[int]] = {}
            for j, times in grow.items():
                by_times.setdefault(times, []).append(j)
                length[j] += times * step
            levels = [by_times[t] for t in sorted(by_times, reverse=True)]
        for level in levels:
            for j in level:  # to the end of the group
                g = group[j]
                size[g] = left = size[g] - 1
                last, at = g + left, place[j]
                other = order[last]
                order[at], place[other] = other, at
                order[last], place[j] = j, last
            for j in level:
                g = group[j]
                new = g + size[g] if size[g] else g
                group[j] = -1 - new
            for j in level:
                group[j] = new = -1 - group[j]
                size[new] += 1
    followers: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        followers[i + length[i]].append(i)
    out = [0] * n
    front = list(range(n))
    at = group[n - 1]
    out[0] = n - 1
    for k in range(n):
        for i in followers[out[k]]:
            g = group[i]
            out[front[g]] = i
            front[g] += 1
    return out
