"""Suffix order by linear grouping (no recursion, no renaming).

Phase 1 starts with one group per first symbol and visits groups in descending order. For
each suffix of the visited group the pointer to the nearest earlier suffix of a lower group
is found along known pointers; the suffixes pointed at get the visited group's string
appended to their own (as often as they are pointed at), so they leave their group for a
new one just above it. In the end a group holds the suffixes with one Lyndon prefix.
Phase 2 emits the order: walking the result from its start, each suffix's left neighbour
and its chain of pointers take the next free place of their groups.
"""

from __future__ import annotations


def suffix_order(text: list[int]) -> list[int]:
    """Start positions of all suffixes of ``text`` in ascending order.

    Symbols are any integers; a suffix that is a prefix of another comes first.
    """
    n = len(text) + 1  # position n - 1 is the empty suffix, below all others
    members: list[list[int]] = []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    members.append([n - 1])
    for c in sorted(by_symbol):
        for i in by_symbol[c]:
            group[i] = len(members)
        members.append(by_symbol[c])
    below = list(range(-1, len(members) - 1))  # the group just under each group
    above = [g + 1 for g in range(len(members) - 1)] + [-1]

    prev = [-1] * n
    visited = bytearray(n)
    g = len(members) - 1
    lowest = 0
    while g >= 0:
        inside = members[g]
        inside.sort()
        for i in inside:
            visited[i] = 1
        pointed: dict[int, int] = {}
        for i in inside:
            j = i - 1
            while j >= 0 and visited[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            split: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                split.setdefault((times, group[j]), []).append(j)
            for times, old in sorted(split, reverse=True):
                moved = split[times, old]
                new = len(members)
                members.append(moved)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                below[up] = new
                for j in moved:
                    group[j] = new
            for old in {o for _, o in split}:
                members[old] = [j for j in members[old] if group[j] == old]
        g = below[g]

    place = [0] * len(members)
    at, g = 0, lowest
    while g != -1:
        place[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    place[group[n - 1]] += 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            order[place[group[s]]] = s
            place[group[s]] += 1
            s = prev[s]
    return order[1:]
