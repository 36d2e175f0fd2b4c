"""Suffix sorting by groups: a linear-time suffix array without recursive renaming.

Phase 1 refines groups of suffixes until all members of a group share their longest Lyndon prefix.
Groups are taken from the greatest to the least. When a group is taken, each of its suffixes points
back to the nearest suffix before it of a lesser group; the Lyndon prefix of that one grows by the
prefix of the group taken, once for each suffix of the group that points to it. All suffixes that
grow leave their group for new ones just above it, in order of how often they grew.

Phase 2 walks the groups upwards. A suffix that has its place gives the next place in their groups
to all suffixes whose Lyndon prefix ends where it begins; the pointers of phase 1 lead to them.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Positions of the suffixes of `symbols` in order; a suffix that is a prefix of another comes first."""
    n = len(symbols)
    if n == 0:
        return []
    order = {s: g for g, s in enumerate(sorted(set(symbols)), 1)}
    members: list[list[int]] = [[n]] + [[] for _ in order]  # group 0 holds the end, the least suffix
    group = [order[s] for s in symbols] + [0]
    for i in range(n):
        members[group[i]].append(i)
    above = list(range(1, len(members))) + [-1]
    below = [-1, *range(len(members) - 1)]
    taken = [False] * (n + 1)
    back = [-1] * (n + 1)
    ranked: list[list[int]] = []

    g = len(members) - 1
    while g >= 0:
        own = sorted(i for i in members[g] if group[i] == g)
        ranked.append(own)
        grew: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and taken[p]:
                p = back[p]
            if p >= 0 and group[p] == g:  # p came before i: it knows where both lead
                p = back[p]
            back[i] = p
            if p >= 0:
                grew[p] = grew.get(p, 0) + 1
        for i in own:
            taken[i] = True
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in grew.items():
            moved.setdefault((group[p], -times), []).append(p)
        for old, times in sorted(moved):  # most growths first, so that each new group lands below the one before
            new, up = len(members), above[old]
            members.append(moved[old, times])
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
            for p in moved[old, times]:
                group[p] = new
        g = below[g]
    return _emit(ranked, back, n)


def _emit(ranked: list[list[int]], back: list[int], n: int) -> list[int]:
    slot = [0] * (n + 1)  # next free place of each suffix's group, kept at the group's first member
    head = [0] * (n + 1)
    at = 0
    for own in reversed(ranked):
        if own:
            for i in own:
                head[i] = own[0]
            slot[own[0]] = at
            at += len(own)
    out = [-1] * (n + 1)
    placed = [False] * (n + 1)
    out[0], placed[n] = n, True
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            h = head[j]
            out[slot[h]] = j
            slot[h] += 1
            placed[j] = True
            j = back[j]
    return out[1:]


def common_prefixes(symbols: list[int], suffixes: list[int]) -> list[int]:
    """Length of the prefix that each suffix shares with the one before it in order."""
    n = len(symbols)
    rank = [0] * n
    for r, i in enumerate(suffixes):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = suffixes[rank[i] - 1]
            while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
                h += 1
            out[rank[i]] = h
            h -= h > 0
        else:
            h = 0
    return out


def ending_marks(strings: list[list[int]]) -> list[int]:
    """One string of all, each followed by a mark of its own below all symbols, so that no match crosses."""
    out: list[int] = []
    for k, s in enumerate(strings, 1):
        out += s
        out.append(-k)
    return out
