"""Suffix arrays by linear grouping.

Suffixes that share their Lyndon prefix form a group, and groups stand in the order of
those prefixes. The first phase starts from the groups of single symbols and takes them
from the greatest down: each suffix of a group points to the nearest smaller one before it
(its previous-smaller pointer), and the suffixes pointed at extend their Lyndon prefix by
the group's, so they move to a new group directly after their old one; those with more
pointers move further up. A group's suffixes never change group again once it has been
taken, so nothing is renamed recursively and each suffix moves at most once per pointer.
The second phase walks the suffixes in the order found so far and emits, for each, the
chain of previous-smaller pointers before it into the next free places of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby


def _group(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """First phase: each suffix's group, named by its first place in the order, and its pointer (-1: none)."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    group, pointer = [0] * n, [-1] * n
    members: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    begins_at: dict[int, int] = {}  # by the last place of a group
    place = 0
    for c in sorted(by_symbol):
        own = by_symbol[c]
        for i in own:
            group[i] = place
        members[place], size[place] = own, len(own)
        begins_at[place + len(own) - 1] = place
        place += len(own)
    last = n - 1
    while last >= 0:
        g = begins_at[last]
        pointed: list[tuple[int, int]] = []  # (suffix, pointers to it), ascending
        at, hits = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = pointer[j]
            pointer[i] = j
            if j < 0:
                continue
            if j == at:
                hits += 1
            else:
                if hits:
                    pointed.append((at, hits))
                at, hits = j, 1
        if hits:
            pointed.append((at, hits))
        levels = [pointed]
        if any(h > 1 for _, h in pointed):
            levels = [list(part) for _, part in groupby(sorted(pointed, key=lambda x: (-x[1], x[0])), key=lambda x: x[1])]
        for level in levels:
            moving: dict[int, list[int]] = {}
            for i, _ in level:
                moving.setdefault(group[i], []).append(i)
            for old, leave in moving.items():
                rest = size[old] - len(leave)
                if not rest:
                    continue  # the whole group moves up together: its place is already right
                new = old + rest
                begins_at[old + size[old] - 1] = new
                begins_at[new - 1] = old
                size[old], size[new], members[new] = rest, len(leave), leave
                for i in leave:
                    group[i] = new
        last = g - 1
    return group, pointer


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of text's suffixes in ascending order. text: non-negative integers."""
    if not text:
        return []
    text = [c + 1 for c in text]
    text.append(0)  # the least symbol ends the text
    group, pointer = _group(text)
    n = len(text)
    order = [-1] * n
    free = list(range(n))  # by group: its next place
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            order[free[g]] = i
            free[g] += 1
            placed[i] = 1
            i = pointer[i]
    return order[1:]
