"""Suffix sorting by linear grouping: Lyndon-prefix groups first, then each group's order."""

from __future__ import annotations


class _Group:
    """Suffixes whose known Lyndon prefix is the same, linked to the next smaller and next larger group."""

    __slots__ = ("above", "below", "members", "place")

    def __init__(self, members: set[int]):
        self.members = members
        self.below = self.above = None
        self.place = 0


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of non-negative integers; the end sorts before every symbol.

    Phase 1 starts with suffixes grouped by first symbol and takes groups in descending order. Each suffix of the
    group in turn points to its previous smaller one: the nearest place before it whose group is lower. A place that
    is pointed to c times has a prefix that goes on with c copies of the group's prefix, so it leaves its group for
    a new one just above, the higher the larger c. A group that has been taken holds suffixes of one Lyndon prefix.
    Phase 2 runs up the suffix array: from each suffix it visits the place before and the chain of previous
    smaller places, and puts each, when first met, in the next free slot of its group. Nothing is renamed.
    """
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, x in enumerate(text):
        by_symbol.setdefault(x, []).append(i)
    group: list[_Group] = [None] * n
    top = None
    for symbol in sorted(by_symbol):
        new = _Group(set(by_symbol[symbol]))
        for i in new.members:
            group[i] = new
        if top is not None:
            top.above, new.below = new, top
        top = new

    # the previous smaller place of each place whose group has been taken; before that, unknown
    unknown = -2
    previous = [unknown] * n
    taken = [False] * n
    current = top
    while current is not None:
        members = list(current.members)
        for i in members:
            taken[i] = True
        pointed: dict[int, int] = {}
        for i in members:
            waiting = [i]
            while waiting:
                at = waiting[-1]
                j = at - 1
                while j >= 0 and taken[j] and previous[j] != unknown:
                    j = previous[j]
                if j >= 0 and taken[j]:
                    # a member of this group whose own pointer comes first
                    waiting.append(j)
                else:
                    previous[at] = j
                    waiting.pop()
            j = previous[i]
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            moves: dict[int, tuple[_Group, dict[int, list[int]]]] = {}
            for j, c in pointed.items():
                old = group[j]
                moves.setdefault(id(old), (old, {}))[1].setdefault(c, []).append(j)
            for old, counts in moves.values():
                moved = sum(map(len, counts.values()))
                if moved == len(old.members) and len(counts) == 1:
                    continue
                low = old
                for c in sorted(counts):
                    new = _Group(set(counts[c]))
                    old.members -= new.members
                    for j in new.members:
                        group[j] = new
                    new.below, new.above = low, low.above
                    low.above.below = new
                    low.above = new
                    low = new
        current = current.below

    base = top
    while base is not None and base.below is not None:
        base = base.below
    place = 0
    while base is not None:
        base.place = place
        place += len(base.members)
        base = base.above
    out = [-1] * n
    done = [False] * n
    # the empty suffix, at the end, comes first of all
    for k in range(-1, n):
        j = (n if k < 0 else out[k]) - 1
        while j >= 0 and not done[j]:
            done[j] = True
            g = group[j]
            out[g.place] = j
            g.place += 1
            j = previous[j]
    return out


def common_prefixes(text: list[int], suffixes: list[int]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it in the suffix array (0 for the first)."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(suffixes):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if k:
            j = suffixes[k - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[k] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out
