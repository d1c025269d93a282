"""Suffix arrays by linear grouping, for many texts at once.

A suffix's Lyndon prefix is the longest Lyndon word that it starts with. The first phase sorts suffixes into
groups of equal Lyndon prefixes. It takes the groups of a text in descending order; the pointer of a suffix i in
the group goes to the nearest suffix before i in a smaller group, and what is pointed at from the group k times
has its prefix lengthened by k times the group's, which splits it off its own group, the larger k the higher.
The second phase emits suffixes in ascending order: once a suffix is placed, each suffix whose Lyndon prefix
ends where it starts takes the next place in its own group. Nothing is renamed and nothing recurses.

Each step takes the next group (or suffix) of every text together, so that numpy works on long arrays while each
text goes through its groups one by one. Texts much longer than the others would leave it with short arrays for most
steps; ``one_by_one`` takes them through the same phases with lists. Pointers are followed through larger groups, and
members of a group that point at one another are resolved by doubling (from left to right in ``one_by_one``), so that
equal symbols in a row cost no more than others.
"""

from __future__ import annotations

import numpy as np


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


#: A text is taken on its own if it is longer than this, and more than twice as long as the FEW-th longest.
LONG, FEW = 4096, 16


def suffix_arrays(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix arrays of texts that are joined in ``text`` and begin at ``starts``.

    text[0] belongs to no text. Each text ends with a 0 that occurs nowhere else in it. The result has, from a
    text's start on, its suffixes' places in ``text`` in ascending order.
    """
    lengths = np.diff(np.append(starts, len(text)))
    least = max(LONG, 2 * int(np.sort(lengths)[-FEW])) if len(lengths) >= FEW else LONG
    alone = lengths > least
    if not alone.any():
        return _together(text, starts)
    out = np.zeros(len(text), np.int64)
    for s, n in zip(starts[alone].tolist(), lengths[alone].tolist(), strict=True):
        out[s : s + n] = s + one_by_one(text[s : s + n])
    if not alone.all():
        own, sizes = starts[~alone], lengths[~alone]
        at = np.concatenate(([0], _flat(own, sizes)))
        out[at[1:]] = at[_together(text[at], 1 + np.cumsum(sizes) - sizes)[1:]]
    return out


def one_by_one(text: np.ndarray) -> np.ndarray:
    """The suffix array of one text, which ends with its only 0."""
    n = len(text)
    at = np.argsort(text, kind="stable")
    first = np.flatnonzero(np.diff(text[at], prepend=-1))
    sizes = np.diff(np.append(first, n))
    group_at = np.empty(n, np.int64)
    group_at[at] = np.repeat(first, sizes)
    rank_at = np.empty(n, np.int64)
    rank_at[at] = np.arange(n)
    sa, group, rank = at.tolist(), group_at.tolist(), rank_at.tolist()
    size = dict(zip(first.tolist(), sizes.tolist(), strict=True))
    length, prev, top = [1] * n, [-1] * n, n
    while top > 1:  # the first place is that of the 0
        begin = group[sa[top - 1]]
        grown, pointed = length[sa[begin]], {}
        for s in sorted(sa[begin:top]):
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for u, k in pointed.items():
            split.setdefault(group[u], {}).setdefault(k, []).append(u)
        for h, by_count in split.items():
            end = h + size[h]
            for k in sorted(by_count, reverse=True):
                part, before = by_count[k], end
                for u in part:
                    end -= 1
                    other, place = sa[end], rank[u]
                    sa[place], rank[other], sa[end], rank[u] = other, place, u, end
                    length[u] += k * grown
                for u in part:
                    group[u] = end
                size[end] = before - end
            if end > h:
                size[h] = end - h
        top = begin
    after = np.arange(n) + np.array(length)  # where the Lyndon prefix ends
    after[n - 1] = n
    by_end = np.argsort(after, kind="stable")
    cut = np.searchsorted(after[by_end], np.arange(n + 2)).tolist()
    ending, free, out = by_end.tolist(), list(range(n)), [n - 1] * n
    for step in range(n):
        s = out[step]
        for j in ending[cut[s] : cut[s + 1]]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
    return np.array(out)


def _together(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """As suffix_arrays, step by step for all texts."""
    n, lengths = len(text), np.diff(np.append(starts, len(text)))
    owner = np.repeat(np.arange(len(starts)), lengths)
    key = owner * (int(text.max(initial=0)) + 1) + text[1:]
    sa = np.concatenate(([0], np.argsort(key, kind="stable") + 1))
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    in_order = key[sa[1:] - 1]
    first = np.concatenate(([0], np.flatnonzero(np.diff(in_order, prepend=in_order[0] - 1 if n > 1 else 0)) + 1))
    sizes = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)  # of a suffix: the first place of its group
    group[sa] = np.repeat(first, sizes)
    group[0] = -1
    size = np.zeros(n, np.int64)
    size[first] = sizes
    length = np.ones(n, np.int64)  # of the Lyndon prefix so far
    prev = np.arange(-1, n - 1)
    marked = np.zeros(n, bool)
    top, active = starts + lengths, np.flatnonzero(lengths > 1)
    while len(active):
        end = top[active]
        last = sa[end - 1]
        begin = group[last]
        count = end - begin
        members, floor = sa[_flat(begin, count)], np.repeat(begin, count)
        p = members - 1
        far = np.flatnonzero(group[p] > floor)
        while len(far):
            p[far] = prev[p[far]]
            far = far[group[p[far]] > floor[far]]
        prev[members] = p
        same = np.flatnonzero(group[p] == floor)  # these point at a member of their own group, and on to where that points
        while len(same):
            p[same] = prev[p[same]]
            prev[members[same]] = p[same]
            same = same[group[p[same]] == floor[same]]
        u, k = np.unique(p[p >= np.repeat(starts[active], count)], return_counts=True)
        if len(u):
            spread = np.zeros(len(starts), np.int64)
            spread[active] = length[last]
            h = group[u]
            order = np.lexsort((k, h))
            u, k, h = u[order], k[order], h[order]
            length[u] += k * spread[owner[u - 1]]
            new_h = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            of_h = np.diff(np.append(new_h, len(h)))
            base = np.repeat(h[new_h] + size[h[new_h]] - of_h, of_h)
            place = base + np.arange(len(h)) - np.repeat(new_h, of_h)
            now = rank[u]
            marked[u] = True
            pushed = sa[place]
            pushed = pushed[~marked[pushed]]
            free = now[now < base]
            sa[free], rank[pushed] = pushed, free
            sa[place], rank[u] = u, place
            marked[u] = False
            size[h[new_h]] -= of_h
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1]))))
            of_new = np.diff(np.append(new, len(h)))
            group[u] = np.repeat(place[new], of_new)
            size[place[new]] = of_new
        top[active] = begin
        active = active[begin > starts[active] + 1]
    # second phase
    after = np.arange(n) + length  # where the Lyndon prefix ends
    ends = starts + lengths - 1
    after[ends], after[0] = n, n
    by_end = np.argsort(after, kind="stable")
    cut = np.searchsorted(after[by_end], np.arange(n + 1))
    out, free = np.zeros(n, np.int64), np.arange(n)
    out[starts] = ends
    live, step = np.arange(len(starts)), 0
    while len(live):
        s = out[starts[live] + step]
        j = by_end[_flat(cut[s], cut[s + 1] - cut[s])]
        g = group[j]
        out[free[g]] = j
        free[g] += 1
        step += 1
        live = live[lengths[live] > step]
    return out
