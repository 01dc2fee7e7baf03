"""Suffix arrays of a shard by induced sorting, and its permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than their successor; the leftmost-smaller substrings
are sorted by induction and named; equal names are told apart by the suffix order of the string of
names (recursively while its alphabet is small against its length, then by doubling ranks); from
the order of the leftmost-smaller suffixes all others are induced. An induction visits the buckets
of the alphabet in order and moves whole vectors, so its work is linear in the text.
"""

from __future__ import annotations

import numpy as np

#: Below this many symbols a bucket, ranks are doubled instead of recursing.
DENSE = 64


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (the last, a unique least symbol, counts as smaller)."""
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where symbols differ
    return np.append(np.append(step, -1)[at] > 0, True)


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of all suffixes, given the leftmost-smaller ones in the order of ``seeds``."""
    k = len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(len(t), -1, np.int64)
    symbol = t[seeds]
    order = np.argsort(symbol, kind="stable")
    by_symbol = seeds[order]
    cuts = np.searchsorted(symbol[order], np.arange(k + 1))
    # larger suffixes: buckets upwards; what a bucket adds to itself is visited in turn
    head = starts.copy()
    for c in range(k):
        if not sizes[c]:
            continue
        done = starts[c]
        while done < head[c]:
            done, now = head[c], sa[done : head[c]]
            _place(t, small, now, sa, head, False)
        if cuts[c + 1] > cuts[c]:
            _place(t, small, by_symbol[cuts[c] : cuts[c + 1]], sa, head, False)
    # smaller suffixes: buckets downwards, from their ends
    tail = ends.copy()
    for c in range(k - 1, -1, -1):
        if not sizes[c]:
            continue
        done = ends[c]
        while done > tail[c]:
            done, now = tail[c], sa[tail[c] : done][::-1]
            _place(t, small, now, sa, tail, True)
        if head[c] > starts[c]:
            _place(t, small, sa[starts[c] : head[c]][::-1], sa, tail, True)
    sa[0] = len(t) - 1
    return sa


def _place(t, small, suffixes, sa, edge, smaller: bool) -> None:
    """Put the predecessors of the suffixes, if of the wanted type, at their buckets' edges, in order."""
    j = suffixes[suffixes > 0] - 1
    j = j[small[j] == smaller]
    if not len(j):
        return
    c = t[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    count = np.diff(np.append(first, len(c)))
    within = np.arange(len(c)) - np.repeat(first, count)
    symbols = c[first]
    if smaller:
        sa[np.repeat(edge[symbols], count) - 1 - within] = j
        edge[symbols] -= count
    else:
        sa[np.repeat(edge[symbols], count) + within] = j
        edge[symbols] += count


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffix array by doubling ranks; only suffixes that still tie are sorted again."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    rank[sa] = np.searchsorted(rank[sa], rank[sa])  # a rank is the first place of its group
    h = 1
    group = rank[sa]
    tie = np.append(group[1:] == group[:-1], False)
    tie[1:] |= tie[:-1].copy()
    at = np.flatnonzero(tie)
    while len(at):
        s = sa[at]
        nxt = np.where(s + h < n, rank[np.minimum(s + h, n - 1)], -1)
        g = rank[s]
        order = np.lexsort((nxt, g))
        s, g, nxt = s[order], g[order], nxt[order]
        sa[at] = s
        new = np.append(True, (g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1]))
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        rank[s] = first
        tie = np.append(~new[1:], False)
        tie[1:] |= ~new[1:]
        at = at[tie]
        h *= 2
    return sa


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of t, whose last symbol 0 is its only 0; all symbols are below ``symbols``."""
    n = len(t)
    if n <= 2 or symbols * DENSE > n:
        return _doubled(t)
    small = _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(t, minlength=symbols)
    if len(lms) <= 1:
        return _induce(t, small, lms, sizes)
    order = _induce(t, small, lms, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    name = _names(t, small, lms, order)
    where = np.searchsorted(lms, order)
    reduced = np.empty(len(lms), np.int64)
    reduced[where] = name
    if name[-1] + 1 < len(lms):
        order = lms[suffix_array(reduced, int(name[-1]) + 1)]
    return _induce(t, small, order, sizes)


def _names(t, small, lms, order) -> np.ndarray:
    """0 for the first substring in order, one more wherever a substring differs from the one before."""
    end = np.empty(len(t), np.int64)
    end[lms[:-1]] = lms[1:]
    end[lms[-1]] = len(t) - 1
    a, b = order[:-1], order[1:]
    size_a, size_b = end[a] - a, end[b] - b
    differs = size_a != size_b
    live = np.flatnonzero(~differs)
    d = 0
    while len(live):
        x, y = a[live] + d, b[live] + d
        unequal = (t[x] != t[y]) | (small[x] != small[y])
        differs[live[unequal]] = True
        live = live[~unequal & (d < size_a[live])]
        d += 1
    return np.append(0, np.cumsum(differs))


def permuted_prefixes(data: np.ndarray, room: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """PLCP, up to ``limit`` (a multiple of 8): what each place shares with its predecessor in the array.

    ``room`` is how many bytes each place may use; places with less room than the limit have 0.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.empty(n, np.uint64)  # the 8 bytes from each place on
    for k in range(8):
        m = len(word[k::8])
        word[k::8] = padded[k : k + 8 * m].copy().view(np.uint64)
    plcp = np.zeros(n, np.int64)
    live = np.flatnonzero((room >= limit) & (phi >= 0))
    live = live[room[phi[live]] >= limit]
    for d in range(0, limit, 8):
        live = live[word[live + d] == word[phi[live] + d]]
        plcp[live] = d + 8
    return plcp
