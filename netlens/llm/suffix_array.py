"""Suffix array by induced sorting and permuted common prefixes, in numpy.

Induced sorting fills the array bucket by bucket: all suffixes that begin with a byte and are
known so far induce the suffixes one position to their left, stably and at once, so a pass
costs a few array operations for each byte value and linear work in total."""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type (smaller than the next one). The text ends with a
    symbol that is smaller than all others and occurs once."""
    n = len(t)
    rising = np.empty(n, bool)
    rising[:-1] = t[:-1] < t[1:]
    rising[-1] = True
    # equal neighbours take the type of the next position that differs
    decided = np.empty(n, bool)
    decided[:-1] = t[:-1] != t[1:]
    decided[-1] = True
    at = np.where(decided, np.arange(n), n)
    return rising[np.minimum.accumulate(at[::-1])[::-1]]


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array (int32) from leftmost-smaller positions sorted by suffix (or, in the first
    pass, by their symbol only: then it is sorted by leftmost-smaller substrings)."""
    n = len(t)
    size = np.bincount(t)
    end = np.cumsum(size)
    start = end - size
    symbols = np.flatnonzero(size)
    # leftmost-smaller suffixes of each symbol, in the given order
    by = lms[np.argsort(t[lms], kind="stable")]
    n_lms = np.bincount(t[by], minlength=len(size))
    lms_end = np.cumsum(n_lms)
    sa = np.full(n, -1, np.int32)

    # larger suffixes, left to right; ``fill`` is the next free place of each bucket
    fill = start.copy()

    def push_l(src: np.ndarray) -> None:
        src = src[src > 0] - 1
        src = src[~is_s[src]]
        if len(src):
            _append(src, fill, 1)

    def _append(src: np.ndarray, place: np.ndarray, way: int) -> None:
        c = t[src]
        order = np.argsort(c, kind="stable")
        src, c = src[order], c[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        count = np.diff(np.r_[first, len(c)])
        nth = np.arange(len(c)) - np.repeat(first, count)
        heads = c[first]
        if way > 0:
            sa[np.repeat(place[heads], count) + nth] = src
            place[heads] += count
        else:
            sa[np.repeat(place[heads], count) - nth] = src
            place[heads] -= count

    for c in symbols.tolist():
        done = start[c]
        while done < fill[c]:  # runs of the symbol induce into its own bucket
            done, now = fill[c], sa[done:fill[c]].copy()
            push_l(now)
        if n_lms[c]:
            push_l(by[lms_end[c] - n_lms[c]:lms_end[c]])

    # smaller suffixes, right to left
    back = end - 1
    sa_l_end = fill  # the L-part of a bucket ends here

    def push_s(src: np.ndarray) -> None:
        src = src[src > 0] - 1
        src = src[is_s[src]]
        if len(src):
            _append(src, back, -1)

    for c in symbols[::-1].tolist():
        done = end[c] - 1
        while done > back[c]:
            done, now = back[c], sa[back[c] + 1:done + 1][::-1].copy()
            push_s(now)
        if sa_l_end[c] > start[c]:
            push_s(sa[start[c]:sa_l_end[c]][::-1].copy())
    if size[0] == 1:
        sa[0] = n - 1  # the end symbol is induced by nothing
    return sa


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names: names of pairs are named again,
    recursively, until all differ."""
    rank, width, n = names.astype(np.int64), 1, len(names)
    while True:
        order = np.argsort(rank, kind="stable")
        if rank.max() + 1 == n:
            return order
        after = np.full(n, -1, np.int64)
        after[:n - width] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        width *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t`` (non-negative integers; the last one is 0 and occurs once)."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    is_s = classify(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    first = _induce(t, is_s, lms)
    # leftmost-smaller substrings in sorted order, named by comparing neighbours
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    same = length[a] == length[b]
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        open_ = open_[length[a[open_]] > k]
        differ = t[a[open_] + k] != t[b[open_] + k]
        same[open_[differ]] = False
        open_ = open_[~differ]
        k += 1
    name = np.zeros(n, np.int64)
    name[ordered] = np.cumsum(np.r_[0, ~same])
    names = name[lms]
    if names.max() + 1 < len(lms):
        lms = lms[_rank_names(names)]
    else:
        lms = ordered
    return _induce(t, is_s, np.asarray(lms, np.int64))


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """plcp[i]: common prefix of suffix i and the suffix before it in the array. Where the
    symbols to the left agree it is one less than at i - 1; only the others are compared."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    follows = (at > 0) & (phi > 0)
    follows[follows] = t[at[follows] - 1] == t[phi[follows] - 1]
    base = np.flatnonzero(~follows)
    lcp = np.zeros(n, np.int64)
    open_ = base[phi[base] >= 0]
    k = 0
    while len(open_):
        i, j = open_ + k, phi[open_] + k
        ok = (i < n) & (j < n)
        ok[ok] = t[i[ok]] == t[j[ok]]
        open_ = open_[ok]
        lcp[open_] += 1
        k += 1
    last = np.maximum.accumulate(np.where(follows, 0, at))
    return np.maximum(0, lcp[last] - (at - last))
