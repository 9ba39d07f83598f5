"""Suffix arrays of many short strings at once by induced sorting, and their permuted common prefixes.

The strings of a call lie one after the other in one array. Every step of an induction scan is done for all strings with one
numpy operation, so a scan costs as many operations as the longest string has symbols, and the work stays linear in the
total length; the ends of the few longest strings are scanned one by one. The steps are those of induced sorting: classify suffixes as smaller or larger than their successor, sort the
substrings between leftmost smaller (LMS) positions by induction, name them, sort the string of names recursively where names
repeat, and induce the order of all suffixes from the sorted LMS suffixes.

Each string ends with the symbol 0, which occurs nowhere else in it.
"""

from __future__ import annotations

import numpy as np

FEW = 24  # below so many strings a step by numpy costs more than a step by string


class _Scan:
    """Lockstep order of the strings: longest first, so that the strings with a symbol ``i`` are a prefix."""

    def __init__(self, start: np.ndarray, size: np.ndarray):
        by_size = np.argsort(-size, kind="stable")
        self.start, self.size = start[by_size], size[by_size]
        longest = int(size.max(initial=0))
        self.active = len(size) - np.cumsum(np.bincount(size, minlength=longest + 1))[:longest]

    def induce(self, sa: np.ndarray, bucket: np.ndarray, take: np.ndarray, place: np.ndarray, forward: bool) -> None:
        """Scan the suffix arrays and put each predecessor for which ``take`` holds at its bucket's next place."""
        begins, sizes, step = self.start, self.size, 1 if forward else -1
        together = int((self.active >= FEW).sum())
        for i, n in enumerate(self.active[:together].tolist()):
            at = begins[:n] + i if forward else begins[:n] + sizes[:n] - 1 - i
            before = sa[at] - 1
            # An empty place is -1 and gives -2; the first suffix of a string has no predecessor.
            ok = (before >= begins[:n]) & take[before]
            before = before[ok]
            if len(before):
                b = bucket[before]
                to = place[b]
                sa[to] = before
                place[b] = to + step
        if together < len(self.active):
            views = [memoryview(x) for x in (sa, bucket, take, place)]
            for begin, size in zip(begins[:self.active[together]].tolist(), sizes.tolist()):
                ends = (begin + together, begin + size) if forward else (begin + size - 1 - together, begin - 1)
                _induce_one(*views, range(*ends, step), begin, step)


def _induce_one(sa: memoryview, bucket: memoryview, take: memoryview, place: memoryview, at: range, begin: int, step: int) -> None:
    """The rest of the scan of one string, symbol by symbol."""
    for i in at:
        before = sa[i] - 1
        if before >= begin and take[before]:
            b = bucket[before]
            to = place[b]
            sa[to] = before
            place[b] = to + step


def suffix_arrays(t: np.ndarray, start: np.ndarray, size: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """For every string (``t[start:start + size]``, symbols below ``sigma``) its suffixes in order, as positions in ``t``."""
    total = len(t)
    base = np.cumsum(sigma) - sigma
    bucket = np.repeat(base, size) + t
    last = np.zeros(total, bool)
    last[start + size - 1] = True
    step = np.zeros(total, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[last] = 1
    told = np.flatnonzero(step)
    smaller = step[told[np.searchsorted(told, np.arange(total))]] > 0
    lms = smaller.copy()
    lms[1:] &= ~smaller[:-1]
    lms[start] = False
    lms |= last  # a string of the end symbol alone counts as its own LMS suffix
    counts = np.bincount(bucket, minlength=int(sigma.sum()))
    tail = np.cumsum(counts)
    scan = _Scan(start, size)

    def induced(seeds: np.ndarray) -> np.ndarray:
        """Order of all suffixes from LMS positions that are in order within each bucket."""
        sa = np.full(total, -1, np.int64)
        b = bucket[seeds]
        n_seeds = np.bincount(b, minlength=len(counts))
        sa[tail[b] - n_seeds[b] + np.arange(len(b)) - (np.cumsum(n_seeds) - n_seeds)[b]] = seeds
        scan.induce(sa, bucket, ~smaller, tail - counts, True)
        scan.induce(sa, bucket, smaller & ~last, tail - 1, False)
        return sa

    positions = np.flatnonzero(lms)
    sa = induced(positions[np.argsort(bucket[positions], kind="stable")])
    ordered = sa[lms[sa]]
    # Names: equal neighbours in this order share one. Both sides end at the next LMS position.
    of_string = np.repeat(np.arange(len(size)), size)
    following = np.zeros(total, np.int64)
    following[positions[:-1]] = positions[1:]
    following[last] = np.flatnonzero(last)
    span = following[ordered] - ordered
    same = (of_string[ordered[1:]] == of_string[ordered[:-1]]) & (span[1:] == span[:-1])
    live, depth = np.flatnonzero(same), 0
    while len(live):
        equal = t[ordered[live + 1] + depth] == t[ordered[live] + depth]
        same[live[~equal]] = False
        depth += 1
        live = live[equal & (span[live] >= depth)]
    new = np.concatenate([[True], ~same])
    numbers = np.cumsum(new) - 1
    n_lms = np.bincount(of_string[positions], minlength=len(size))
    first = np.cumsum(n_lms) - n_lms
    n_names = np.bincount(of_string[ordered[new]], minlength=len(size))
    name = np.zeros(total, np.int64)
    name[ordered] = numbers - np.repeat(numbers[first], n_lms)
    repeats = n_names < n_lms
    if repeats.any():
        inner = np.repeat(repeats, n_lms)
        sub = positions[inner]
        sub_size = n_lms[repeats]
        order = suffix_arrays(name[sub], np.cumsum(sub_size) - sub_size, sub_size, n_names[repeats])
        ordered[inner] = sub[order]
    return induced(ordered)


def common_prefixes(t: np.ndarray, sa: np.ndarray, begins: np.ndarray, separator: int) -> np.ndarray:
    """For every position of ``t`` the length of the common prefix with the suffix before it in its string's order, up to the
    next separator (symbols up to ``separator`` end a prefix); ``begins`` marks the first suffix of each order.

    Only positions whose left neighbour differs from that of their predecessor are compared; the value falls by one from each
    of them to the next."""
    total = len(t)
    before = np.full(total, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[begins]] = -1
    left = t[np.arange(total) - 1]
    told = (before <= 0) | (left != t[before - 1]) | (left <= separator)
    told[0] = True
    at = np.flatnonzero(told)
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    depth = 0
    while len(live):
        a, b = at[live] + depth, before[at[live]] + depth
        equal = (t[a] > separator) & (t[a] == t[np.minimum(b, total - 1)])
        live = live[equal]
        length[live] += 1
        depth += 1
    source = np.cumsum(told) - 1
    return np.maximum(length[source] - (np.arange(total) - at[source]), 0)
