"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classed as L (larger than the next one) or S (smaller). A leftmost-smaller suffix is S
with an L before it. The string from a position to the next leftmost-smaller one, letters doubled
and classes in the low bit, is free of prefixes; so ranks of these strings sort the leftmost-smaller
substrings, the string of their names is sorted recursively, and the order of all suffixes follows
from (rank of own string, rank of the leftmost-smaller suffix at its end). Every step works on
whole arrays.
"""

from __future__ import annotations

import numpy as np


def dense(ranks: np.ndarray) -> tuple[np.ndarray, int]:
    keys, names = np.unique(ranks, return_inverse=True)
    return names.astype(np.int64) + 1, len(keys)


def _string_ranks(digit: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """Ranks, equal for equal strings, of digit[i : i + size[i]]; digit has zeros enough at its end."""
    n, per = len(size), 64 // bits
    word = np.zeros(n, np.uint64)
    for j in range(per):
        word = (word << np.uint64(bits)) | digit[j : j + n]
    over = np.maximum(per - size, 0).astype(np.uint64) * np.uint64(bits)
    word = (word >> over) << over
    order = np.argsort(word)
    first = np.empty(n, bool)
    first[:1] = True
    w = word[order]
    first[1:] = w[1:] != w[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = begin
    # strings that go on: by doubling, the rest of a string being the string of a later position
    step = per
    again = np.bincount(begin, minlength=n)
    active = np.flatnonzero((size > step) & (again[rank] > 1))
    while len(active):
        a, b = rank[active], rank[active + step]
        o = np.lexsort((b, a))
        active, a, b = active[o], a[o], b[o]
        new_a = np.r_[True, a[1:] != a[:-1]]
        new = new_a | np.r_[True, b[1:] != b[:-1]]
        at = np.arange(len(a))
        head = np.maximum.accumulate(np.where(new_a, at, 0))
        part = np.maximum.accumulate(np.where(new, at, 0))
        fresh = a + part - head
        rank[active] = fresh
        step *= 2
        count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        active = np.sort(active[(size[active] > step) & (count > 1)])
    return rank


def suffix_array(text: np.ndarray, letters: int | None = None) -> np.ndarray:
    """text: integers from 1 on; the end counts as less than any letter."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    letters = int(text.max()) if letters is None else letters
    step = np.diff(text.astype(np.int64), append=0)
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = step[at] > 0
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.append(left, n)
    place = np.searchsorted(ends, np.arange(n), "right")
    size = ends[place] - np.arange(n) + 1
    bits = max(2, int(2 * letters + 1).bit_length())
    digit = np.zeros(n + 2 + 64 // bits, np.uint64)
    digit[:n] = text.astype(np.uint64) * np.uint64(2) + small
    digit[n] = 1
    rank = _string_ranks(digit, np.append(size, 1), bits)[:n]
    end_rank = np.zeros(len(ends), np.int64)
    if len(left):
        names, distinct = dense(rank[left])
        if distinct == len(left):
            end_rank[:-1] = names
        else:
            end_rank[suffix_array(names, distinct)] = np.arange(1, len(left) + 1)
    return np.argsort(rank * np.int64(len(ends) + 1) + end_rank[place])


def common_prefixes(data: bytes, sa: np.ndarray) -> np.ndarray:
    """For each place in sa the longest common prefix with the suffix before it.

    Computed in text order: a position whose letter before equals that of its neighbour has one less
    than the position before; only the others are compared, eight bytes at a time.
    """
    n = len(sa)
    if not n:
        return np.empty(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    buf = np.frombuffer(data, np.uint8)
    word = np.ndarray((n + 1,), "<u8", data + b"\0" * 16, strides=(1,))
    i = np.arange(n)
    same = (i > 0) & (before > 0)
    same[same] = buf[i[same] - 1] == buf[before[same] - 1]
    own = np.flatnonzero(~same & (before >= 0))
    lcp = np.zeros(len(own), np.int64)
    act, a, b = np.arange(len(own)), own, before[own]
    most = n - np.maximum(a, b)
    shift = 0
    while len(act):
        x = word[np.minimum(a + shift, n)] ^ word[np.minimum(b + shift, n)]
        differs = x != 0
        low = x[differs] & (~x[differs] + np.uint64(1))
        lcp[act[differs]] = shift + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        on = ~differs
        lcp[act[on]] = shift + 8
        on &= shift + 8 < most
        act, a, b, most = act[on], a[on], b[on], most[on]
        shift += 8
    lcp = np.minimum(lcp, n - np.maximum(own, before[own]))
    plcp = np.full(n, 0, np.int64)
    base = np.full(n, -1, np.int64)
    base[own] = own
    base[before < 0] = np.flatnonzero(before < 0)
    lead = np.maximum.accumulate(base)
    value = np.zeros(n, np.int64)
    value[own] = lcp
    plcp = np.maximum(value[np.maximum(lead, 0)] - (i - lead), 0)
    return plcp[sa]
