"""Repeated substrings of a least length, from a Burrows-Wheeler transform.

Longest common prefixes of neighbouring suffixes are derived by increasing value: starting from
the interval of the empty string, all intervals of strings of length l are extended backwards
by every symbol before them; where an extended interval ends, the common prefix of the suffixes
on either side is l, if none was set before.  It stops at the least length: neighbours without
a value by then share at least that much.
"""

from __future__ import annotations

import numpy as np

SMALL = 64
EASY = 200  # rows to sort for each symbol not looked up


def suffix_order(text: np.ndarray, least: int) -> np.ndarray:
    """Suffixes ordered by at least their first `least` symbols (prefix doubling of those still tied); symbols are under 512."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])  # where another prefix than that of the row before begins
    h = 7
    while h < least:
        rows = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(rows):
            break
        rank = np.zeros(n + h, np.uint64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(1, n + 1), 0)).astype(np.uint64)
        at = order[rows]
        key = (rank[at] << np.uint64(32)) | rank[at + h]
        to = np.argsort(key)
        order[rows] = at[to]
        key = key[to]
        fresh[rows] |= np.append(True, key[1:] != key[:-1])
        h *= 2
    return order


def long_neighbours(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Mask over 0..n: whether suffixes order[i - 1] and order[i] share at least `least` symbols.

    The text ends with a symbol that is below all others and occurs once.
    """
    n = len(text)
    bwt = text[order - 1].astype(np.uint16)  # a narrow type sorts by radix
    by_symbol = np.argsort(bwt, kind="stable")
    symbols, counts = np.unique(bwt[by_symbol], return_counts=True)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    lf = np.empty(n, np.int64)  # row of the suffix one symbol longer
    lf[by_symbol] = np.arange(n)
    front = np.repeat(symbols, counts)  # first symbol of the suffix of each row
    places = [(int(cuts[k]), by_symbol[cuts[k] : cuts[k + 1]]) for k in range(len(symbols))]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lb, rb = np.array([0], np.int64), np.array([n], np.int64)
    for _ in range(least):
        if not len(lb):
            break
        size = rb - lb
        parts = []
        one = lf[lb[size == 1]]
        parts.append((one, one + 1))
        big = size > SMALL
        if big.any() and int(size[big].sum()) <= EASY * len(symbols):
            big[:] = False  # sorting the rows takes less than looking up every symbol
        mid = (size > 1) & ~big
        if mid.any():
            a, s = lb[mid], size[mid]
            which = np.repeat(np.arange(len(a)), s)
            rows = np.repeat(a - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(int(s.sum()))
            key = np.sort((which << 32) | lf[rows])  # by interval, then symbol, then row
            which, ends = key >> 32, key & 0xFFFFFFFF
            first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (front[ends[1:]] != front[ends[:-1]])))
            last = np.append(first[1:], len(key)) - 1
            parts.append((ends[first], ends[last] + 1))
        if big.any():
            for below, at in places:
                lo, hi = np.searchsorted(at, lb[big]), np.searchsorted(at, rb[big])
                ok = hi > lo
                parts.append((below + lo[ok], below + hi[ok]))
        lb, rb = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        new = unset[rb]
        lb, rb = lb[new], rb[new]
        unset[rb] = False
    return unset


def repeated_starts(text: np.ndarray, least: int) -> np.ndarray:
    """Mask over positions: the `least` symbols from there also start elsewhere in the text; symbols are 0..510."""
    ended = np.append(text + 1, 0)
    order = suffix_order(ended, least)
    long = long_neighbours(ended, order, least)
    out = np.zeros(len(ended), bool)
    out[order] = long[:-1] | long[1:]
    return out[:-1]
