"""Suffix sorting by the difference cover {1, 2} modulo 3, on integer arrays."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of s (non-negative integers) in order.

    Triples at positions 1 and 2 modulo 3 are sorted and named; while names repeat, the sequence of names is sorted in
    the same way. Positions 0 modulo 3 are sorted by their first symbol and the rank that follows, and merged in: among
    positions 1 modulo 3 by (symbol, rank), among positions 2 modulo 3 by (symbol, symbol, rank).
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = np.asarray(s, np.int64) + 1
    base = int(t.max()) + 1
    first = np.arange(1, n + (n % 3 == 1), 3)
    second = np.arange(2, n, 3)
    sampled = np.concatenate([first, second])
    values, names = np.unique((t[sampled] * base + t[sampled + 1]) * base + t[sampled + 2], return_inverse=True)
    if len(values) < len(sampled):
        names = _ranks(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = names + 1
    by_rank = np.empty(len(sampled), np.int64)
    by_rank[names] = sampled

    wide = n + 3
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * wide + rank[rest + 1], kind="stable")]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted(t[ones] * wide + rank[ones + 1], t[rest] * wide + rank[rest + 1])
    pairs = lambda i: (t[i] * base + t[i + 1]) * wide + rank[i + 2]
    before = before + np.searchsorted(pairs(twos), pairs(rest))
    out = np.empty(len(rest) + len(by_rank), np.int64)
    at = np.arange(len(rest)) + before
    other = np.ones(len(out), bool)
    other[at] = False
    out[at] = rest
    out[other] = by_rank
    return out[out < n]


def _ranks(names: np.ndarray) -> np.ndarray:
    order = suffix_array(names)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    return rank
