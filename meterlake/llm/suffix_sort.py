"""Suffixes of a block of bytes in order, one suffix bucket at a time, with a difference cover for long ties.

The positions that fall in a difference cover modulo V are ranked first, by doubling in steps of V. The wanted suffixes
are then split at sampled splitters into buckets of bounded size; a bucket is sorted by its first V bytes, and
suffixes that tie are placed by ranks: for any two positions there is a shift below V that takes both into the cover.
Memory is that of the cover's ranks and of one bucket.

Order is exact up to the depth that is asked for; suffixes that agree so far are side by side in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Every difference modulo V is one of two members of COVER.
V, COVER = 13, (0, 1, 3, 9)
BUCKET = 1 << 17


@lru_cache(maxsize=1)
def shifts() -> np.ndarray:
    """The least shift that takes both residues into the cover."""
    inside = np.isin(np.arange(V), COVER)
    return np.array([[next(d for d in range(V) if inside[(a + d) % V] and inside[(b + d) % V]) for b in range(V)] for a in range(V)])


def word(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n <= 8 bytes from each place as one number in text order; data is padded."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out << np.uint64(8) | data[at + j]
    return out


def ranks_of(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by their keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(data: np.ndarray, size: int, depth: int) -> np.ndarray:
    """For each position of the cover its rank by at least depth bytes; the rest is unused. data is padded."""
    where = np.flatnonzero(np.isin(np.arange(size + V) % V, COVER))
    rank = np.zeros(size + V + depth * 2 + V, np.int64)
    rank[where] = 1 + ranks_of([word(data, where, 8), word(data, where + 8, V - 8)])
    known = V
    while known < depth:
        rank[where] = 1 + ranks_of([rank[where], rank[where + known]])
        known *= 2
    return rank


def sorted_buckets(data: np.ndarray, size: int, suffixes: np.ndarray, depth: int, bucket: int = BUCKET) -> Iterator[np.ndarray]:
    """The wanted suffixes in order, bucket by bucket. data: size bytes and at least 3 * depth + 4 * V of padding."""
    if not len(suffixes):
        return
    rank = cover_ranks(data, size, depth)
    first = word(data, suffixes, 8)
    # Splitters cut where the first eight bytes differ, so a bucket holds all suffixes that begin alike.
    n = max(1, -(-len(suffixes) // bucket))
    splitters = np.unique(np.sort(first)[np.linspace(0, len(first) - 1, n + 1).astype(int)[1:-1]]) if n > 1 else np.zeros(0, np.uint64)
    which = np.searchsorted(splitters, first, side="right")
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(len(splitters) + 2))
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            yield _sorted(data, suffixes[order[a:b]], rank)


def _sorted(data: np.ndarray, suffixes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    group = ranks_of([word(data, suffixes, 8), word(data, suffixes + 8, V - 8)])
    tied = np.bincount(group)[group] > 1
    place = np.zeros(len(suffixes), np.int64)
    at = np.flatnonzero(tied)
    if len(at):
        residue, shift, most = suffixes[at] % V, shifts(), np.int64(rank.max() + 1)
        classes = [at[residue == c] for c in range(V)]
        for b in classes:
            if not len(b):
                continue
            rb = int(suffixes[b[0]] % V)
            for a in classes:
                if len(a):
                    d = shift[int(suffixes[a[0]] % V), rb]
                    theirs = np.sort(group[b] * most + rank[suffixes[b] + d])
                    # Members of the class that come before, those of earlier groups included.
                    place[a] += np.searchsorted(theirs, group[a] * most + rank[suffixes[a] + d])
    return suffixes[np.lexsort((place, group))]
