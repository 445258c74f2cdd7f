"""Sets of word shingles as 64-bit hashes, and their fast similarity sketches, in numpy over whole texts.

Words are the runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A set is the distinct k-word shingles; a
text with fewer words has its whole sequence as one, a text without words the empty set.

The sketch throws the elements into T bins, round after round. In the first T rounds every element picks a bin by
hash; in the next T rounds round T + b sends everything to bin b, so every bin is filled. A bin keeps the least
(round, hash), and a set stops after the round that fills its last bin. Bins of two sets agree with a probability of
their similarity, with the concentration of independent draws.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

U = np.uint64
#: Bins of a sketch: BANDS bands of ROWS each.
BANDS, ROWS = 38, 5
T = BANDS * ROWS
EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Bytes of texts hashed at a time.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
RADIX = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A random odd value for each byte, the same for A-Z and a-z; 0 for white space."""
    v = mix(np.arange(1, 257, dtype=U)) | U(1)
    v[65:91] = v[97:123]
    v[SPACE] = 0
    return v


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and its inverse modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        _powers[:] = []
        for base in (RADIX, pow(RADIX, -1, 1 << 64)):
            p = np.full(size, U(base))
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=U))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    inside = ~SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(byte_values()[data] * up, dtype=U)])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, first = 0, at
        while at < len(texts) and (at == first or size + len(texts[at]) < CHUNK):
            size += len(texts[at]) + 1
            at += 1
        out += _chunk_sets(texts[first:at], k)
    return out


def _chunk_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(data):
        return [np.zeros(0, U) for _ in texts]
    hashes, starts = word_hashes(data)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, bounds)
    # Every window of k words; those across two texts are cut off below.
    folded = hashes.copy()
    for j in range(1, k):
        folded[: len(folded) - j] = mix(folded[: len(folded) - j] * U(RADIX) + hashes[j:])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(np.unique(folded[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], U)
            for w in hashes[a:b]:
                h = mix(h * U(RADIX) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of T values for each set; EMPTY throughout for the empty set."""
    n = len(sets)
    table = np.full(n * T, EMPTY)
    live = np.flatnonzero([len(s) > 0 for s in sets])
    if not len(live):
        return table.reshape(n, T)
    values = np.concatenate([sets[i] for i in live])
    owner = np.repeat(live, [len(sets[i]) for i in live])
    for i in range(2 * T):
        h = mix(values + U((i * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> U(32)) * U(T) >> U(32)).astype(np.int64) if i < T else np.full(len(h), i - T)
        np.minimum.at(table, owner * T + bins, U(i << 54) | mix(h) >> U(10))
        live = live[(table.reshape(n, T)[live] == EMPTY).any(axis=1)]
        if not len(live):
            break
        keep = np.zeros(n, bool)
        keep[live] = True
        keep = keep[owner]
        values, owner = values[keep], owner[keep]
    return table.reshape(n, T)


def bands(table: np.ndarray) -> np.ndarray:
    """One key for each band of each sketch."""
    parts = table.reshape(len(table), BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=U))[None, :].repeat(len(table), 0)
    for j in range(ROWS):
        key = mix(key * U(RADIX) + parts[:, :, j])
    return key


def bits(table: np.ndarray) -> np.ndarray:
    """One bit of each bin, as words of 64."""
    low = np.zeros((len(table), -(-T // 64) * 64), np.uint8)
    low[:, :T] = (mix(table) & U(1)).astype(np.uint8)
    return np.packbits(low, axis=1, bitorder="little").view(np.int64).reshape(len(table), -1)


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
