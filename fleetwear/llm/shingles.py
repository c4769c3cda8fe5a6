"""Hashed word shingles of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: One random number per byte value; upper-case letters share that of their lower-case form.
VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, np.uint64)
VALUES[65:91] = VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def forget() -> None:
    """Drop the powers, which are as long as the longest slab."""
    for base in _powers:
        _powers[base] = np.ones(1, np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers[base]
    if len(have) < n:
        size = max(n, 2 * len(have))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte array, and where each begins."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = SPACE[data]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    raw = (sums[end] - sums[begin]) * powers(INVERSE, len(data))[begin]
    return mix(raw + (end - begin).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), begin


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; with fewer words the whole sequence is one.

    The texts are hashed in one array, a line feed between them.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    words, begin = word_hashes(data)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    last = np.searchsorted(begin, ends)
    first = np.concatenate(([0], last[:-1])) if len(last) else last
    rows = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rows = mix(rows + words[k:k + len(rows)] * np.uint64(2 * k + 3))
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rows[a:b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[k:k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
