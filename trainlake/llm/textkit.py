"""Vectorised hashing of words and bytes with numpy, used inside Spark tasks.

All hashes are polynomial in an odd base modulo 2**64. As the base can be inverted, the hash of any stretch is
a difference of prefix sums: no loop over characters or words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than space, tab, line and form feeds) of all texts in order, and
    offsets: text i has the words offsets[i] to offsets[i+1]."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    white = _WHITE[data]
    before = np.empty_like(white)
    before[0] = True
    before[1:] = white[:-1]
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(white & ~before)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, limits)


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` neighbours; item i is the run that begins at i."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        total = total * np.uint64(_BASE) + values[k : k + n]
    return mix(total + np.uint64(length))


def slices(sizes: list[int], most: int):
    """(first, last) of stretches whose sizes add up to about ``most``; one item may be larger by itself."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def cut_points(data: bytes, window: int = 32, bits: int = 10, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of content-defined chunks: after a ``window`` of bytes whose hash begins with ``bits`` zeros, if the
    chunk has ``least`` bytes; after ``most`` bytes at the latest. Depends on nothing but the bytes."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * _power(_BASE, n), out=sums[1:])
    found = mix((sums[window:] - sums[:-window]) * _power(_INVERSE, n)[: n + 1 - window])
    ends, last = [], 0
    for end in [*(np.flatnonzero(found >> np.uint64(64 - bits) == 0) + window).tolist(), n]:
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= least or (end == n and end > last):
            ends.append(end)
            last = end
    return ends
