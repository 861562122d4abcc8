"""Vectorised word hashing over raw UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in
UTF-8 is the same as the character class ``[^\\x20\\x09-\\x0D]+``.  All
functions work on one contiguous byte buffer, so the cost per byte is a few
numpy passes and no Python loop runs per word.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _byte_table(lane: int) -> np.ndarray:
    seed = np.arange(1, 257, dtype=np.uint64) * _U64(_BASES[lane] | 1)
    return mix64(seed + _U64(0x51ED270B * (lane + 1)))


_TABLES = (_byte_table(0), _byte_table(1))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, grown as needed."""
    have = _POWERS.get(lane)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[lane] | 1
        inverse = pow(base, -1, 1 << 64)
        out = []
        for factor in (base, inverse):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _POWERS[lane] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte buffer."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.concatenate(([False], ~_SPACE[buf], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """One 64-bit hash for each word; two lanes together give 128 bits."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(lane, len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[lane][buf] * power, out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * _U64(_BASES[1 - lane]))


def gram_hashes(words: np.ndarray, size: int, lane: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = _U64(_BASES[lane] | 1)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for i in range(1, size):
            out *= factor
            out += words[i : i + n]
    return mix64(out)


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest key in every window of ``width`` keys.

    Keys are compared by their upper 36 bits, and the leftmost wins a tie, so
    the choice depends only on what the window holds.
    """
    n = len(keys)
    if n < width:
        return np.zeros(0, np.int64)
    packed = (keys >> _U64(28) << _U64(28)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    rest = width - span
    if rest:
        packed = np.minimum(packed[:-rest], packed[rest:])
    return (packed & _U64((1 << 28) - 1)).astype(np.int64)
