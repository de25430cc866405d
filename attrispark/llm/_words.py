"""Vectorised word scanning of UTF-8 buffers.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return.  Those are ASCII, so byte runs are the
code-point runs of the pattern [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

import numpy as np

#: Texts are scanned together up to this many bytes.
CHUNK = 1 << 18

_GOLD = 0x9E3779B97F4A7C15
_ODD1, _ODD2, _ODD3 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) of 64-bit words."""
    x = x + np.uint64(_GOLD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 8 * CHUNK:
            return have
        _POWERS[base] = have
    return have[:n]


def spans(hash_in: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of hash_in[s:e] for each pair, independent of its place."""
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(len(hash_in) + 1, np.uint64)
    np.cumsum(hash_in * powers(base, len(hash_in)), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse, len(hash_in) + 1)[starts]


def batches(texts: list[bytes], most: int = CHUNK):
    """(first, last, bytes, offsets): runs of texts joined up to `most` bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i, b"".join(texts[first:i]), np.cumsum([0, *map(len, texts[first:i])])
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts), b"".join(texts[first:]), np.cumsum([0, *map(len, texts[first:])])


def words(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of the joined texts."""
    b = np.frombuffer(data, np.uint8)
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(b), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(b), bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(spans(_BYTE[b], starts, ends, _ODD1) ^ ((ends - starts).astype(np.uint64) * np.uint64(_GOLD)))


def window_hashes(h: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of each run of `size` successive word hashes; `second` gives an independent one."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    if second:
        return mix(spans(mix(h ^ np.uint64(_ODD2)), at, at + size, _ODD3))
    return mix(spans(h, at, at + size, _ODD2))


def byte_window_hashes(data: bytes, size: int) -> np.ndarray:
    """Hash of each substring of `size` bytes."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mix(spans(_BYTE[b], at, at + size, _ODD3))
