"""The public XXH64 hash over many short byte ranges at once."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
# The five primes of XXH64.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges from this length on go one by one to the library.
LONG = 512


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hashes of ``data[start:end]`` for each range."""
    size = ends - starts
    out = np.empty(len(starts), U64)
    if len(starts) == 0:
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words8 = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    words4 = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    with np.errstate(over="ignore"):
        s = U64(seed)
        h = np.full(len(starts), s + P5, U64)
        at = starts.copy()
        wide = np.flatnonzero((size >= 32) & (size < LONG))
        if len(wide):
            acc = [np.full(len(wide), x, U64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            stripes = size[wide] // 32
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                p = at[wide[on]] + 32 * k
                for i in range(4):
                    acc[i][on] = _round(acc[i][on], words8[p + 8 * i])
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros(len(wide), U64), a)) * P1 + P4
            h[wide] = x
            at[wide] += 32 * stripes
        h += size.astype(U64)
        left = np.where(size < LONG, ends - at, 0)
        for k in range(int(left.max()) // 8):
            on = np.flatnonzero(left >= 8 * (k + 1))
            lane = words8[at[on] + 8 * k]
            h[on] = _rotl(h[on] ^ _round(np.zeros(1, U64), lane), 27) * P1 + P4
        at += left // 8 * 8
        left = left % 8
        on = np.flatnonzero(left >= 4)
        h[on] = _rotl(h[on] ^ (words4[at[on]].astype(U64) * P1), 23) * P2 + P3
        at[on] += 4
        left = left % 4
        for k in range(3):
            on = np.flatnonzero(left > k)
            h[on] = _rotl(h[on] ^ (padded[at[on] + k].astype(U64) * P5), 11) * P1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        out[:] = h ^ (h >> U64(32))
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out
