"""64-bit hashes of the words of many texts at once, by prefix sums over their bytes.

A word is a maximal run of bytes other than space and \\t..\\r (so it may hold any other character).  The hash of
a word is the sum of T[byte] * R**place modulo 2**64, taken as a difference of running sums and shifted back to
place 0 by the inverse power; no Python runs per word.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import SLICE_BYTES, slices

_R = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = (1 << 64) - 1


def _table(lower: bool) -> np.ndarray:
    t = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLES = {low: _table(low) for low in (False, True)}
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**j and R**-j for j < n; kept for usual slices, made anew for an oversized one."""
    kept = _POWERS.get("r")
    if kept is not None and len(kept) >= n:
        return _POWERS["r"], _POWERS["i"]
    size = max(n, 2 * SLICE_BYTES)
    made = []
    for base in (_R, _INV):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if size == 2 * SLICE_BYTES:
        _POWERS["r"], _POWERS["i"] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _hashed(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    heads = offsets[:-1][offsets[:-1] < n]
    start[heads] = word[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    end[tails] = word[tails]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLES[lower][data] * power[:n], out=total[1:], dtype=np.uint64)
    return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)), np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word of each text with the total at the end)."""
    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:  # one very long text: cut between words
        parts, at = [], 0
        while at < len(data):
            to = at + SLICE_BYTES
            if to < len(data):
                gap = np.flatnonzero(_SPACE[data[to : to + SLICE_BYTES]])
                while not len(gap) and to + SLICE_BYTES < len(data):
                    to += SLICE_BYTES
                    gap = np.flatnonzero(_SPACE[data[to : to + SLICE_BYTES]])
                to = to + int(gap[0]) if len(gap) else len(data)
            piece = data[at:to]
            parts.append(_hashed(piece, np.array([0, len(piece)]), lower)[0])
            at = to
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return h, np.array([0, len(h)])
    return _hashed(data, offsets, lower)


def each_slice(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """(i, j, hashes, firsts) for runs of texts [i, j)."""
    for i, j in slices(offsets):
        h, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        yield i, j, h, first


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (across text borders too: callers cut those off)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, (k * 0xD6E8FEB86659FD93) & _MASK, np.uint64)
    for p in range(k):
        total = (total + h[p : p + n]) * _R
        total ^= total >> np.uint64(29)
    return mix(total)
