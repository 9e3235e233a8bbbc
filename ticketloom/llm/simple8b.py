"""Simple-8b: unsigned integers packed into 64-bit words.

A word's top four bits select how many values of how many bits its other 60 bits hold. Selector 0 is the escape for a
value of more than 60 bits: the value itself is the next word. The last word of a block is padded with zeros, so a block
is read with its count of values and the places of its escapes.
"""

from __future__ import annotations

import numpy as np

#: Selector k + 1 packs COUNTS[k] values of BITS[k] bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // c for c in COUNTS)
ESCAPE = 0
_LIMITS = np.array([1 << b for b in BITS], dtype=np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Per value the first k whose BITS[k] hold it; len(BITS) where none does."""
    if len(values) and int(values.max()) < len(_SMALL):
        return _SMALL[values]
    return np.searchsorted(_LIMITS, values.astype(np.uint64), side="right").astype(np.uint8)


def _window_max(widths: np.ndarray) -> dict[int, np.ndarray]:
    """For every count c: the widest of the c values from each place on; places past the end need no bits."""
    out = {1: widths}
    for c in sorted(COUNTS)[1:]:
        a = max(x for x in out if x < c and c - x in out)
        tail = out[c - a]
        shifted = np.zeros_like(tail)
        shifted[: len(tail) - a] = tail[a:] if a < len(tail) else 0
        out[c] = np.maximum(out[a], shifted)
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, indexes of the escape words). Each word takes as many of the next values as fit."""
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype=np.int32)
    widths = _widths(values)
    widest = _window_max(widths)
    take = np.zeros(n, dtype=np.uint8)
    for k, c in enumerate(COUNTS):
        np.maximum(take, np.where(widest[c] <= k, np.uint8(c), np.uint8(0)), out=take)
    step, starts, at = take.tobytes(), [], 0
    while at < n:
        starts.append(at)
        at += step[at] or 1
    start = np.array(starts, dtype=np.int64)
    count = take[start]
    raw = count == 0
    place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(raw)[:-1]])
    words = np.zeros(len(start) + int(raw.sum()), dtype="<u8")
    padded = np.concatenate([values.astype(np.uint64), np.zeros(max(COUNTS), dtype=np.uint64)])
    for k, (c, bits) in enumerate(zip(COUNTS, BITS)):
        mine = np.flatnonzero(count == c)
        if not len(mine):
            continue
        word = np.full(len(mine), (k + 1) << 60, dtype=np.uint64)
        for j in range(c):
            word |= padded[start[mine] + j] << np.uint64(bits * j)
        words[place[mine]] = word
    words[place[raw] + 1] = padded[start[raw]]
    return words, place[raw].astype(np.int32)


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The ``n`` values, all words of one selector at a time."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), dtype=bool)
    raw[np.asarray(escapes, dtype=np.int64) + 1] = True
    held = np.array((1, *COUNTS, 0), dtype=np.int64)[selector]
    held[raw] = 0
    ends = np.cumsum(held)
    out = np.zeros(max(COUNTS) + (int(ends[-1]) if len(ends) else 0), dtype=np.uint64)
    begin = ends - held
    for k, (c, bits) in enumerate(zip(COUNTS, BITS)):
        mine = np.flatnonzero((selector == k + 1) & ~raw)
        if not len(mine):
            continue
        mask, word, at = np.uint64((1 << bits) - 1), words[mine], begin[mine]
        for j in range(c):
            out[at + j] = (word >> np.uint64(bits * j)) & mask
    out[begin[raw] - 1] = words[raw]
    return out[:n]
