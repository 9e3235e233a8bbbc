"""Hashed word shingles of whole texts, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

#: Word separators of the contract: space and tab to carriage return.
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes hashed at a time, and characters of text shingled at a time.
PIECE = 1_000_000
_PLACE = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hashes of the words of a byte array."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def words(self, raw: np.ndarray, space: np.ndarray, trim=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of every word between the places marked as ``space``; ``trim(raw, starts, ends)`` may
        give earlier ends. Long input goes piece by piece, cut between words."""
        parts, at = [], 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            if end < len(raw):
                gaps = np.flatnonzero(space[at:end])
                more = np.flatnonzero(space[end:]) if not len(gaps) else gaps
                end = at + int(gaps[-1]) + 1 if len(gaps) else end + int(more[0]) + 1 if len(more) else len(raw)
            hashes, starts, ends = self._piece(raw[at:end], space[at:end], trim)
            parts.append((hashes, starts + at, ends + at))
            at = end
        if not parts:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _piece(self, raw: np.ndarray, space: np.ndarray, trim) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.concatenate([[False], ~space, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if trim is not None:
            ends = trim(raw, starts, ends)
        if len(raw) > len(self.up):
            self.up, self.down = _powers(_BASE, len(raw)), _powers(_INVERSE, len(raw))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * self.up[: len(raw)])])
        return _mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)), starts, ends


class Shingler:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of texts.

    A-Z are lowered; a text with fewer words is one shingle; a text without words has none.
    """

    def __init__(self, width: int = 5):
        self.width = width
        self.hasher = WordHasher()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array for every text."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end] or "") < PIECE):
                size += len(texts[end] or "")
                end += 1
            out.extend(self._some([t or "" for t in texts[at:end]]))
            at = end
        return out

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        raw = np.frombuffer(b"\n".join([*parts, b""]).translate(_LOWER), dtype=np.uint8)
        words, starts, _ = self.hasher.words(raw, _SPACES[raw])
        first = np.searchsorted(starts, bounds)
        total = np.zeros(max(0, len(words) - self.width + 1), dtype=np.uint64)
        for k in range(self.width):
            total += words[k : k + len(total)] * _PLACE[k]
        hashes = _mix(total)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= self.width:
                out.append(np.unique(hashes[a : b - self.width + 1]))
            elif b > a:
                short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(_mix(np.array([short], dtype=np.uint64)))
            else:
                out.append(hashes[:0])
        return out
