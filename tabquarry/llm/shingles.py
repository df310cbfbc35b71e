"""Word shingles of whole texts as 64-bit hashes, a text at a time in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""
    if len(_powers[0]) < n:
        m = max(1 << 16, 1 << n.bit_length())
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_sums(raw: bytes) -> np.ndarray:
    """Sums s with hash of raw[i:j] = (s[j] - s[i]) * inverse power i."""
    b = np.frombuffer(raw, np.uint8)
    up, _ = _tables(len(b) + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LETTER[b] * up[: len(b)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _tables(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of UTF-8 bytes, in order."""
    if not raw:
        return np.zeros(0, np.uint64)
    blank = np.empty(len(raw) + 2, bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = _BLANK[np.frombuffer(raw, np.uint8)]
    edges = np.nonzero(blank[1:] != blank[:-1])[0]
    return range_hashes(prefix_sums(raw), edges[::2], edges[1::2])


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles, A-Z lowered; of a shorter text its whole sequence; else empty."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h += w[i : len(w) - n + 1 + i] * _PLACE[i]
    return np.unique(mix(h))
