"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

SHINGLE = 4
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so its powers can be inverted modulo 2**64
_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[ord("A") + np.arange(26)] = _LOWER[ord("a") + np.arange(26)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a whole text, A-Z lower-cased, in order."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LOWER[b] * power, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _U(_FACTORS[4]))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; of all words together if there are
    fewer; none without words."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    if len(words) < size:
        x = np.array([len(words)], np.uint64)  # an array, as those wrap around silently
        for k in range(len(words)):
            x = mix(x * _U(_FACTORS[0]) + words[k : k + 1] * _U(_FACTORS[k % 4]))
        return x
    x = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        x = mix(x * _U(_FACTORS[3]) + words[k : len(words) - size + 1 + k]) if k >= 4 else x + words[k : len(words) - size + 1 + k] * _U(_FACTORS[k])
    return np.unique(mix(x))
