"""Word shingles as 64-bit hashes, computed for a batch of texts at once with numpy.

A word is a maximal run of letters, digits or underscores of the lower-cased text. A text of one to four words has one
shingle, all its words; a text without words (or null) has none.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORDS = 5
_GAPS = re.compile(r"\W+")
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word, in order."""
    joined = _GAPS.sub(" ", (text or "").lower()).strip()
    if not joined:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    powers, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(raw)]))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_P) + w[k:len(w) - n + 1 + k]
    return np.unique(mix(total + np.uint64(n)))


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit key of a shingle set: equal sets, equal keys."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
