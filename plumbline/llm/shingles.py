"""Words and word shingles of a text, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

SHINGLE_WORDS = 5
#: A-Z to a-z on UTF-8 bytes; no byte of a longer sequence is in that range.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(SHINGLE_WORDS)]


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of characters outside space and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(tokens: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles.

    Fewer words than five make one shingle of the whole sequence; no words make
    an empty set. Two different shingles share a 64-bit hash about once in
    10**19 pairs.
    """
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < SHINGLE_WORDS:
        return np.array([xxh3_64_intdigest(b"\x00".join(tokens) + b"\x00" + bytes([n]))], np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, n)
    k = n - SHINGLE_WORDS + 1
    total = each[:k] * _FACTORS[0]
    for i in range(1, SHINGLE_WORDS):
        total = total + each[i : k + i] * _FACTORS[i]
    return np.unique(_mixed(total))
