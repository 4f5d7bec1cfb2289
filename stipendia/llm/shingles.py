"""Word shingles of a text as sets of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_REMEMBERED = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of ``width`` words; A-Z count as a-z, words are runs without ASCII white space."""

    def __init__(self, width: int = 5):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes: none without words, one of the whole sequence with fewer than ``width``."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > _REMEMBERED:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        total = hashes[:len(hashes) - width + 1].copy()
        for i in range(1, width):
            total = mixed(total * _PRIME + hashes[i:len(hashes) - width + 1 + i])
        return np.unique(total if width == self.width else mixed(total + np.uint64(width)))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
