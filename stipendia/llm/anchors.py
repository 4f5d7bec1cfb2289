"""Content-chosen anchors: where repeats of at least ``LENGTH`` bytes can be compared.

Each window of ``LENGTH`` bytes is assigned to the smallest hash among the
``GRAM``-byte strings inside it, the leftmost of equals.  That choice
depends on the bytes of the window alone, so equal windows anywhere have equal
anchors at equal places.  Consecutive windows with one anchor form a run; its
bytes reach from the first window's start to the last one's end.
"""

from __future__ import annotations

import numpy as np

from stipendia.llm.shingles import mixed

LENGTH = 100
GRAM = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each position; ``width`` is a power of two."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < width:
        h = h[:-size] * np.uint64(pow(int(_BASE), size, 1 << 64)) + h[size:]
        size *= 2
    return mixed(h)


def _chosen(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash at each place, place of the anchor of each window); ``gram`` is a power of two."""
    n = len(data) - length + 1
    hashes = gram_hashes(data, gram)
    reach = length - gram + 1  # grams in a window
    bits = np.uint64(max(1, (len(hashes) - 1).bit_length()))
    key = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        key = np.minimum(key[:n], key[reach - width:reach - width + n])
    anchor = (key[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return hashes, anchor


def places(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Anchor hash of every run of a text, without the work of telling runs apart."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    hashes, anchor = _chosen(data, length, gram)
    return hashes[anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])]]


_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor position, first window, last window, hash of the run's bytes and anchor place) of a text."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64))
    hashes, anchor = _chosen(data, length, gram)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], n) - 1
    at = anchor[first]
    powers = np.multiply.accumulate(np.full(len(data), _BASE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), _BACK, np.uint64)]))
    content = (total[last + length] - total[first]) * back[first]
    digest = mixed(mixed(content ^ ((last - first).astype(np.uint64) << np.uint64(32))) + (at - first).astype(np.uint64))
    return hashes[at], at, first, last, digest
