"""Plain single-process versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, width: int = 5) -> set:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle: dict = {}
    for i, s in sorted(sets.items()):
        shared: dict = {}
        for x in s:
            for j in by_shingle.get(x, ()):
                shared[j] = shared.get(j, 0) + 1
            by_shingle.setdefault(x, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def repeated(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, bytes]]:
    """doc_id -> bytes, bytes removed, removed runs, bytes left."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p:p + length]
            if window in seen:
                gone[p:p + length] = b"\x01" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(data), len(data) - len(kept), spans, kept)
    return out
