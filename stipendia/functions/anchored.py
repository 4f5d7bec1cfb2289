"""Many patterns over one text: one scan for literal anchors, full patterns only where an anchor was found.

A pattern that matches must contain one of a few literal strings, its anchors,
read off its parse tree.  The anchors of all patterns form one trie, written
as a single pattern that finds every anchor at every place in one scan.  A text
without any anchor of a pattern cannot match it, so that pattern is not tried.
Patterns without a literal part are always tried.
"""

from __future__ import annotations

import re
import re._constants as kinds
import re._parser as parser
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

_MOST = 64  # strings that one part of a pattern is spelled out into
_FEW = 16  # anchors that are looked for one by one


def _best(*candidates: frozenset | None) -> frozenset | None:
    """The set whose shortest string is longest."""
    usable = [c for c in candidates if c and min(map(len, c)) > 0]
    return max(usable, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _read(items) -> tuple[frozenset | None, frozenset | None]:
    """(all strings the items can match if few and fixed, strings of which any match holds one)."""
    exact, run, needed = True, frozenset([""]), None
    for kind, value in items:
        whole, need = _part(kind, value)
        if whole is not None and len(run) * len(whole) <= _MOST:
            run = frozenset(a + b for a in run for b in whole)
            continue
        needed, run, exact = _best(needed, run, need, whole), frozenset([""]), False
    return (run if exact else None), _best(needed, run)


def _part(kind, value) -> tuple[frozenset | None, frozenset | None]:
    if kind is kinds.LITERAL:
        return frozenset([chr(value)]), None
    if kind is kinds.AT:
        return frozenset([""]), None
    if kind is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
        return frozenset(chr(v) for _, v in value), None
    if kind is kinds.SUBPATTERN:
        return _read(value[-1])
    if kind is kinds.BRANCH:
        read = [_read(branch) for branch in value[1]]
        if all(whole is not None for whole, _ in read):
            whole = frozenset().union(*(w for w, _ in read))
            return (whole, None) if len(whole) <= _MOST else (None, whole)
        needs = [_best(whole, need) for whole, need in read]
        return None, frozenset().union(*needs) if all(needs) else None
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        least, most, inner = value
        whole, need = _read(inner)
        if (least, most) == (0, 1) and whole is not None:
            return whole | {""}, None
        return None, _best(whole, need) if least else None
    return None, None


def anchors(pattern: str) -> frozenset[str] | None:
    """Strings of which every match of the pattern holds at least one; None if there are none to name."""
    return _best(*_read(parser.parse(pattern)))


def may_match(text: Column, pattern: str, fold: bool) -> Column | None:
    """Whether the text holds an anchor of the pattern; None if it has none or too many to look for singly.

    ``fold``: the pattern ignores the case of ASCII letters.

    Looking for a literal costs far less than trying a pattern at every place of the text.
    """
    try:
        found = anchors(pattern)
    except re.error:  # written for the engine that runs it
        found = None
    words = sorted({a.lower() if fold else a for a in found or ()})
    # one that begins another stands for it
    words = [w for w in words if not any(w != v and v in w for v in words)]
    if not 0 < len(words) <= _FEW or fold and not all(w.isascii() for w in words):
        return None
    read = F.lower(text) if fold else text
    return reduce(or_, [F.contains(read, F.lit(w)) for w in words])


def trie(words: list[str]) -> str:
    """A pattern for the longest of the words at a place, common beginnings written once."""
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[:1], []).append(word[1:])
    ends = heads.pop("", None) is not None
    branches = [re.escape(head) + trie(tails) for head, tails in sorted(heads.items())]
    if not branches:
        return ""
    if len(branches) == 1 and not ends:
        return branches[0]
    return f"(?:{'|'.join(branches)}){'?' if ends else ''}"


class Anchored:
    """The anchors of a group of patterns."""

    def __init__(self, patterns: list[str]):
        named = {p: anchors(p) for p in dict.fromkeys(patterns)}
        self.words = sorted({a for found in named.values() for a in found or ()})
        # The longest anchor at a place is read; it stands for those it begins with.
        self.of = {p: [w for w in self.words if w.startswith(tuple(found))] if found else None for p, found in named.items()}

    def scan(self, lowered: Column) -> Column:
        """Array of the anchors in a lower-case text.  A look-ahead reads at every place, so anchors may overlap."""
        return F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?=({trie(self.words)}))"), F.lit(1)))

    def possible(self, found: Column, *patterns: str) -> Column:
        """Whether any of the patterns can match a text with these anchors."""
        if any(self.of[p] is None for p in patterns):
            return F.lit(True)
        wanted = sorted({a for p in patterns for a in self.of[p]})
        return F.arrays_overlap(found, F.array(*map(F.lit, wanted)))
