"""External induced suffix sorting with common-prefix values, for one shard of text.

A shard is a sequence of strings, each closed by a 0 that differs from every
other 0 (earlier ones are smaller).  Suffixes are L if larger than their
successor, else S.  The leftmost S of each S stretch are ranked by naming the
substrings between them and sorting the string of names: by this same routine
if it is long, in memory once it has at most ``small`` names.  From these
seeds the L suffixes are induced in rising and the S suffixes in falling order.

Induction runs through a priority queue on disk.  Its key is the first
character, then the rank of the suffix behind it; since suffixes leave in
rank order, entries of one character arrive sorted, so the queue is a list of
sorted runs a character, which go to files beyond ``memory`` entries and are read
back run by run.  An entry is a suffix tuple: its place and the length of the
prefix it shares with the entry before, one more than the least such length
among the suffixes between their sources.  Lengths count up to ``cap``.
"""

from __future__ import annotations

import tempfile

import numpy as np

CHUNK = 1 << 18  # entries handled at once


class DiskQueue:
    """Sorted runs of (place, shared prefix) for each character; beyond ``memory`` entries they wait in a file."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file, self.spilled = memory, 0, None, 0
        self.runs: dict[int, list] = {}

    def push(self, character: int, places: np.ndarray, shared: np.ndarray | None) -> None:
        self.runs.setdefault(character, []).append((places, shared))
        self.held += len(places)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """Write what is in memory.  The file has no name and goes with the task, which is rerun whole if it is lost."""
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs.values():
            for k, run in enumerate(runs):
                if isinstance(run[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(run[0].tobytes())
                    if run[1] is not None:
                        self.file.write(run[1].tobytes())
                    runs[k] = (at, len(run[0]), run[1] is not None)
                    self.spilled += len(run[0])
        self.held = 0

    def pop(self, character: int):
        """The oldest run of a character in pieces of at most ``CHUNK``, or None."""
        runs = self.runs.get(character)
        if not runs:
            self.runs.pop(character, None)
            return None
        run = runs.pop(0)
        if isinstance(run[0], np.ndarray):
            self.held -= len(run[0])
            places, shared = run
        else:
            self.file.seek(run[0])
            places = np.frombuffer(self.file.read(8 * run[1]), np.int64)
            shared = np.frombuffer(self.file.read(run[1]), np.uint8) if run[2] else None
        if len(places) > CHUNK:
            runs.insert(0, (places[CHUNK:], None if shared is None else shared[CHUNK:]))
            self.held += len(places) - CHUNK
            places, shared = places[:CHUNK], None if shared is None else shared[:CHUNK]
        return places, shared

    def close(self) -> None:
        if self.file:
            self.file.close()


def _refined(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split groups of equal rank (the number of smaller ones) by ``key``; returns the members still in groups."""
    order = np.lexsort((key, rank[active]))
    members, sorted_key, base = active[order], key[order], rank[active][order]
    group = np.concatenate([[True], base[1:] != base[:-1]])
    fresh = group | np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    at = np.arange(len(members))
    start = np.maximum.accumulate(np.where(group, at, 0))
    first = np.maximum.accumulate(np.where(fresh, at, 0))
    rank[members] = base + first - start
    alone = fresh & np.append(fresh[1:], True)
    return members[~alone]


class _Shard:
    def __init__(self, text: np.ndarray, cap: int, memory: int, small: int, with_shared: bool):
        self.text, self.cap, self.memory, self.small, self.with_shared = text, cap, memory, small, with_shared
        n = len(text)
        kind = np.int32 if n < 1 << 31 else np.int64
        ends = np.append(text[1:] != text[:-1], True) | (text == 0)
        next_differing = np.minimum.accumulate(np.where(ends, np.arange(n, dtype=kind), kind(n - 1))[::-1])[::-1]
        after = np.append(text[1:], 0)
        self.is_s = (text == 0) | (text[next_differing] < after[next_differing])
        self.zeros = np.flatnonzero(text == 0)
        self.words = self._words() if text.dtype == np.uint8 else None
        self.spilled = 0

    def _words(self) -> np.ndarray:
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        word = np.zeros(len(self.text), np.uint64)
        for b in range(8):
            word <<= np.uint64(8)
            word |= padded[b:b + len(self.text)]
        return word

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix of suffix pairs, compared eight characters at a time; ends of strings differ."""
        room = np.minimum(*(self.zeros[np.searchsorted(self.zeros, p)] - p for p in (x, y)))
        room = np.minimum(room, self.cap)
        out, open_pairs = room.copy(), np.arange(len(x))
        for d in range(0, self.cap, 8):
            open_pairs = open_pairs[room[open_pairs] > d]
            if not len(open_pairs):
                break
            differing = self.words[x[open_pairs] + d] ^ self.words[y[open_pairs] + d]
            unequal = differing != 0
            which, bits = open_pairs[unequal], differing[unequal]
            same = np.zeros(len(which), np.int64)
            for b in range(1, 8):
                same += (bits >> np.uint64(64 - 8 * b)) == 0
            out[which] = np.minimum(room[which], d + same)
            open_pairs = open_pairs[~unequal]
        return out.astype(np.uint8)

    # --- seeds ---------------------------------------------------------------------------------------------------

    def seeds(self) -> np.ndarray:
        """Leftmost S suffixes other than ends, sorted."""
        text, is_s = self.text, self.is_s
        lms = np.flatnonzero(is_s[1:] & ~is_s[:-1] & (text[1:] != 0)) + 1
        if not len(lms):
            return lms
        every = np.union1d(lms, self.zeros)
        end = every[np.searchsorted(every, lms, side="right")]
        length = end - lms + 1
        rank, active = np.zeros(len(lms), np.int64), np.arange(len(lms))
        step = 8 if self.words is not None else 1
        for d in range(0, int(length.max()), step):
            # A substring that ends first has an S there and the longer one an L, so past its end it counts as larger.
            if self.words is not None:
                left = np.clip(length[active] - d, 0, 8)
                key = np.where(left > 0, self.words[np.minimum(lms[active] + d, len(text) - 1)], np.uint64(0))
                pad = np.array([(1 << 8 * (8 - k)) - 1 for k in range(9)], np.uint64)
                key = key | pad[left]
            else:
                key = np.where(length[active] > d, text[np.minimum(lms[active] + d, len(text) - 1)], np.iinfo(np.int64).max)
            active = _refined(rank, active, key)
            if not len(active):
                return lms[np.argsort(rank)]
        names = np.zeros(len(every), np.int64)
        names[np.searchsorted(every, lms)] = np.unique(rank, return_inverse=True)[1] + 1
        if len(names) <= self.small:
            order = _doubled(names)
        else:
            inner = _Shard(names, self.cap, self.memory, self.small, False)
            order = np.concatenate([places for places, _ in inner.sorted_suffixes()] or [np.zeros(0, np.int64)])
            self.spilled += inner.spilled
        order = order[names[order] != 0]
        return every[order]

    # --- induction -----------------------------------------------------------------------------------------------

    def sorted_suffixes(self):
        """Yields (places, shared prefix with the suffix before) in rising order, characters together, ends left out."""
        text, seeds = self.text, self.seeds()
        present = np.unique(text)
        seed_shared = np.zeros(len(seeds), np.uint8)
        if self.with_shared and len(seeds) > 1:
            seed_shared[1:] = self.shared(seeds[:-1], seeds[1:])
        cuts = np.searchsorted(text[seeds], present, side="left"), np.searchsorted(text[seeds], present, side="right")
        larger: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}
        queue, least = DiskQueue(self.memory), _Least(present)
        for k, c in enumerate(present.tolist()):
            if c == 0:
                for start in range(0, len(self.zeros), CHUNK):
                    part = self.zeros[start:start + CHUNK]
                    self._induce(queue, least, part, np.zeros(len(part), np.uint8), False)
                continue
            done = self._drain(queue, least, c, False)
            larger[c] = done
            lo, hi = int(cuts[0][k]), int(cuts[1][k])
            if hi > lo:
                places, shared = seeds[lo:hi], seed_shared[lo:hi].copy()
                shared[0] = self.shared(done[0][-1:], places[:1])[0] if self.with_shared and len(done[0]) else 0
                for start in range(0, len(places), CHUNK):
                    self._induce(queue, least, places[start:start + CHUNK], shared[start:start + CHUNK], False)
        self.spilled += queue.spilled
        queue.close()
        queue, least = DiskQueue(self.memory), _Least(present)
        finished: list[tuple] = []
        for c in present[::-1].tolist():
            if c == 0:
                continue
            s_places, s_shared = self._drain(queue, least, c, True)
            l_places, l_shared = larger[c]
            seam = 0
            if self.with_shared and len(s_places) and len(l_places):
                seam = self.shared(l_places[-1:], s_places[-1:])[0]
            if len(l_places):
                falling = l_places[::-1]
                to_right = np.append(l_shared[1:], np.uint8(seam))[::-1] if self.with_shared else None
                for start in range(0, len(falling), CHUNK):
                    self._induce(queue, least, falling[start:start + CHUNK], None if to_right is None else to_right[start:start + CHUNK], True)
            places = np.concatenate([l_places, s_places[::-1]])
            shared = None
            if self.with_shared:
                # An S entry shares its value with its right neighbour; moved by one it is that of the neighbour with it.
                shared = np.concatenate([l_shared, [seam], s_shared[::-1][:-1]])[:len(places)] if len(s_places) else l_shared
            finished.append((places, shared))
        self.spilled += queue.spilled
        queue.close()
        yield from reversed(finished)

    def _drain(self, queue: DiskQueue, least: "_Least", c: int, smaller: bool):
        """All entries of one character, those they add to it included."""
        out = []
        while (run := queue.pop(c)) is not None:
            out.append(run)
            self._induce(queue, least, *run, smaller)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]) if self.with_shared else None

    def _induce(self, queue: DiskQueue, least: "_Least", places: np.ndarray, shared: np.ndarray | None, smaller: bool) -> None:
        """Put the predecessors of sorted suffixes that are of the wanted type into the queue."""
        before = places - 1
        wanted = np.flatnonzero((before >= 0) & (self.is_s[before] == smaller) & (self.text[before] != 0))
        if not len(wanted):
            if self.with_shared:
                least.saw(shared)
            return
        target = self.text[before[wanted]]
        order = np.argsort(target, kind="stable")
        sources, target = wanted[order], target[order]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        values = least.between(shared, sources, target, heads, self.cap) if self.with_shared else None
        moved, ends = before[sources], np.append(heads[1:], len(sources))
        for lo, hi in zip(heads.tolist(), ends.tolist()):
            queue.push(int(target[lo]), moved[lo:hi], None if values is None else values[lo:hi])


class _Least:
    """For each character the least shared prefix seen since its last entry; 0 before the first."""

    def __init__(self, present: np.ndarray):
        self.present = present
        self.since = np.zeros(len(present), np.uint8)
        self.begun = np.zeros(len(present), bool)

    def saw(self, shared: np.ndarray) -> None:
        np.minimum(self.since, shared.min(), out=self.since)

    def between(self, shared, sources, target, heads, cap) -> np.ndarray:
        padded = np.append(shared, np.uint8(255))
        start = np.concatenate([[0], sources[:-1] + 1])
        start[heads] = 0
        least = np.minimum.reduceat(padded, np.stack([start, sources + 1], axis=1).ravel())[::2]
        slot = np.searchsorted(self.present, target[heads])
        # An empty range would mean two entries from one source, which cannot be.
        least[heads] = np.minimum(least[heads], self.since[slot])
        out = np.minimum(least.astype(np.int64) + 1, cap).astype(np.uint8)
        out[heads[~self.begun[slot]]] = 0
        tails = sources[np.append(heads[1:], len(sources)) - 1]
        np.minimum(self.since, shared.min(), out=self.since)
        rest = np.minimum.accumulate(padded[::-1])[::-1]
        self.since[slot] = rest[tails + 1]
        self.begun[slot] = True
        return out


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names in memory, by doubling the compared length; zeros all differ."""
    zeros = np.flatnonzero(names == 0)
    values, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    rank[zeros] = np.arange(len(zeros))
    active, reach = np.flatnonzero((counts[inverse] > 1) & (names != 0)), 1
    while len(active):
        active = _refined(rank, active, rank[np.minimum(active + reach, len(names) - 1)].copy())
        reach *= 2
    return np.argsort(rank)


def repeats(text: np.ndarray, length: int, memory: int = 1 << 17, small: int = 1 << 22) -> np.ndarray:
    """For a shard of bytes (1 to 254, strings closed by 0): True where the ``length`` bytes from a place also start
    at an earlier place of the shard."""
    found = np.zeros(len(text), bool)
    shard = _Shard(text, length, memory, small, True)
    for places, shared in shard.sorted_suffixes():
        if not len(places):
            continue
        heads = np.flatnonzero(np.concatenate([[True], shared[1:] < length]))
        first = np.repeat(np.minimum.reduceat(places, heads), np.diff(np.append(heads, len(places))))
        found[places[places != first]] = True
    return found
