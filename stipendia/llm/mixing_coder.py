"""Adaptive context-mixing range coder for blocks of token ids.

Many blocks are coded side by side: the arrays of a step have one entry a block
(lane), and step t codes the t-th id of every lane, so numpy does the work and
each block stays independent and starts from the same empty model.

The ids last seen after the same two ids (order 2) and after the same id
(order 1) are predictions; the one with the surer context is the guess.
Whether it hits is one binary decision whose chance mixes three adaptive
estimates: of the whole block (order 0), of the order-1 context and of the
order-2 context, weighted by how well each did before.  The ids of the misses
are known apart from the guesses, so they form a second stream: the upper six
bits and the length of each under the order-0 frequencies of its block, which
its header holds, and the lower bits, which are close to even, as they are.

Words of 16 bits are coded.  All arithmetic on chances is on integers, so that
every machine decodes alike.

A block is: length of its frequencies (2 bytes, the highest bit set if an id has
more than 16 bits), number of ids, their CRC-32 as little-endian unsigned 32-bit
integers, number of misses, words of the misses'
symbols, words of the hits (4 bytes each); frequencies of four bits, both
strings of words, lower bits in words of 32.  An empty block ends after the
check sum.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SLOTS = 9                  # bits of a context slot
CHANCE = 12                # bits of a probability
ONE = (1 << CHANCE) - 1
FIRST = 1 << (CHANCE - 2)  # chance before anything is known
RATE = 4                   # adaptation of an estimate
REVISED = 16               # steps after which weights and the order-0 chance are revised
GROWTH = ONE >> RATE       # what a hit adds; with the rounding of shifts, chances stay between 15 and 4079
TOTAL = 11                 # bits of the sum of a block's symbol frequencies
EXACT = 6                  # upper bits of an id that its symbol holds
TOGETHER = 64              # blocks whose lower bits are packed at once
_HEAD, _MORE = struct.Struct("<HII"), struct.Struct("<III")
# What the four bits of a frequency stand for, relative to the largest.
_SCALE = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192])
_LEVEL = np.searchsorted(_SCALE, np.arange(193))
_MASKS = (1 << np.arange(33)) - 1
_S16, _W16, _LOW16 = np.array(16, np.uint32), np.array(16, np.uint64), np.array(0xFFFF, np.uint64)


class _Writer:
    """Range encoder with one state a lane.  A carry stays in bit 16 of a word until ``finished``."""

    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFF, np.uint32)
        self.words = np.zeros((lanes, room + 3), np.uint32)
        self.flat, self.first = self.words.reshape(-1), np.arange(lanes) * (room + 3)
        self.at = self.first.copy()

    def shift(self, at: np.ndarray) -> None:
        """Write a word of the lanes ``at``, whose range has become small."""
        low, place = self.low[at], self.at[at]
        self.flat[place] = low >> _W16
        self.low[at] = (low & _LOW16) << _W16
        self.range[at] <<= _S16
        self.at[at] = place + 1

    def finished(self) -> list[bytes]:
        every = np.arange(len(self.at))
        self.shift(every)
        self.shift(every)
        used = (self.at - self.first).tolist()
        words = self.words[:, :max(used, default=0)]
        while (words >> 16).any():
            words[:, :-1] = (words[:, :-1] & 0xFFFF) + (words[:, 1:] >> 16)
            words[:, -1] &= 0xFFFF
        words = words.astype("<u2")
        return [row[:n].tobytes() for row, n in zip(words, used)]


class _Reader:
    """Range decoder; ``rest`` is the coded value less the start of the range."""

    def __init__(self, data: list[bytes]):
        room = max(map(len, data), default=0) // 2 + 3
        words = np.zeros((len(data), room), "<u2")
        for row, value in zip(words, data):
            row[:len(value) // 2] = np.frombuffer(value, "<u2")
        self.flat = words.reshape(-1).astype(np.uint32)
        self.rest, self.range = (words[:, 0].astype(np.uint32) << 16) | words[:, 1], np.full(len(data), 0xFFFFFFFF, np.uint32)
        self.at = np.arange(len(data)) * room + 2

    def shift(self, at: np.ndarray) -> None:
        place = self.at[at]
        self.rest[at] = (self.rest[at] << _S16) | self.flat.take(place, mode="clip")
        self.range[at] <<= _S16
        self.at[at] = place + 1


def _prefixes(counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(first step, step after the last, lanes that have these steps) for lanes sorted by falling count."""
    steps = int(counts.max(initial=0))
    active = np.searchsorted(-counts, -np.arange(steps), side="left")
    cuts = [0, *(np.flatnonzero(np.diff(active)) + 1).tolist(), steps] if steps else [0]
    return [(a, b, int(active[a])) for a, b in zip(cuts[:-1], cuts[1:])]


def _hits(coder: _Writer | _Reader, lengths: np.ndarray, ids: np.ndarray, misses: np.ndarray | None, first: np.ndarray | None) -> np.ndarray:
    """Code which guesses hit, step by step; lanes are sorted by falling length, so the active ones are a prefix.

    ``ids`` has one row a step.  A writer reads it; a reader fills it, with the next of ``misses`` (those of a lane from
    ``first`` on) where no guess hits.  Gives the places of the misses, one row a step.
    """
    writing, (steps, lanes), kind = isinstance(coder, _Writer), ids.shape, ids.dtype.type
    missed = np.zeros((steps, lanes), bool)
    # An entry of the table is how sure a context is, above the id last seen in it; order 1 in the first half.
    half = 4 * ids.itemsize
    table = np.full(2 * lanes << SLOTS, FIRST << half, kind)
    places = (np.arange(2 * lanes, dtype=kind) << kind(SLOTS)).reshape(2, lanes)
    usual, trust = np.full(lanes, FIRST, np.int32), np.full((3, lanes), 64, np.int32)
    last, earlier = np.zeros(lanes, kind), np.zeros(lanes, kind)
    # Arrays of no dimensions cost numpy less than plain numbers, and arrays of one type less than of several.
    factor, mix, top = (np.array(v, kind) for v in (0x9E3779B1 if half == 16 else 0x9E3779B97F4A7C15, 7, 2 * half - SLOTS))
    up, low_half, rate, grow = (np.array(v, kind) for v in (half, (1 << half) - 1, RATE, GROWTH))
    eight, chance_bits, limit = np.array(8, kind), np.array(CHANCE, np.uint32), np.array(0x10000, np.uint32)
    for since, until, n in _prefixes(lengths):
        place, span, before, seen = places[:, :n].copy(), coder.range[:n], earlier[:n], last[:n]
        low, rest, here = (coder.low[:n], None, None) if writing else (None, coder.rest[:n], first[:n])
        hashes, entries, sure, terms, weights = (np.empty((2, n), kind) for _ in range(5))
        one_hash, two_hash, one_entry, two_entry, one_term, two_term = *hashes, *entries, *terms
        all_entries, all_sure, slots, same = entries.reshape(-1), sure.reshape(-1), np.empty(2 * n, np.int64), np.empty((2, n), bool)
        by_order, small = slots.reshape(2, n), np.empty(n, bool)
        guess, mixed, base, other = (np.empty(n, kind) for _ in range(4))
        chance, bound, spare, away = (np.empty(n, np.uint32) for _ in range(4))
        apart = away if kind is np.uint32 else np.empty(n, kind)

        def weigh():
            share = (trust[1:, :n] << 8) // trust[:, :n].sum(axis=0)
            weights[:] = share
            base[:] = (256 - share[0] - share[1]) * usual[:n]

        weigh()
        for t in range(since, until):
            value, miss = ids[t, :n], missed[t, :n]
            np.multiply(seen, factor, one_hash)
            np.bitwise_xor(one_hash, before, two_hash)
            np.right_shift(one_hash, mix, before)
            np.right_shift(hashes, top, hashes)
            np.add(place, hashes, hashes)
            np.copyto(by_order, hashes, "unsafe")
            table.take(slots, None, all_entries, "clip")
            np.right_shift(entries, up, sure)
            np.maximum(one_entry, two_entry, guess)   # that of the surer context
            np.bitwise_and(guess, low_half, guess)
            np.multiply(weights, sure, terms)
            np.add(one_term, two_term, mixed)
            np.add(mixed, base, mixed)
            np.right_shift(mixed, eight, chance, casting="unsafe")
            np.right_shift(span, chance_bits, bound)
            np.multiply(bound, chance, bound)
            if writing:
                np.not_equal(value, guess, miss)
                np.copyto(away, miss)
                np.multiply(bound, away, spare)
                np.add(low, spare, low)
            else:
                np.greater_equal(rest, bound, miss)
                np.copyto(away, miss)
                np.multiply(bound, away, spare)
                np.subtract(rest, spare, rest)
                if apart is not away:
                    np.copyto(apart, miss)
                misses.take(here, None, other, "clip")
                np.add(here, miss, here)
                np.subtract(other, guess, other)
                np.multiply(other, apart, other)
                np.add(other, guess, value)
            # the range of a hit is the bound, that of a miss the rest
            np.subtract(span, bound, span)
            np.subtract(span, bound, span)
            np.multiply(span, away, span)
            np.add(span, bound, span)
            np.less(span, limit, small)
            at = small.nonzero()[0]
            if len(at):
                coder.shift(at)
            if t % REVISED == REVISED - 1:
                goal = np.where(miss, 0, ONE)
                for k, said in enumerate((usual[:n], sure[0].astype(np.int32), sure[1].astype(np.int32))):
                    trust[k, :n] += ((ONE - np.abs(goal - said)) - (trust[k, :n] << 4)) >> 7
                np.maximum(trust, 1, out=trust)
                hits = REVISED - missed[t + 1 - REVISED:t + 1, :n].sum(axis=0, dtype=np.int32)
                usual[:n] += (hits * (ONE // REVISED) - usual[:n]) >> 2
                np.maximum(usual, 16, out=usual)
                weigh()
            np.bitwise_and(entries, low_half, entries)
            np.equal(entries, value, same)
            np.right_shift(sure, rate, terms)
            np.subtract(sure, terms, sure)
            np.copyto(terms, same)
            np.multiply(terms, grow, terms)
            np.add(sure, terms, sure)
            np.left_shift(sure, up, sure)
            np.bitwise_or(sure, value, sure)
            table[slots] = all_sure
            seen = value
        last[:n] = seen
    return missed


def _symbols(values: np.ndarray) -> np.ndarray:
    """The symbol of each id: ids below 2**EXACT themselves, then length and upper bits."""
    left = np.maximum(np.frexp(values.astype(np.float64))[1] - EXACT, 0)
    return (values.astype(np.int64) >> left) + (left << (EXACT - 1))


_SYMBOLS = int(_symbols(np.array([2**31 - 1]))[0]) + 1
_LEFT = np.maximum((np.arange(_SYMBOLS + 1) >> (EXACT - 1)) - 1, 0)             # lower bits of its id that a symbol leaves
_FLOOR = (np.arange(_SYMBOLS + 1) - (_LEFT << (EXACT - 1))) << _LEFT            # the least id of a symbol


def _sizes(levels: np.ndarray) -> np.ndarray:
    """Frequencies with the sum 2**TOTAL from the four-bit ones; at least 1 for each symbol that occurs."""
    scaled = _SCALE[levels]
    spare = (1 << TOTAL) - np.count_nonzero(scaled, axis=1)
    sizes = (scaled > 0) + scaled * spare[:, None] // np.maximum(scaled.sum(axis=1), 1)[:, None]
    sizes[np.arange(len(sizes)), scaled.argmax(axis=1)] += (1 << TOTAL) - sizes.sum(axis=1)
    return sizes


def _entries(sizes: np.ndarray) -> np.ndarray:
    """Start of each symbol above its size."""
    return ((np.cumsum(sizes, axis=1) - sizes) << 16 | sizes).astype(np.uint32)


def _code_symbols(symbols: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Words of the symbols of each lane; ``symbols`` has one row a step, lanes are sorted by falling count."""
    lanes, width = sizes.shape
    packed = _entries(sizes).reshape(-1)
    coder = _Writer(lanes, 3 * len(symbols) // 4 + 2)               # and a symbol less than twelve
    total, limit, size_bits, four = (np.array(v, np.uint32) for v in (TOTAL, 0x10000, 0xFFFF, 4))
    for since, until, n in _prefixes(counts):
        rows, span, low, at = np.arange(n) * width, coder.range[:n], coder.low[:n], coder.at[:n]
        entry, part, small, by, word = np.empty(n, np.uint32), np.empty(n, np.uint32), np.empty(n, bool), np.empty(n, np.uint32), np.empty(n, np.uint64)
        spot = np.empty(n, np.int64)
        for t in range(since, until):
            np.add(rows, symbols[t, :n], spot)
            packed.take(spot, None, entry, "clip")
            np.right_shift(span, total, span)
            np.right_shift(entry, _S16, part)
            np.multiply(part, span, part)
            np.add(low, part, low)
            np.bitwise_and(entry, size_bits, entry)
            np.multiply(span, entry, span)
            # write a word where the range is small
            np.less(span, limit, small)
            np.copyto(by, small)
            np.left_shift(by, four, by)
            np.right_shift(low, _W16, word)
            coder.flat[at] = word
            np.add(at, small, at)
            np.left_shift(span, by, span)
            np.left_shift(word, _W16, word)
            np.multiply(word, small, word)
            np.subtract(low, word, low)
            np.left_shift(low, by, low)
    return coder.finished()


def _read_symbols(data: list[bytes], counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The symbols, one row a step."""
    lanes, width = sizes.shape
    packed = _entries(sizes).reshape(-1)
    found = np.repeat(np.tile(np.arange(width, dtype=np.uint16), lanes), sizes.reshape(-1))  # the symbol at each place of 2**TOTAL
    coder = _Reader(data)
    out = np.zeros((int(counts.max(initial=0)), lanes), np.uint16)
    total, limit, size_bits, four = (np.array(v, np.uint32) for v in (TOTAL, 0x10000, 0xFFFF, 4))
    top = np.array((1 << TOTAL) - 1, np.float64)
    for since, until, n in _prefixes(counts):
        rows, tables, span, rest, at = np.arange(n) * width, np.arange(n) << TOTAL, coder.range[:n], coder.rest[:n], coder.at[:n]
        entry, part, small, by = np.empty(n, np.uint32), np.empty(n, np.uint32), np.empty(n, bool), np.empty(n, np.uint32)
        share, spot = np.empty(n, np.float64), np.empty(n, np.int64)
        for t in range(since, until):
            symbol = out[t, :n]
            np.right_shift(span, total, span)
            np.true_divide(rest, span, share)      # its whole part is exact: both are below 2**32
            np.minimum(share, top, share)
            np.copyto(spot, share, casting="unsafe")
            np.add(spot, tables, spot)
            found.take(spot, None, symbol, "clip")
            np.add(rows, symbol, spot)
            packed.take(spot, None, entry, "clip")
            np.right_shift(entry, _S16, part)
            np.multiply(part, span, part)
            np.subtract(rest, part, rest)
            np.bitwise_and(entry, size_bits, entry)
            np.multiply(span, entry, span)
            # read a word where the range is small
            np.less(span, limit, small)
            np.copyto(by, small)
            np.left_shift(by, four, by)
            coder.flat.take(at, None, part, "clip")
            np.multiply(part, small, part)
            np.add(at, small, at)
            np.left_shift(span, by, span)
            np.left_shift(rest, by, rest)
            np.bitwise_or(rest, part, rest)
    return out


def _pack(values: np.ndarray, widths: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The lower ``widths`` bits of the values, behind each other in 32-bit words for each lane; lanes lie behind each other."""
    at, bits = _places(widths, counts)
    words = (bits + 31) >> 5
    first = np.cumsum(words) - words
    packed = np.zeros(int(words.sum()) + 2, np.int64)   # ids without lower bits may end a word
    if len(values):
        part = (values & _MASKS[widths]) << (at & 31)
        word = at >> 5
        heads = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        whole = np.bitwise_or.reduceat(part, heads)
        packed[word[heads]] = whole & 0xFFFFFFFF
        packed[word[heads] + 1] |= whole >> 32
    packed = packed.astype("<u4")
    return [packed[x:x + k].tobytes() for x, k in zip(first.tolist(), words.tolist())]


def _places(widths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At which bit each value begins, if every lane begins a word, and the bits of each lane."""
    ends = np.cumsum(widths)
    starts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    bits = np.diff(starts)
    words = (bits + 31) >> 5
    return ends - widths + np.repeat(((np.cumsum(words) - words) << 5) - starts[:-1], counts), bits


def _unpack(data: list[bytes], widths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values whose lower bits ``_pack`` gives."""
    at, bits = _places(widths, counts)
    if any(len(d) != n for d, n in zip(data, ((bits + 31 >> 5) * 4).tolist())):
        raise ValueError("a block of token ids lacks bits")
    stream = np.frombuffer(b"".join(data) + bytes(8), "<u4").astype(np.int64)
    word = at >> 5
    return ((stream[word] | stream[word + 1] << 32) >> (at & 31)) & _MASKS[widths]


def _head(block: np.ndarray, table: bytes, wide: bool) -> bytes:
    return _HEAD.pack(len(table) | wide << 15, len(block), zlib.crc32(block.astype("<u4").tobytes()))


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded form of each block of ids below 2**31, whatever the others are."""
    out = [b"" if len(b) else _head(b, b"", False) for b in blocks]
    wide = [len(b) > 0 and int(b.max()) >= 1 << 16 for b in blocks]
    for kind in sorted(set(wide)):
        _encode(blocks, sorted((i for i, b in enumerate(blocks) if len(b) and wide[i] == kind), key=lambda i: -len(blocks[i])), kind, out)
    return out


def _encode(blocks: list[np.ndarray], order: list[int], wide: bool, out: list[bytes]) -> None:
    """The blocks ``order``, all of ids of 16 bits or all with longer ones, by falling length."""
    if not order:
        return
    lengths = np.array([len(blocks[i]) for i in order])
    rows = np.zeros((len(order), int(lengths[0])), np.uint64 if wide else np.uint32)
    for row, i in zip(rows, order):
        row[:len(blocks[i])] = blocks[i]
    coder = _Writer(len(order), 5 * int(lengths[0]) // 8 + 2)       # a hit or miss has less than ten bits
    missed = np.ascontiguousarray(_hits(coder, lengths, np.ascontiguousarray(rows.T), None, None).T)
    hits, counts = coder.finished(), np.count_nonzero(missed, axis=1)
    table = _symbols(np.arange(1 << 16))
    padded = np.zeros((len(order), int(counts.max())), np.uint16)
    seen, lower = np.zeros((len(order), _SYMBOLS if wide else int(table[-1]) + 1), np.int64), []
    for lane in range(0, len(order), TOGETHER):
        part, number = slice(lane, lane + TOGETHER), counts[lane:lane + TOGETHER]
        values = rows[part][missed[part]].astype(np.int64)
        symbols = _symbols(values) if wide else table.take(values)
        padded[part][np.arange(padded.shape[1]) < number[:, None]] = symbols
        which = np.repeat(np.arange(len(number)) * seen.shape[1], number) + symbols
        seen[part] = np.bincount(which, minlength=seen[part].size).reshape(len(number), -1)
        lower += _pack(values, _LEFT.take(symbols), number)
    levels = _LEVEL[-(-seen * _SCALE[-1] // np.maximum(seen.max(axis=1), 1)[:, None])]
    ranked = np.argsort(-counts, kind="stable")
    coded = _code_symbols(np.ascontiguousarray(padded[ranked].T), counts[ranked], _sizes(levels[ranked]))
    nibbles = np.pad(levels, ((0, 0), (0, levels.shape[1] % 2))).astype(np.uint8)
    nibbles = nibbles[:, 0::2] | nibbles[:, 1::2] << 4
    used = np.where(counts > 0, nibbles.shape[1] - (nibbles[:, ::-1] > 0).argmax(axis=1), 0)
    for words, lane in zip(coded, ranked.tolist()):
        i, words, table = order[lane], words if counts[lane] else b"", nibbles[lane, :used[lane]].tobytes()
        out[i] = _head(blocks[i], table, wide) + _MORE.pack(int(counts[lane]), len(words) // 2, len(hits[lane]) // 2) + table + words + hits[lane] + lower[lane]


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block whose check sum does not match raises ValueError."""
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(blocks)
    heads = [_HEAD.unpack_from(b) for b in blocks]
    for wide in sorted({h[0] >> 15 for h in heads}):
        _decode(blocks, heads, sorted((i for i, h in enumerate(heads) if h[1] and h[0] >> 15 == wide), key=lambda i: -heads[i][1]), wide, out)
    for ids, (_, _, crc) in zip(out, heads):
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block of token ids does not match its check sum")
    return out


def _decode(blocks: list[bytes], heads: list[tuple], order: list[int], wide: int, out: list[np.ndarray]) -> None:
    if not order:
        return
    lengths, counts, parts = np.array([heads[i][1] for i in order]), np.zeros(len(order), np.int64), []
    for lane, i in enumerate(order):
        table = heads[i][0] & 0x7FFF
        counts[lane], words, hits = _MORE.unpack_from(blocks[i], _HEAD.size)
        cuts = np.cumsum([_HEAD.size + _MORE.size, table, 2 * words, 2 * hits]).tolist()
        if counts[lane] > lengths[lane] or cuts[-1] > len(blocks[i]) or 2 * table > _SYMBOLS + 1:
            raise ValueError("a block of token ids is damaged")
        parts.append([blocks[i][a:b] for a, b in zip(cuts, cuts[1:] + [None])])
    tables, words, hits, lower = zip(*parts)
    nibbles = np.zeros((len(order), max(1, *map(len, tables))), np.uint8)
    for row, table in zip(nibbles, tables):
        row[:len(table)] = np.frombuffer(table, np.uint8)
    levels = np.stack([nibbles & 15, nibbles >> 4], axis=2).reshape(len(order), -1)
    ranked = np.argsort(-counts, kind="stable")
    found = np.empty((len(order), int(counts.max())), np.uint16)
    found[ranked] = _read_symbols([words[lane] for lane in ranked], counts[ranked], _sizes(levels[ranked])).T
    ids = np.zeros((int(lengths[0]), len(order)), np.uint64 if wide else np.uint32)
    first = np.cumsum(counts) - counts
    misses = np.zeros(int(counts.sum()) + 1, ids.dtype)
    for lane in range(0, len(order), TOGETHER):
        part, number = slice(lane, lane + TOGETHER), counts[lane:lane + TOGETHER]
        symbols = found[part][np.arange(found.shape[1]) < number[:, None]]
        left = _LEFT.take(symbols)
        misses[first[lane]:first[lane] + len(left)] = _FLOOR.take(symbols) | _unpack(lower[part], left, number)
    _hits(_Reader(hits), lengths, ids, misses, first)
    for row, i in zip(np.ascontiguousarray(ids.T).astype("<u4"), order):
        out[i] = row[:heads[i][1]]
