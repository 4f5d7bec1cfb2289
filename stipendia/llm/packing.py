"""Best-fit packing of token sequences with swap-based local search.

Documents longer than a sequence are cut into full pieces, the first one
shorter.  Pieces are spread over the cluster by a hash of their key and packed
in groups of at most ``GROUP`` pieces, so no task holds more than that; a
group can waste about one sequence, against tens of thousands it fills.

A group starts with best fit in falling order of length.  Then the emptiest
bins are dissolved: a document moves to another bin, or changes places with a
smaller document of it, or two documents change places with one, whenever that
raises the sum of squared fills; a bin that gets empty is gone.  The search
ends when no bin can be saved any more or a pass over all bins saved none.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stipendia.llm.common import plain
from stipendia.llm.tokens import tokenizer

GROUP = 100_000


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers.  Each item, longest first, goes to the fullest bin it fits in.

    ``mask`` has a bit for every free space that some bin has, so the tightest one is found by shifting.
    """
    by_free: dict[int, list[int]] = {}
    bins, mask = [], 0
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[item]
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[at].append(item)
            free -= size
        else:
            at, free = len(bins), capacity - size
            bins.append([item])
        if free:
            by_free.setdefault(free, []).append(at)
            mask |= 1 << free
    return bins


class LocalSearch:
    """Bins that are not full, indexed by the lengths they hold, to find a partner for an exchange."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = {i: list(b) for i, b in enumerate(bins)}
        self.fill = {i: sum(lengths[x] for x in b) for i, b in self.bins.items()}
        self.holding: dict[int, list[tuple[int, int]]] = {}  # length -> sorted (free, bin)
        self.sizes: list[int] = []                           # the lengths held, sorted
        self.open: list[tuple[int, int]] = []                # sorted (free, bin)
        for i in self.bins:
            self._add(i)

    def _add(self, i: int) -> None:
        free = self.capacity - self.fill[i]
        if free > 0:
            insort(self.open, (free, i))
            for size in {self.lengths[x] for x in self.bins[i]}:
                if size not in self.holding:
                    self.holding[size] = []
                    insort(self.sizes, size)
                insort(self.holding[size], (free, i))

    def _drop(self, i: int) -> None:
        free = self.capacity - self.fill[i]
        if free > 0:
            del self.open[bisect_left(self.open, (free, i))]
            for size in {self.lengths[x] for x in self.bins[i]}:
                row = self.holding[size]
                del row[bisect_left(row, (free, i))]
                if not row:
                    del self.holding[size]
                    del self.sizes[bisect_left(self.sizes, size)]

    def _partner(self, mass: int, fill: int, most: int) -> tuple[int, int] | None:
        """(bin, length taken back) that takes as much of ``mass`` as possible and ends fuller than ``fill``.

        Length 0 is a plain move.  The bin itself is not in the index while it is searched for.
        """
        if mass <= most:
            at = bisect_left(self.open, (mass, -1))
            if at < len(self.open) and self.capacity - self.open[at][0] + mass > fill:
                return self.open[at][1], 0
        for back in self.sizes[bisect_left(self.sizes, mass - most):bisect_left(self.sizes, mass)]:
            row, gain = self.holding[back], mass - back
            if row[-1][0] >= gain:
                free, other = row[bisect_left(row, (gain, -1))]
                if self.capacity - free + gain > fill:
                    return other, back
        return None

    def _exchange(self, i: int) -> bool:
        own, lengths = self.bins[i], self.lengths
        most = self.open[-1][0] if self.open else 0
        if not most:
            return False
        by_length: dict[int, list[int]] = {}
        for x in sorted(own, key=lambda x: -lengths[x]):
            by_length.setdefault(lengths[x], []).append(x)
        kinds = list(by_length.values())  # which of equally long documents goes makes no difference
        offers = [k[:1] for k in kinds] + [k[:2] for k in kinds if len(k) > 1]
        offers += [[a[0], b[0]] for n, a in enumerate(kinds) for b in kinds[n + 1:]]
        for offer in offers:
            mass = sum(lengths[x] for x in offer)
            found = self._partner(mass, self.fill[i], most)
            if found is None or (len(offer) == 2 and found[1] == 0):
                continue
            other, back = found
            self._drop(other)
            taken = [next(x for x in self.bins[other] if lengths[x] == back)] if back else []
            for x in offer:
                own.remove(x)
            for x in taken:
                self.bins[other].remove(x)
            self.bins[other] += offer
            own += taken
            self.fill[other] += mass - back
            self.fill[i] -= mass - back
            self._add(other)
            return True
        return False

    def run(self) -> list[list[int]]:
        total = sum(self.fill.values())
        spare, saved = len(self.bins) - -(-total // self.capacity), True
        while spare > 0 and saved:
            saved = False
            for i in sorted(self.bins, key=lambda b: (self.fill[b], b)):
                if spare <= 0:
                    break
                if self.fill[i] >= self.capacity:
                    continue
                self._drop(i)
                while self.bins[i] and self._exchange(i):
                    pass
                if self.bins[i]:
                    self._add(i)
                else:
                    del self.bins[i], self.fill[i]
                    spare, saved = spare - 1, True
        return list(self.bins.values())


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run()


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): the token ids of every text, its end id last, cut to at most ``capacity``.

    Null texts count as empty and give the end id alone; repeated rows give their pieces each.
    """
    source = plain(docs, id_col, text_col)

    def run(batches):
        codec, end = tokenizer(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1))):
                ids += end
                total, at, piece = len(ids) // 4, 0, 0
                while at < total:
                    size = (total % capacity or capacity) if piece == 0 else capacity
                    for column, value in zip(rows, (doc, piece, at, size, ids[4 * at:4 * (at + size)])):
                        column.append(value)
                    at, piece = at + size, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()),
                 pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())],
                names=[id_col, "piece", "start", "length", "ids"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, piece int, start bigint, length bigint, ids binary")


def pack(cut: DataFrame, capacity: int, keys: tuple[str, ...] = ("doc_id", "piece"), group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Only small columns should be passed; ids are joined afterwards (``sequences``).  Which of equal lengths goes
    where follows the keys; rows repeated in full are placed each.
    """
    spread = cut.repartition(F.xxhash64(*keys)).sortWithinPartitions(*cut.columns)

    def run(frames):
        from pyspark import TaskContext
        next_id = TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []

        def placed(rows: pd.DataFrame):
            nonlocal next_id
            lengths = rows["length"].to_numpy()
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for members in pack_lengths(lengths.tolist(), capacity):
                sequence[members] = next_id
                offset[members] = np.concatenate([[0], np.cumsum(lengths[members])[:-1]])
                next_id += 1
            return rows.assign(sequence_id=sequence, offset=offset)

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= group:
                yield placed(pd.concat(held, ignore_index=True))
                held = []
        if held:
            yield placed(pd.concat(held, ignore_index=True))

    fields = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    return spread.mapInPandas(run, f"{fields}, sequence_id bigint, offset bigint")


def sequences(cut: DataFrame, packed: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """(sequence_id, n_tokens, parts): the pieces of each sequence with their ids, in order; at most one sequence a row."""
    joined = packed.join(cut.select(*keys, "ids"), list(keys))
    return joined.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("offset", *keys, "ids"))).alias("parts"))
