"""Removal of repeated byte strings across documents, by external induced suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts earlier goes
(a smaller id, or the same document further left).  Four steps keep that
exact and spread:

1. Each text is cut into runs of windows with one content-chosen anchor
   (``anchors``).  Equal windows have equal anchors at equal places, so only
   runs with one anchor hash can hold equal windows.  Runs equal in full are
   settled first: all but the first one are repeats.  That happens inside each
   batch before anything is shuffled, so a passage with thousands of copies
   reaches the shuffle once a batch.
2. The other runs are shuffled by their anchor, as numbers without bytes, and
   runs whose anchor no different run has drop out.
3. What is left may share part of its windows with other runs.  Its bytes are
   cut from the texts and form shards, whole anchor groups each, and the shards
   are sorted by ``induced_sort``, whose queues go to disk.  An anchor with more
   runs than a shard holds is split by the hashes of its windows instead: equal
   windows still meet, and each batch sends only its earliest place of a window.
4. The repeats of each document are merged and cut out.  Steps 3 and 4 read the
   texts by one and the same shuffle.

Hashes have 57 and 64 bits: two different runs, or windows of a split anchor,
are taken for equal only if both collide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window as W, functions as F

from stipendia.llm import anchors
from stipendia.llm.common import saved
from stipendia.llm.induced_sort import repeats
from stipendia.llm.shingles import mixed

LENGTH = anchors.LENGTH
ROWS = 1_000           # texts held at once outside Arrow
SHARD_BYTES = 4 << 20  # anchor groups are sorted together up to this size; no group is larger


def _texts(source: DataFrame) -> DataFrame:
    return source.where("doc is not null").select("doc", F.col("body.text").alias("text"))


def _bytes(text: str | None) -> np.ndarray | None:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text and len(text) * 4 >= LENGTH else None


def hot_anchors(source: DataFrame) -> DataFrame:
    """(hot): anchors with more places than half a shard holds, among those that some batch has twice.

    An anchor that no batch has twice has at most one run a batch.
    """

    def run(batches):
        for batch in batches:
            texts = (_bytes(text.as_py()) for text in batch.column(0))
            found = [anchors.places(t) for t in texts if t is not None]
            anchor, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array((anchor[often] >> np.uint64(7)).view(np.int64)), pa.array(n[often])], names=["hot", "n"])

    counted = _texts(source).select("text").mapInArrow(run, "hot long, n long").groupBy("hot").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") > SHARD_BYTES // (4 * LENGTH)).select("hot")  # a run has at most 2 * LENGTH bytes


def _runs(source: DataFrame) -> DataFrame:
    """(packed, digest, doc, first, end): runs of each text.

    Runs with an earlier equal one in their batch come merged to the bytes they cover, without ``packed`` and ``digest``.
    """

    def run(batches):
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = _bytes(text.as_py())
                if data is None:
                    continue
                anchor, _, first, last, digest = anchors.runs(data)
                packed = ((anchor >> np.uint64(7)) << np.uint64(7)) | (last - first).astype(np.uint64)
                for column, part in zip(columns, (packed, digest, np.full(len(first), doc, np.int64), first, last + LENGTH)):
                    column.append(part)
            if not columns[0]:
                continue
            packed, digest, doc, first, end = (np.concatenate(c) for c in columns)
            order = np.lexsort((first, doc, digest, packed))
            order = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(first[order]) != 0) | (np.diff(packed[order]) != 0)])]
            packed, digest, doc, first, end = packed[order], digest[order], doc[order], first[order], end[order]  # each place once
            again = np.concatenate([[False], (packed[1:] == packed[:-1]) & (digest[1:] == digest[:-1])])
            own = np.flatnonzero(again)[np.lexsort((first[again], doc[again]))]
            gone, begin, stop = doc[own], first[own], end[own]
            opens = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1]) | (begin[1:] > stop[:-1])])[:len(own)])
            closes = np.append(opens[1:], len(own))[:len(opens)] - 1
            none = np.zeros(len(opens), np.int64)
            missing = np.concatenate([np.zeros(len(packed) - len(own), bool), np.ones(len(opens), bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([packed[~again].view(np.int64), none]), mask=missing),
                 pa.array(np.concatenate([digest[~again].view(np.int64), none]), mask=missing),
                 pa.array(np.concatenate([doc[~again], gone[opens]])), pa.array(np.concatenate([first[~again], begin[opens]]).astype(np.int32)),
                 pa.array(np.concatenate([end[~again], stop[closes]]).astype(np.int32))], names=["packed", "digest", "doc", "first", "end"])

    return _texts(source).mapInArrow(run, "packed long, digest long, doc long, first int, end int")


def _judged(source: DataFrame) -> DataFrame:
    """(doc, first, end, anchor, hot, leads): runs to compare (``leads``) and bytes that are repeats already.

    A run that leads is the first of its equals, and other runs have its anchor.
    """
    anchor = F.shiftright("packed", 7)
    runs = _runs(source).withColumn("anchor", anchor).join(saved(hot_anchors(source)), F.col("anchor") == F.col("hot"), "left")
    slot = F.when(F.col("packed").isNull(), F.col("doc")).when(F.col("hot").isNotNull(), F.xxhash64("packed", "digest")).otherwise(F.col("anchor"))
    runs = runs.select(slot.alias("slot"), "packed", "digest", "doc", "first", "end", F.col("hot").isNotNull().alias("hot"))
    # One shuffle and one sort serve both windows.
    by_run = W.partitionBy("slot", "packed", "digest").orderBy("doc", "first").rowsBetween(W.unboundedPreceding, W.currentRow)
    by_slot = W.partitionBy("slot").orderBy("packed", "digest").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place, settled = F.struct("doc", "first"), F.col("packed").isNull()
    return (runs.repartition("slot").withColumn("earliest", F.first(place).over(by_run))
            .withColumn("different", (F.first("packed").over(by_slot) != F.last("packed").over(by_slot))
                        | (F.first("digest").over(by_slot) != F.last("digest").over(by_slot)))
            .select("doc", "first", "end", F.when(~settled, anchor).alias("anchor"), "hot",
                    (~settled & (place == F.col("earliest"))).alias("leads"), "different")
            .where(~F.col("leads") | F.col("hot") | F.coalesce("different", F.lit(True))).drop("different"))


def _windows(anchor: np.ndarray, doc: np.ndarray, first: np.ndarray, parts: list[bytes]):
    """For segments of split anchors: (slot, window, doc, start) of the earliest place of each window, then
    (doc, start, end) of the others, merged."""
    half = 1 << LENGTH.bit_length() - 1  # two strings of this many bytes cover a window
    size = np.array([len(p) for p in parts], np.int64)
    hashes = anchors.gram_hashes(np.frombuffer(b"".join(parts), np.uint8), half)
    count = size - LENGTH + 1
    row = np.repeat(np.arange(len(parts)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[row] + inside
    window = mixed(mixed(hashes[at]) + hashes[at + LENGTH - half])
    anchor, doc, start = anchor[row], doc[row], first[row].astype(np.int64) + inside
    order = np.lexsort((start, doc, window, anchor))
    anchor, window, doc, start = anchor[order], window[order], doc[order], start[order]
    leads = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])])
    earliest = np.maximum.accumulate(np.where(leads, np.arange(len(leads)), 0))
    again = (doc != doc[earliest]) | (start != start[earliest])
    order = np.lexsort((start[again], doc[again]))
    gone, begin = doc[again][order], start[again][order]
    opens = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1]) | (begin[1:] > begin[:-1] + LENGTH)])[:len(gone)])
    closes = np.append(opens[1:], len(gone))[:len(opens)] - 1
    slot = mixed(anchor[leads].view(np.uint64) ^ mixed(window[leads])).view(np.int64)
    return (slot, window[leads].view(np.int64), doc[leads], start[leads]), (gone[opens], begin[opens], begin[closes] + LENGTH)


def _segments(named: DataFrame) -> DataFrame:
    """(slot, window, doc, first, end, data) from (doc, body, runs): the bytes of each run under its anchor.

    Runs of split anchors come as windows without bytes, under a slot of each window's own; those that are repeats
    inside the batch have neither.
    """

    def rows_of(doc, first, end, slot=None, window=None, data=None):
        none = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()) if slot is None else pa.array(slot, pa.int64()), none if window is None else pa.array(window, pa.int64()),
             pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(end, pa.int64()),
             pa.nulls(len(doc), pa.binary()) if data is None else pa.array(data, pa.binary())],
            names=["slot", "window", "doc", "first", "end", "data"])

    def run(batches):
        for whole in batches:
            whole = whole.filter(pa.compute.is_valid(whole.column(2)))
            for start in range(0, len(whole), ROWS):
                yield from cut(whole.slice(start, ROWS))

    def cut(batch):
        texts = batch.column(1).flatten()[0].to_pylist()
        held: dict[bool, list[list]] = {True: [[], [], [], []], False: [[], [], [], []]}
        for doc, text, runs in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            for part in runs:
                for column, value in zip(held[part["hot"]], (part["anchor"], doc, part["first"], data[part["first"]:part["end"]])):
                    column.append(value)
        slot, doc, first, data = held[False]
        yield rows_of(doc, first, [f + len(d) for f, d in zip(first, data)], slot, None, data)
        if held[True][0]:
            slot, doc, first = (np.array(c, np.int64) for c in held[True][:3])
            (slot, window, doc, start), gone = _windows(slot, doc, first, held[True][3])
            yield rows_of(doc, start, start + LENGTH, slot, window)
            yield rows_of(*gone)

    return named.mapInArrow(run, "slot long, window long, doc long, first long, end long, data binary")


def _sorted_repeats(segments: DataFrame) -> DataFrame:
    """(doc, start, end): stretches of bytes covered by windows that start earlier in another or the same run."""
    grouped = segments.repartition("slot").sortWithinPartitions("slot", "window", "doc", "first")

    def stretches(doc, start, end):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, start, end)], names=["doc", "start", "end"])

    def shard(rows):
        doc, first = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        text = np.frombuffer(b"\xff".join([*(r[3] for r in rows), b""]), np.uint8) + np.uint8(1)  # 255 closes a string, as 0
        begin = np.cumsum([0] + [len(r[3]) + 1 for r in rows[:-1]])
        found = repeats(text, LENGTH)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        at = np.searchsorted(begin, starts, side="right") - 1
        shift = first[at] - begin[at]
        return stretches(doc[at], starts + shift, ends + shift + LENGTH - 1)

    def later(batch, before):
        """Windows of a batch that have an earlier place, and the earliest place of the last window."""
        slot, window, doc, start = (np.concatenate([[b], batch.column(i).to_numpy(zero_copy_only=False)]) for i, b in enumerate(before))
        leads = np.concatenate([[True], (slot[1:] != slot[:-1]) | (window[1:] != window[:-1])])
        earliest = np.maximum.accumulate(np.where(leads, np.arange(len(leads)), 0))
        again = (doc != doc[earliest]) | (start != start[earliest])
        return stretches(doc[again], start[again], start[again] + LENGTH), [int(c[earliest[-1]]) for c in (slot, window, doc, start)]

    def run(batches):
        held, size, last, place, before = [], 0, None, None, [0, 0, 0, 0]
        for batch in batches:
            whole = pa.compute.is_valid(batch.column(5))
            others = batch.filter(pa.compute.invert(whole))
            settled = pa.compute.is_null(others.column(1))
            done, windows = others.filter(settled), others.filter(pa.compute.invert(settled))
            if len(done):
                yield stretches(*(done.column(i) for i in (2, 3, 4)))
            if len(windows):
                found, before = later(windows, before)
                yield found
            for row in zip(*(batch.filter(whole).column(i).to_pylist() for i in (0, 2, 3, 5))):
                if row[:3] == place:  # a document that stands in several rows
                    continue
                if size >= SHARD_BYTES and row[0] != last:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size, last, place = size + len(row[3]) + 1, row[0], row[:3]
        if held:
            yield shard(held)

    return grouped.mapInArrow(run, "doc long, start long, end long")


def _stretches(source: DataFrame) -> DataFrame:
    """(doc, stretches array<(start, end)>): byte ranges to remove, of documents that have any; they may overlap."""
    judged = saved(_judged(source))
    known = judged.where("not leads").select("doc", F.col("first").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    wanted = judged.where("leads").groupBy("doc").agg(F.collect_set(F.struct("anchor", "first", "end", "hot")).alias("runs"))
    # Left, and filtered by the reader: the texts then have one and the same shuffle here and where they are cut.
    found = _sorted_repeats(_segments(source.join(wanted, "doc", "left").select("doc", "body", "runs")))
    return known.union(found).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("stretches"))


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept binary, kept_text, carried columns): each text without its repeats.

    ``kept`` are the remaining bytes; ``kept_text`` is the same without characters of which a byte is gone.  Null and
    empty texts have no bytes (``kept_text`` of null is null).  Ids name documents: a row repeated in full is the same
    document and answered alike, and a null id has no place in the order, so its text stays whole.  Texts are judged as
    they came, not after removals.  Columns not named in ``carry`` are not read; an empty table gives an empty table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.struct(
        F.col(text_col).alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]).alias("body"))
    joined = source.join(_stretches(source), "doc", "left").select("doc", "body", "stretches")

    def run(batches):
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                yield cut(whole.slice(start, ROWS))

    def cut(batch):
        rows: list[list] = [[], [], [], [], []]
        text_and_carried = batch.column(1).flatten()
        for text, stretches in zip(text_and_carried[0].to_pylist(), batch.column(2).to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            spans = merged([(s["start"], min(s["end"], len(data))) for s in stretches or () if s["start"] < len(data)])
            parts, at = [], 0
            for start, end in spans:
                parts.append(data[at:start])
                at = end
            kept = b"".join([*parts, data[at:]])
            left = text if not spans else kept.decode("utf-8", "ignore")
            for column, value in zip(rows, (len(data), len(data) - len(kept), len(spans), kept, left)):
                column.append(value)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(r, pa.int64()) for r in rows[:3]], pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.string()),
             *text_and_carried[1:]], names=names)

    carried = source.schema["body"].dataType.fields[1:]
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", *(f.name for f in carried)]
    kinds = "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"
    out = joined.mapInArrow(run, kinds + "".join(f", {f.name} {f.dataType.simpleString()}" for f in carried))
    return out.toDF(*names[:6], *carry)
