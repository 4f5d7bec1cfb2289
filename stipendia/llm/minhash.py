"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

A shingle's hash is placed in a universe of ``2**UNIVERSE`` slots by a first
permutation; coordinate k of the signature is the smallest value of a second
permutation, shifted circularly by k, over the slots of the set.  Two
permutations thus give all ``ROWS * BANDS`` coordinates.  A pair at the
threshold of 0.75 shares none of the bands with a chance of 2e-6.

Texts with equal sets are one node.  In each bucket of a band every node is
compared with the bucket's smallest and largest node, which joins most groups
of copies.  Then nodes of one bucket that are still in different components
are compared with each other, chunk by chunk, unless 64 four-bit coordinates
show a node far from all of them (a pair at the threshold fails that with a
chance below 1e-6).  Every comparison that decides is exact, on full sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stipendia.llm.common import plain, saved
from stipendia.llm.components import components
from stipendia.llm.shingles import Shingler, mixed, set_key

WIDTH = 5
THRESHOLD = 75  # per cent
ROWS, BANDS = 5, 48
UNIVERSE = 20
SKETCH = 64     # coordinates in the four-bit sketch
CHUNK = 500     # nodes of a bucket compared with as many others at once
FAR_APART = 31  # agreeing coordinates of the sketch below which a pair is not compared
_NIBBLES = 0x1111111111111111


class Circulant:
    def __init__(self, size: int = ROWS * BANDS, universe: int = UNIVERSE, seed: int = 20):
        self.size, self.bits = size, universe
        second = np.random.RandomState(seed).permutation(1 << universe).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:size]]), size)
        self.seed = np.uint64(seed * 0x9E3779B9)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The first permutation is a bijection of 64-bit values, of which the top bits name the slot."""
        slots = (mixed(shingles ^ self.seed) >> np.uint64(64 - self.bits)).astype(np.int64)
        least = np.full(self.size, 1 << self.bits, np.int32)
        for start in range(0, len(slots), 2048):
            np.minimum(least, self.windows[slots[start:start + 2048]].min(axis=0), out=least)
        return least

    @staticmethod
    def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
        grouped = signature.reshape(-1, rows).astype(np.uint64)
        total = np.arange(len(grouped), dtype=np.uint64)
        for column in grouped.T:
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + column)
        return total.view(np.int64)

    @staticmethod
    def sketch(signature: np.ndarray) -> np.ndarray:
        """Four bits of each of 64 coordinates, in four 64-bit words."""
        parts = (mixed(signature[:SKETCH].astype(np.uint64)) & np.uint64(15)).reshape(4, 16)
        return (parts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, key, bands, sketch) of every row; an empty set has neither key, bands nor sketch."""
    source = plain(docs, id_col, text_col)

    def run(batches):
        shingler, minhash = Shingler(WIDTH), Circulant()
        for batch in batches:
            sizes, keys, bands, sketches = [], [], [], []
            for text in batch.column(1):
                found = shingler(text.as_py())
                sizes.append(len(found))
                if len(found):
                    signature = minhash.signature(found)
                    keys.append(set_key(found))
                    bands.append(minhash.bands(signature))
                    sketches.append(minhash.sketch(signature))
                else:
                    for column in (keys, bands, sketches):
                        column.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "key", "bands", "sketch"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)[id_col]}, n_shingles bigint, key binary, bands array<bigint>, "
                                  "sketch array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, shingles packed) for the documents named in ``nodes``."""
    wanted = plain(docs, id_col, text_col).withColumnRenamed(id_col, "id").join(nodes, "id", "left_semi")

    def run(batches):
        shingler = Shingler(WIDTH)
        for batch in batches:
            found = [shingler(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_key(f) for f in found], pa.binary()),
                 pa.array([f.tobytes() for f in found], pa.binary())], names=["id", "key", "shingles"])

    return wanted.mapInArrow(run, f"id {dict(wanted.dtypes)['id']}, key binary, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            good = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (one, two))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= THRESHOLD * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    kinds = dict(both.dtypes)
    return both.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of 100 * intersection >= 75 * union.  Null and empty texts
    and texts without a word have no shingles and are linked with nothing.  Rows with the same id are one document.
    A row without an id is linked with nothing and kept, its component null.  Other columns are not read; an empty table
    gives an empty table.
    """
    signed = saved(signatures(docs, id_col, text_col))
    nodes = saved(signed.where("key is not null and id is not null").groupBy("key").agg(
        F.min_by(F.struct("id", "n_shingles", "bands", "sketch"), "id").alias("n")).select("key", "n.*"))
    members = nodes.select("id", "n_shingles", "sketch", F.explode("bands").alias("bucket"))
    buckets = saved(members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"))
    shared = members.join(buckets, "bucket")
    close = (F.least("n_shingles", "other_n") * 100 >= F.greatest("n_shingles", "other_n") * THRESHOLD)

    ends = shared.select("id", F.explode(F.array_distinct(F.array("low", "high"))).alias("end"))
    pairs = saved(ends.where("id <> end").select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct())
    named = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    first = saved(_confirmed(pairs, saved(_sets_of(docs, nodes, named, id_col, text_col))))
    joined = saved(components(first))

    labelled = shared.join(joined, "id", "left").select(
        "bucket", "id", "n_shingles", "sketch", F.coalesce("component", "id").alias("component"))
    split = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    open_members = saved(labelled.join(split, "bucket", "left_semi"))
    other = open_members.select(F.col("bucket").alias("same_bucket"), F.col("n_shingles").alias("other_n"),
                                F.col("sketch").alias("other_sketch"), F.col("component").alias("other_component"))
    agreeing = sum((16 - F.bit_count(_unequal(F.get("sketch", F.lit(i)), F.get("other_sketch", F.lit(i)))) for i in range(4)), F.lit(0))
    doubtful = saved(open_members.join(other, (F.col("bucket") == F.col("same_bucket")) & (F.col("component") != F.col("other_component"))
                                       & close & (agreeing >= FAR_APART), "left_semi").select("bucket", "id", "component"))
    second = _links_across(doubtful, saved(_sets_of(docs, nodes, doubtful.select("id").distinct(), id_col, text_col)))
    final = components(first.union(second))

    node_of = nodes.select("key", F.col("id").alias("node")).join(final.withColumnRenamed("id", "node"), "node", "left").select(
        "key", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("id", "n_shingles", "key").join(node_of, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _unequal(x, y):
    """One bit for every nibble in which two words differ."""
    d = x.bitwiseXOR(y)
    for shift in (1, 2):
        d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
    return d.bitwiseAND(F.lit(_NIBBLES))


def _sets_of(docs: DataFrame, nodes: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles packed) of the named nodes; of several rows with one id, the one the node stands for."""
    found = _sets(docs, saved(named), id_col, text_col)
    return found.join(nodes.select("id", "key"), ["id", "key"], "left_semi").dropDuplicates(["id"]).select("id", "shingles")


def _links_across(doubtful: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of one bucket that are in different components.

    The nodes of a bucket are dealt into chunks of about ``CHUNK`` and every two chunks meet in one group, so a bucket
    of any size is compared whole by groups of bounded size, and no pair is ever a row.
    """
    sizes = doubtful.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    own, met = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = (doubtful.join(sizes, "bucket").select("bucket", "id", "component", own.alias("own"), met.alias("met"))
             .select("bucket", "id", "component", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j")))

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        ids, label = rows["id"].to_numpy(), rows["component"].to_numpy().copy()
        arrays = [np.frombuffer(v, np.uint64) for v in rows["shingles"]]
        size = np.array([len(a) for a in arrays])
        owner = np.repeat(np.arange(len(arrays)), size)
        _, number = np.unique(np.concatenate(arrays), return_inverse=True)
        by_number = np.argsort(number, kind="stable")
        posting, starts = owner[by_number], np.searchsorted(number[by_number], np.arange(number.max() + 2))
        begin = np.cumsum(size) - size
        values, counts = np.unique(label, return_counts=True)
        out = []
        for u in np.flatnonzero(label != values[counts.argmax()]):  # of two components, one is not the commonest
            mine = number[begin[u]:begin[u] + size[u]]
            shared = np.bincount(np.concatenate([posting[starts[x]:starts[x + 1]] for x in mine]), minlength=len(ids))
            linked = np.flatnonzero((100 * shared >= THRESHOLD * (size[u] + size - shared)) & (label != label[u]))
            for v in linked.tolist():
                if label[v] != label[u]:
                    out.append((ids[u], ids[v]))
                    label[label == label[v]] = label[u]
        return pd.DataFrame(out, columns=["a", "b"])

    kind = dict(doubtful.dtypes)["id"]
    return dealt.join(sets, "id").groupBy("bucket", "i", "j").applyInPandas(cell, f"a {kind}, b {kind}")
