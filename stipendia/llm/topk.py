"""Exact top-k search by inner product, a block of documents at a time.

Vectors become integers, floor(scale * x).  Rows are ordered by the signs of
their leading components, so that similar vectors lie close together, and cut
into blocks of consecutive rows; a block keeps its rows (the forward index)
and the largest and smallest value of every component.  For one query the
summed maxima of its terms bound every score of a block.  Blocks are visited
in falling order of that bound until it falls below the query's k-th score;
a bound equal to it is still visited, since ties go to the smaller id.

Queries and blocks meet in a grid of cells (a chunk of queries, a group of
blocks) of fixed size, whatever the number of rows.  A first pass over each
query's own block gives a k-th score to start from in every cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stipendia.llm.common import saved

BLOCK = 1024       # rows of a block
BLOCKS_A_CELL = 8
CHUNK = 256        # queries of a chunk
SIGNS = 16         # leading components that order the rows


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products: in double precision where every sum stays below 2**53, else in 64-bit integers."""
    width = min(queries.shape[1], rows.shape[1])
    q, r = queries[:, :width], rows[:, :width]
    top = int(np.abs(q).max(initial=0)) * int(np.abs(r).max(initial=0)) * max(width, 1)
    if top < 2**53:
        return (q.astype(np.float64) @ r.T.astype(np.float64)).astype(np.int64)
    return q @ r.T


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima: (queries x blocks)."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, start: np.ndarray):
        self.ids, self.k = ids, k
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        self.kth = start.copy()

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = np.flatnonzero((scores >= self.kth[query]) & (ids != self.ids[query]))
        if not len(keep):
            return
        s, i = np.concatenate([self.scores[query], scores[keep]]), np.concatenate([self.found[query], ids[keep]])
        order = np.lexsort((i, -s))[:self.k]
        self.scores[query], self.found[query] = s[order], i[order]
        if len(order) == self.k:
            self.kth[query] = max(self.kth[query], s[order[-1]])


def search(best: Best, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> None:
    """Visit (ids, rows) blocks in each query's order of ``limits`` until they fall below its k-th score."""
    order = np.argsort(-limits, axis=1, kind="stable")
    sorted_limits = np.take_along_axis(limits, order, axis=1)
    for turn in range(len(blocks)):
        active = np.flatnonzero(sorted_limits[:, turn] >= best.kth)
        if not len(active):
            break
        for b in np.unique(order[active, turn]).tolist():
            members = active[order[active, turn] == b]
            ids, rows = blocks[b]
            for query, scores in zip(members.tolist(), products(queries[members], rows)):
                best.offer(query, scores, ids)


_LOWEST = np.iinfo(np.int64).min


def _blocks(vectors: DataFrame, k: int) -> DataFrame:
    """One row per block; queries of the block come with the k-th score they reach inside it."""
    signs = F.aggregate(F.slice("vector", 1, SIGNS), F.lit(0).cast("long"),
                        lambda total, x: total * 2 + F.when(x >= 0, 1).otherwise(0))
    ordered = (vectors.withColumn("_place", signs).repartitionByRange("_place", "id").sortWithinPartitions("_place", "id")
               .select("id", "is_query", "vector"))

    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block(rows):
            nonlocal number
            width = max((len(r[2]) for r in rows), default=0)
            ids, matrix = np.array([r[0] for r in rows], np.int64), _matrix([r[2] for r in rows], width)
            asked = np.flatnonzero([r[1] for r in rows])
            best = Best(ids[asked], k, np.full(len(asked), _LOWEST))
            for i, scores in enumerate(products(matrix[asked], matrix)):
                best.offer(i, scores, ids)
            out = {"block": [number], "width": [width], "ids": [ids.tobytes()], "rows": [matrix.tobytes()],
                   "high": [matrix.max(axis=0).tobytes()], "low": [matrix.min(axis=0).tobytes()],
                   "asked": [asked.astype(np.int64).tobytes()], "kth": [best.kth.tobytes()]}
            number += 1
            return pa.RecordBatch.from_pydict(out, schema=schema)

        schema = pa.schema([("block", pa.int64()), ("width", pa.int32())]
                           + [(n, pa.binary()) for n in ("ids", "rows", "high", "low", "asked", "kth")])
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                del held[:BLOCK]
        if held:
            yield block(held)

    return ordered.mapInArrow(run, "block bigint, width int, ids binary, rows binary, high binary, low binary, asked binary, kth binary")


def _chunks(blocks: DataFrame) -> DataFrame:
    """Queries of all blocks in chunks of ``CHUNK``: (chunk, width, ids, rows, kth)."""

    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("chunk", pa.int64()), ("width", pa.int32())] + [(n, pa.binary()) for n in ("ids", "rows", "kth")])
        held: list[tuple] = []

        def chunk(rows):
            nonlocal number
            width = max(len(r[1]) for r in rows)
            out = {"chunk": [number], "width": [width], "ids": [np.array([r[0] for r in rows], np.int64).tobytes()],
                   "rows": [_matrix([r[1] for r in rows], width).tobytes()], "kth": [np.array([r[2] for r in rows], np.int64).tobytes()]}
            number += 1
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                ids, matrix = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64).reshape(-1, row["width"])
                asked = np.frombuffer(row["asked"], np.int64)
                held += zip(ids[asked].tolist(), matrix[asked], np.frombuffer(row["kth"], np.int64).tolist())
            while len(held) >= CHUNK:
                yield chunk(held[:CHUNK])
                del held[:CHUNK]
        if held:
            yield chunk(held)

    return blocks.where(F.length("asked") > 0).mapInArrow(run, "chunk bigint, width int, ids binary, rows binary, kth binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, id, score): the k highest integer products of every query with the other rows.

    Null vectors and vectors holding null or non-finite components take no part, nor do null ids.  Fewer candidates
    than k give fewer rows; ties go to the smaller id; missing trailing components count as 0; a row repeated in full
    counts once.  Scores have to fit in a long.  Other columns are not read; an empty table gives an empty table.
    """
    rows = (vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
                    quantised(F.col(vector_col), scale).alias("vector")).distinct())
    blocks = saved(_blocks(rows, k))
    chunks = saved(_chunks(blocks))
    n_chunks, n_blocks = chunks.count(), blocks.count()
    groups = -(-n_blocks // BLOCKS_A_CELL)
    every_group = F.explode(F.sequence(F.lit(0), F.lit(max(groups - 1, 0))))
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(max(n_chunks - 1, 0))))
    left = _numbered(chunks, "chunk", 1).withColumnRenamed("number", "i").select("*", every_group.alias("j"))
    right = _numbered(blocks.drop("asked", "kth"), "block", BLOCKS_A_CELL).withColumnRenamed("number", "j").select("*", every_chunk.alias("i"))

    def cell(asked: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for q in asked.itertuples():
            width = q.width
            queries = np.frombuffer(q.rows, np.int64).reshape(-1, width)
            best = Best(np.frombuffer(q.ids, np.int64), k, np.frombuffer(q.kth, np.int64))
            if len(group):
                found = [(np.frombuffer(b.ids, np.int64), np.frombuffer(b.rows, np.int64).reshape(-1, b.width)) for b in group.itertuples()]
                limits = np.concatenate([bounds(queries, np.frombuffer(b.high, np.int64)[None, :], np.frombuffer(b.low, np.int64)[None, :])
                                         for b in group.itertuples()], axis=1)
                search(best, queries, found, limits)
            for n, query in enumerate(best.ids.tolist()):
                out += [(query, i, s) for i, s in zip(best.found[n].tolist(), best.scores[n].tolist())]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(cell, "query_id bigint, id bigint, score bigint")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.s")).alias("score"))


def _numbered(df: DataFrame, key: str, divisor: int) -> DataFrame:
    """``number``: consecutive numbers of the (partition << 32 | n) keys, divided; from one small table of partitions."""
    part = F.shiftright(F.col(key), 32)
    sizes = df.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    starts, total = [], 0
    for row in sizes:
        starts += [F.lit(row["_part"]), F.lit(total)]
        total += row["n"]
    if not starts:
        return df.withColumn("number", F.lit(0).cast("int"))
    start = F.element_at(F.create_map(*starts), part)
    return df.withColumn("number", F.floor((start + F.col(key).bitwiseAND(F.lit((1 << 32) - 1))) / divisor).cast("int"))


# The same for DuckDB.
SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
