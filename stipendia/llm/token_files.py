"""Token ids in files of independently coded, checksummed blocks.

A file set is a folder of Parquet files, written and read by Spark, so it
lies wherever the session's file systems reach.  Documents are dealt by ranges
of their id, so the shards hold them in rising order.  A row is one block: its
shard and place, the documents that start in it or reach into it (id, number
in the shard, ids of it before this block, ids in this block), and the coded
ids (``mixing_coder``).  Blocks are cut at a fixed number of ids, whatever
the documents' lengths, and each can be read alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stipendia.llm import mixing_coder
from stipendia.llm.common import plain, saved
from stipendia.llm.tokens import tokenizer

BLOCK = 4096   # ids of a block
LANES = 2048   # blocks coded side by side; bounds the memory of a task
ROWS, TEXT = 2000, 8_000_000  # documents and bytes of text tokenized at once

_BLOCK_ROW = "shard int, block long, n_ids int, docs array<struct<doc:{id},number:long,before:long,n:int>>, payload binary"


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, its end id last, in rising order of id (equal ids by a hash of their text), into ``path``.

    Null texts count as empty: their end id alone.  Repeated rows are written each.  Other columns are not read; an
    empty table gives an empty file set.
    """
    source = plain(docs, id_col, text_col).toDF("doc", "text")
    ordered = (source.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc", "_tie")
               .sortWithinPartitions("doc", "_tie").drop("_tie"))
    kind = dict(source.dtypes)["doc"]

    def run(batches):
        from pyspark import TaskContext
        shard, block, number = TaskContext.get().partitionId(), 0, 0
        codec, end = tokenizer(tokenizer_file), np.array([end_id], "<u4").tobytes()
        waiting, size = [], 0   # (doc, number, ids before, packed ids) not yet coded

        def coded(last: bool):
            nonlocal waiting, size, block
            stream = np.frombuffer(b"".join(w[3] for w in waiting), "<u4")
            whole = len(stream) if last else len(stream) // BLOCK * BLOCK
            rows: list[dict] = [{"shard": shard, "block": block + i, "n_ids": min(BLOCK, whole - at), "docs": []}
                                for i, at in enumerate(range(0, whole, BLOCK))]
            at, rest = 0, []
            for doc, num, before, packed in waiting:
                left = len(packed) // 4
                while left:
                    if at == whole:
                        rest.append((doc, num, before, packed[-4 * left:]))
                        break
                    n = min(left, BLOCK - at % BLOCK, whole - at)
                    rows[at // BLOCK]["docs"].append({"doc": doc, "number": num, "before": before, "n": n})
                    at, before, left = at + n, before + n, left - n
            for start in range(0, len(rows), LANES):
                part = rows[start:start + LANES]
                for row, payload in zip(part, mixing_coder.encode([stream[(start + i) * BLOCK:(start + i) * BLOCK + r["n_ids"]]
                                                                   for i, r in enumerate(part)])):
                    row["payload"] = payload
            block += len(rows)
            waiting, size = rest, sum(len(r[3]) for r in rest) // 4
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([
                ("shard", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()),
                ("docs", pa.list_(pa.struct([("doc", batch.schema.field(0).type), ("number", pa.int64()), ("before", pa.int64()), ("n", pa.int32())]))),
                ("payload", pa.binary())])
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for doc, ids in zip(part.column(0).to_pylist(), codec.encode(part.column(1), TEXT)):
                    waiting.append((doc, number, 0, ids + end))
                    size, number = size + len(ids) // 4 + 1, number + 1
                if size >= BLOCK * LANES:
                    yield coded(False)
        if waiting:
            yield coded(True)

    ordered.mapInArrow(run, _BLOCK_ROW.format(id=kind)).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, number, doc, before, n, ids packed): one row per document and block that holds part of it."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["docs"].dataType.elementType["doc"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, LANES):
                batch = whole.slice(start, LANES)
                shards, docs, payloads = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "docs", "payload"))
                rows: list[list] = [[], [], [], [], [], []]
                for shard, parts, ids in zip(shards, docs, mixing_coder.decode(payloads)):
                    packed, at = ids.tobytes(), 0
                    for part in parts:
                        n = part["n"]
                        for column, value in zip(rows, (shard, part["number"], part["doc"], part["before"], n, packed[at:at + 4 * n])):
                            column.append(value)
                        at += 4 * n
                field = batch.schema.field("docs").type.value_type.field("doc").type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], field), pa.array(rows[3], pa.int64()),
                     pa.array(rows[4], pa.int32()), pa.array(rows[5], pa.binary())], names=["shard", "number", "doc", "before", "n", "ids"])

    return blocks.mapInArrow(run, f"shard int, number long, doc {kind}, before long, n int, ids binary")


# --- check sums of documents that span blocks ---------------------------------------------------------------------

@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """The linear map on a CRC-32 register (one column a bit) that appends 2**power zero bytes."""
    if power == 0:
        columns = []
        for bit in range(32):
            register = 1 << bit
            for _ in range(8):
                register = (register >> 1) ^ (0xEDB88320 if register & 1 else 0)
            columns.append(register)
        return np.array(columns, np.uint64)
    half = _zeros(power - 1)
    return np.array([_apply(half, int(c)) for c in half], np.uint64)


def _apply(columns: np.ndarray, register: int) -> int:
    used = columns[[bit for bit in range(32) if register >> bit & 1]]
    return int(np.bitwise_xor.reduce(used)) if len(used) else 0


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings after each other, from their own CRC-32 and the length of the second."""
    power = 0
    while second_bytes >> power:
        if second_bytes >> power & 1:
            first = _apply(_zeros(power), first)
        power += 1
    return first ^ second


def index(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the parts that ``read`` gives.

    Parts are reduced to lengths and check sums, written once and shuffled; ``start`` adds the sums of earlier documents of the
    shard and of earlier shards, of which there are as many as files.
    """
    small = saved(parts.select("shard", "number", "doc", F.struct("before", "n", F.crc32("ids").alias("crc")).alias("part")))
    grouped = small.groupBy("shard", "number").agg(F.first("doc").alias("doc"), F.sort_array(F.collect_list("part")).alias("parts"))

    @F.pandas_udf("long")
    def crc(column: pd.Series) -> pd.Series:
        out = []
        for row in column:
            total = 0
            for k, part in enumerate(row):
                total = part["crc"] if k == 0 else joined_crc(total, part["crc"], 4 * part["n"])
            out.append(total)
        return pd.Series(out, dtype="int64")

    docs = grouped.select("shard", "number", "doc", F.aggregate("parts", F.lit(0).cast("long"), lambda t, p: t + p["n"]).alias("n_tokens"),
                          F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["crc"]).otherwise(crc("parts")).alias("ids_crc32"))
    shards = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = W.partitionBy("shard").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    return (docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shards, "shard")
            .select(F.col("doc").alias("doc_id"), (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
