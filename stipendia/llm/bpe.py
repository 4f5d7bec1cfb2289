"""Byte-level BPE with the tiktoken library and a local rank file.

Texts longer than ``PART`` characters are cut before the library sees them,
only where a character that is no white space meets white space: the
pre-split pattern has no match across such a place and looks ahead only
inside white space, so the ids are those of the whole text.  Ids travel as
packed little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from stipendia.llm.common import cut_safely, plain

PART = 50_000


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """One encoder per worker process."""
    import tiktoken
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(codec, text: str | None) -> bytes:
    if not text:
        return b""
    if len(text) <= PART:
        return np.asarray(codec.encode_ordinary(text), "<u4").tobytes()
    return b"".join(np.asarray(codec.encode_ordinary(part), "<u4").tobytes() for part in cut_safely(text, PART))


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id column, ``n_tokens`` and ``ids`` (packed).

    Null and empty texts give no ids; repeated rows are encoded each; other
    columns are not read.  An empty table gives an empty table.
    """
    source = plain(docs, id_col, text_col)

    def run(batches):
        codec = encoding(rank_file, pattern)
        for batch in batches:
            ids = [encode_text(codec, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[id_col, "n_tokens", "ids"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds ``decoded``: the raw bytes of the packed ``ids``, whether they are valid UTF-8 or not; null ids give none."""
    source, source_names = encoded, encoded.columns

    def run(batches):
        codec = encoding(rank_file, pattern)
        at = source_names.index("ids")
        for batch in batches:
            raw = [codec.decode_bytes(np.frombuffer(i.as_py() or b"", "<u4").tolist()) for i in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*source_names, "decoded"])

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField("decoded", BinaryType())]))


def digest(encoded_and_decoded: DataFrame) -> DataFrame:
    return encoded_and_decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                      F.sha2("decoded", 256).alias("decoded_sha256"))
