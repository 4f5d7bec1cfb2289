"""What the corpus operators share: reading documents, tables in the shared folder, one copy per worker."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# White space beyond ASCII's usual six; a text without it can be cut at ASCII white space.
_ODD_POINTS = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F,
               *range(0x205F, 0x2065), 0x3000, 0xFEFF]
ODD_SPACE = re.compile("[" + "".join(map(chr, _ODD_POINTS)) + "]")
# Between a character that is no white space and one that is: no pre-split match reaches across.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where the session names none, as in tests."""
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None))
    if not base:
        base = tempfile.mkdtemp(prefix="stipendia-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stipendia-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller clash with nothing."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def cut_safely(text: str, size: int):
    """``text`` in parts of about ``size`` characters, cut where the tokenizer's pattern cannot reach across."""
    start = 0
    while len(text) - start > size:
        place = SAFE.search(text, start + size)
        if place is None:
            break
        yield text[start:place.start()]
        start = place.start()
    yield text[start:]
