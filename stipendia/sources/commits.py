"""Several datasets published together, and logs that take every batch once.

Both rest on one rule: data goes to a folder of its own first and counts only
once a one-row note names it.  Spark commits the note as a single file, so a
reader sees all that the note names or nothing of it.  A writer that is run
again overwrites what it had staged and adds no second note.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_NOTES = "_notes"
_BUNDLE = "version long, datasets array<string>"
_BATCH = "writer string, sequence long"


def _notes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The notes of a folder; none where nothing has been published yet."""
    try:
        return spark.read.schema(schema).json(f"{folder}/{_NOTES}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _note(spark: SparkSession, folder: str, row: tuple, schema: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(f"{folder}/{_NOTES}")


def publish(datasets: dict[str, DataFrame], folder: str, version: int, fmt: str = "parquet") -> bool:
    """Write the datasets of one export and publish them together; False if this version was published before.

    Versions rise with the exports.  A run that is lost halfway leaves staged files that no note names; the next run of
    the version replaces them.
    """
    spark = next(iter(datasets.values())).sparkSession
    if _notes(spark, folder, _BUNDLE).where(F.col("version") == version).limit(1).count():
        return False
    for name, df in datasets.items():
        writer = df.write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{folder}/version={version}/{name}")
    _note(spark, folder, (version, list(datasets)), _BUNDLE)
    return True


def published(spark: SparkSession, folder: str, version: int | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The datasets of a published version, by default of the latest; empty if there is none."""
    notes = _notes(spark, folder, _BUNDLE)
    if version is not None:
        notes = notes.where(F.col("version") == version)
    row = notes.orderBy(F.desc("version")).first()
    if row is None:
        return {}
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return {name: reader.format(fmt).load(f"{folder}/version={row.version}/{name}") for name in row.datasets}


def append_once(df: DataFrame, folder: str, writer: str, sequence: int) -> bool:
    """Append a batch to a log unless this writer has appended it before; False if so.

    A writer counts its batches.  Rows keep the writer and the number of their batch.
    """
    spark = df.sparkSession
    done = _notes(spark, folder, _BATCH).where((F.col("writer") == writer) & (F.col("sequence") == sequence))
    if done.limit(1).count():
        return False
    df.write.mode("overwrite").parquet(f"{folder}/log/writer={writer}/sequence={sequence}")
    _note(spark, folder, (writer, sequence), _BATCH)
    return True


def log(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All rows of the batches that were completed, each once, with ``writer`` and ``sequence``.

    Notes are one row a batch and meet the log by an equi-join on its partition columns.
    """
    notes = _notes(spark, folder, _BATCH).distinct()
    if notes.isEmpty():
        return spark.createDataFrame([], schema).withColumns({"writer": F.lit(""), "sequence": F.lit(0).cast("long")})
    rows = spark.read.schema(schema).option("basePath", f"{folder}/log").parquet(f"{folder}/log")
    rows = rows.withColumns({"writer": F.col("writer").cast("string"), "sequence": F.col("sequence").cast("long")})
    return rows.join(notes, ["writer", "sequence"], "left_semi")
