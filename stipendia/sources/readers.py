"""Readers: entity tables, rosters, labelled documents, manifests, files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stipendia import schemas
from stipendia.functions.scalars import filled, is_true, kept, present
from stipendia.operators.frames import latest_by


def entity(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An entity table with its stated schema; filters and columns reach the scan."""
    return spark.read.schema(schemas.ENTITIES[name]).parquet(path)


# Accepted header spellings per roster column.
ROSTER_HEADERS = {
    "register_number": ["register number", "registernumber", "reg no", "roll number", "rollno", "reg_no"],
    "full_name": ["student name", "studentname", "full name", "fullname", "name"],
    "email": ["email", "email address", "student email"],
    "course": ["course", "degree", "programme"],
    "department": ["department", "dept", "branch"],
    "study_year": ["study year", "year", "studyyear"],
    "mobile": ["mobile", "phone", "contact", "mobile number"],
    "category": ["category", "community"],
    "family_income": ["family income", "income", "familyincome"],
}
# Defaults of missing roster values.
ROSTER_DEFAULTS = {"course": "B.E. / B.Tech", "department": "Computer Science", "study_year": "1st Year",
                   "category": "General"}
DEFAULT_INCOME = 200000.0


def roster_columns(raw: DataFrame, *carry: str) -> DataFrame:
    """Known columns of a roster, whatever its header spelling; values trimmed, defaults filled; ``carry`` as they are."""
    by_name = {re.sub(r"\s+", " ", c.strip().lower()): c for c in raw.columns}

    def pick(name: str) -> Column:
        found = [F.trim(F.col(f"`{by_name[h]}`").cast("string")) for h in ROSTER_HEADERS[name] if h in by_name]
        return filled(*found) if found else F.lit(None).cast("string")

    values = {n: pick(n) for n in ROSTER_HEADERS}
    values.update({n: F.coalesce(values[n], F.lit(d)) for n, d in ROSTER_DEFAULTS.items()})
    income = F.regexp_replace(values["family_income"], "[^0-9.]", "").try_cast("double")
    values["family_income"] = F.when(present(values["family_income"]), income).otherwise(DEFAULT_INCOME)
    return raw.select(*[v.alias(n) for n, v in values.items()], *carry)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a folder of CSV files that share a header."""
    return spark.read.option("header", True).option("inferSchema", False).option("recursiveFileLookup", True).csv(path).columns


# Why a line of a roster is set aside.
WRONG_WIDTH, NO_NUMBER, NO_NAME, NO_EMAIL = ("wrong number of columns", "Missing Register Number", "Missing Student Name",
                                             "Missing or invalid Email")


def tolerant_roster(spark: SparkSession, path: str, college_id) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows) of a folder of CSV rosters; no line fails the read.

    Every value is read as text.  Columns are found under any of their header spellings.  A line with too few or too many
    columns is quarantined whole, as it stands in the file; a row without number, name or a usable e-mail with its
    reasons.  Files are split and read by Spark; nothing is inferred from the data.
    """
    names = header_of(spark, path)
    raw = (spark.read.schema(", ".join(f"`{n}` string" for n in names) + ", _line string").option("header", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").option("columnPruning", False)
           .option("recursiveFileLookup", True).csv(path))
    known = roster_columns(raw, "_line")
    reasons = kept([(F.col("_line").isNotNull(), F.lit(WRONG_WIDTH)),
                    (F.col("_line").isNull() & ~present(F.col("register_number")), F.lit(NO_NUMBER)),
                    (F.col("_line").isNull() & ~present(F.col("full_name")), F.lit(NO_NAME)),
                    (F.col("_line").isNull() & ~is_true(F.col("email").contains("@")), F.lit(NO_EMAIL))])
    judged = known.withColumn("reasons", reasons).withColumn("college_id", F.lit(college_id))
    good = judged.where(F.size("reasons") == 0).drop("reasons", "_line")
    return good, judged.where(F.size("reasons") > 0).select("college_id", "register_number", "full_name", "email", "_line", "reasons")


def roster(spark: SparkSession, path: str, college_id) -> DataFrame:
    """A CSV roster of one college; every value is read as text, never inferred."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    return roster_columns(raw).withColumn("college_id", F.lit(college_id))


def labelled_documents(spark: SparkSession, path: str) -> DataFrame:
    """Labelled documents, one row per id.

    Of repeated ids the file of the newer generation is kept, which is the one
    that carries marks.
    """
    raw = spark.read.schema(schemas.LABELLED_DOCUMENT).option("multiLine", True).json(path)
    ranked = raw.withColumn("_marks", F.col("ground_truth.marks").isNotNull().cast("int")).withColumn(
        "_truth", F.to_json("ground_truth"))
    return latest_by(ranked, ["id"], ["_marks", "_truth"]).drop("_marks", "_truth")


def manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    """A line-delimited JSON manifest."""
    return spark.read.schema(schema).json(path)


def tolerant_manifest(spark: SparkSession, path: str, schema: str, required: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines with a reason) of a line-delimited JSON manifest.

    ``schema`` is a column list.  A line that is no JSON object of the schema, or that lacks ``required``, is
    quarantined as it stands; a field the schema does not name is left out.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    read = lines.select("value", F.from_json("value", f"{schema}, _broken string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("row"))
    broken, lacking = F.col("row._broken").isNotNull(), F.col(f"row.{required}").isNull()
    good = read.where(~broken & ~lacking).select("row.*").drop("_broken")
    bad = read.where(broken | lacking).select("value", F.when(broken, "not readable").otherwise(f"no {required}").alias("reason"))
    return good, bad


def files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """File contents with path and length, for fingerprints only."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
            .select("path", "length", "content"))


# Files that the driver plans at once.
BATCH_FILES = 32_768


def file_batches(spark: SparkSession, folders: list[tuple[str, int]]) -> Iterator[DataFrame]:
    """The contents of all files of folders, given with their numbers of files, some folders at a time.

    The driver holds the names of one batch only.  Spark plans a task for every few files; here one reads about a folder.
    """
    batch: list[str] = []
    planned = 0
    for n, (folder, count) in enumerate(folders, 1):
        batch.append(folder)
        planned += count
        if planned >= BATCH_FILES or n == len(folders):
            yield files(spark, batch).coalesce(len(batch))
            batch, planned = [], 0


def stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 64) -> DataFrame:
    """An append-only log folder as a stream, with a bounded intake per trigger."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))
