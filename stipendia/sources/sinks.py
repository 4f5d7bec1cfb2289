"""Writers: exports, line-delimited results, upserts, event logs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stipendia.operators.frames import latest_by

# Export headers of the college sheet (header, column, default).
COLLEGE_SHEET = [
    ("Register Number", "register_number", "—"), ("Student Name", "full_name", "—"), ("Course", "course", "—"),
    ("Study Year", "study_year", "—"), ("Academic Year", "academic_year", "2026-2027"),
    ("Account Activation", "account_status", "ACTIVE"), ("Scheme", "scheme_id", "—"), ("Application Year", "application_year", "2026"),
    ("Internal Application ID", "application_id", "—"), ("External Reference", "external_application_id", "—"),
    ("Application Status", "application_status", "NO_APPLICATION"), ("Document Status", "document_status", "PENDING"),
    ("OCR/Verification Status", "verification", "VERIFIED"), ("Eligibility Status", "eligibility_status", "PENDING"),
    ("Mismatch Count", "mismatches", "0"), ("Pending Correction", "pending_correction", "No"), ("Reviewer", "reviewer", "—"),
    ("Review Status", "decision", "PENDING"), ("Tracking Source", "external_portal_source", "Internal"),
    ("Last Checked Date", "external_last_checked", "—"), ("Next Action", "next_action", "—"), ("Ticket Owner", "ticket_owner", "—"),
    ("Latest Ticket Reply", "latest_reply", "—"), ("Ticket Deadline", "ticket_deadline", "—"),
    ("Submitted Date", "submitted_at", "—"), ("Last Updated", "last_updated_at", "—"),
]
# Export headers of the application sheet (header, column, default).
APPLICATION_SHEET = [
    ("Internal Application ID", "application_id", "—"), ("External Reference", "external_application_id", "—"),
    ("Register Number", "register_number", "—"), ("Student Name", "full_name", "—"), ("College ID", "college_id", "—"),
    ("College Name", "college_name", "—"), ("State", "state", "Tamil Nadu"), ("Course", "course", "—"), ("Department", "department", "—"),
    ("Study Year", "study_year", "—"), ("Academic Year", "academic_year", "2026-2027"), ("Application Year", "application_year", "2026"),
    ("Scheme ID", "scheme_id", "—"), ("Scheme Name", "scheme_name", "—"), ("Application Status", "application_status", "—"),
    ("Document Status", "document_status", "PENDING"), ("Eligibility Status", "eligibility_status", "PENDING"),
    ("Open Deficiencies", "open_deficiencies", "0"), ("Payment Status", "last_payment_status", "PENDING"),
    ("Sanctioned Amount (₹)", "sanctioned_total", "0"), ("Confirmed Paid Amount (₹)", "paid_total", "0"),
    ("Last Reviewer Role", "reviewer", "—"), ("Current Stage", "stage_label", "—"), ("Who Must Act", "who_must_act", "—"),
    ("Next Action", "next_action", "—"), ("Submitted Date", "submitted_at", "—"), ("Last Updated", "last_updated_at", "—"),
]
# Export headers of the payment sheet (header, column, default).
PAYMENT_SHEET = [
    ("Payment ID", "payment_id", "—"), ("Application ID", "application_id", "—"), ("Student", "full_name", "—"),
    ("College", "college_name", "—"), ("Scheme", "scheme_name", "—"), ("Academic Year", "academic_year", "2026-2027"),
    ("Payment Component", "component", "DBT Scholarship Component"), ("Installment", "instalment", "1"),
    ("Sanctioned Amount (₹)", "sanctioned", "0"), ("Confirmed Paid Amount (₹)", "paid", "0"),
    ("Payment Status", "payment_status", "PENDING"), ("UTR / Reference", "payment_reference", "—"),
    ("Payment Source", "source", "DBT_CONFIRMED_MANUAL"), ("Payment Date", "paid_on", "—"),
    ("Last Successful Update", "created_at", "—"),
]
# Export headers of the deficiency sheet (header, column, default).
DEFICIENCY_SHEET = [
    ("Deficiency ID", "deficiency_id", "—"), ("Application ID", "application_id", "—"), ("Student", "full_name", "—"),
    ("College", "college_name", "—"), ("Deficiency Type", "deficiency_type", "DATA_MISMATCH"), ("Description", "description", "—"),
    ("Required Action", "action", "—"), ("Assigned Staff", "assigned_to", "Student / Institutional Staff"),
    ("Severity", "severity", "HIGH"), ("Status", "status", "OPEN"), ("Created Date", "created_at", "—"),
    ("Due Date", "due_on", "—"), ("Resolved Date", "resolved_at", "—"),
]
# Export headers of the status history sheet (header, column, default).
HISTORY_SHEET = [
    ("History ID", "history_id", "—"), ("Application ID", "application_id", "—"), ("Previous Status", "previous_status", "NONE"),
    ("New Status", "new_status", "—"), ("Changed By", "changed_by", "—"), ("Role", "changed_by_role", "—"), ("Reason", "reason", "—"),
    ("Source", "source", "INTERNAL"), ("Evidence Reference", "evidence_reference", "—"), ("Timestamp", "changed_at", "—"),
]


def sheet(df: DataFrame, layout: list[tuple[str, str, str]]) -> DataFrame:
    """Rows under their published headers; absent and empty values take the layout's default.

    Times are written to the second, dates as year-month-day.
    """
    kinds = dict(df.dtypes)

    def text(column: str):
        if column not in kinds:
            return F.lit(None).cast("string")
        if kinds[column].startswith("timestamp"):
            return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss")
        return F.nullif(F.col(column).cast("string"), F.lit(""))

    return df.select(*[F.coalesce(text(c), F.lit(default)).alias(header) for header, c, default in layout])


def write_table(df: DataFrame, path: str, by: str | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write partitioned files; rows of a partition value are spread over tasks, not gathered in one."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(by) if by else writer).save(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# Files in one folder, and bytes of text after which the next folder begins.
FOLDER_FILES, FOLDER_BYTES = 1024, 64 << 20


def write_texts(df: DataFrame, path: str, name: str, text: str) -> list[tuple[str, int]]:
    """One text file a row, ending in a line end; gives the folders and about how many files each holds.

    ``name`` is part of the file's path, without slashes, and may repeat; ``file_name`` finds it there.  Only folders of the tasks that
    succeeded are given, so whatever a lost attempt has left is not read.  In a file system of the machine Spark's writer
    starts a process a file to set its rights and makes a folder for each; there the tasks write the files themselves.
    """
    spark = df.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = df.select(F.concat(F.lit("name="), F.col(name), F.lit("-"), F.monotonically_increasing_id()).alias("name"), F.col(text).alias("text"))
    if store.getUri().getScheme() != "file":
        return _texts_by_spark(rows, path, store, root)
    local = store.makeQualified(root).toUri().getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, written, size = None, 0, 0
        for batch in batches:
            for label, content in zip(batch.column(0), batch.column(1)):
                if folder is None or written == FOLDER_FILES or size >= FOLDER_BYTES:
                    if folder:
                        yield _counted(folder, written)
                    folder, written, size = uuid.uuid4().hex, 0, 0
                    os.makedirs(f"{local}/{folder}")
                content = content.as_buffer()
                with open(f"{local}/{folder}/{label}.txt", "xb") as file:
                    file.write(content)
                written, size = written + 1, size + content.size
        if folder:
            yield _counted(folder, written)

    content = F.concat("text", F.lit("\n")).cast("binary").alias("content")
    return [(f"{path}/{r.folder}", r.files) for r in rows.select("name", content).mapInArrow(run, "folder string, files long").collect()]


def _counted(folder: str, files: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"folder": pa.array([folder], pa.string()), "files": pa.array([files], pa.int64())})


def _texts_by_spark(rows: DataFrame, path: str, store, root) -> list[tuple[str, int]]:
    """The same files for a store that only Spark's writer reaches; a folder is written by one task and moved at once."""
    folders = max(1, -(-rows.count() // FOLDER_FILES))
    named = rows.select(F.pmod(F.xxhash64("name"), F.lit(folders)).alias("folder"), F.expr("substr(name, 6)").alias("name"), "text")
    named.repartition("folder").write.partitionBy("folder", "name").text(path)
    return [(s.getPath().toString(), FOLDER_FILES) for s in store.listStatus(root) if s.isDirectory()]


def file_name(path: Column) -> Column:
    """The name under which ``write_texts`` has written a file."""
    return F.regexp_extract(path, r"/name=([^/]*)-[0-9]+(?:/|\.txt$)", 1)


def write_delta(batch: DataFrame, epoch: int, path: str, keys: list[str], order: list[str]) -> None:
    """Changed keys of one micro-batch as their own folder; a replayed batch overwrites itself."""
    latest_by(batch, keys, order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def read_state(spark, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows over all deltas written so far."""
    return latest_by(spark.read.parquet(path), keys, order).drop("epoch")


def compact(spark, path: str, target: str, keys: list[str], order: list[str]) -> None:
    """Fold the deltas into one folder that readers switch to."""
    read_state(spark, path, keys, order).write.mode("overwrite").parquet(f"{target}/epoch=0")
