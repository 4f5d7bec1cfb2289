"""Exports, logs and ingest: each query writes files and reads them back, so that what is compared has been on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stipendia.operators import documents, enrich, lifecycle
from stipendia.plans.registry import query
from stipendia.session import work_folder
from stipendia.sources import commits, readers, sinks

VERSION = 1


# --- exports ---------------------------------------------------------------------------------------

def _people(t):
    return t.students.select("student_id", "full_name", "course", "department", "college_id", "account_status")


def _college_sheet(t) -> DataFrame:
    """One row per student and application; students without an application keep their row."""
    admin = enrich.admin_table(t.apps, t.students, t.colleges, t.reviews, t.tickets, t.uploads, t.deficiencies)
    apps = t.apps_raw.select("application_id", "student_id", "scheme_id", "application_status", "document_status", "academic_year",
                             "submitted_at")
    reviewer = F.when(F.col("reviewer_id").isNotNull(), F.format_string("Officer (%s)", F.col("reviewer_id").cast("string")))
    checked = admin.select("application_id", "decision", "verification", "mismatches", "pending_correction", reviewer.alias("reviewer"))
    return sinks.sheet(_people(t).join(apps, "student_id", "left").join(checked, "application_id", "left").withColumn(
        "register_number", F.col("student_id")).withColumn("application_year", F.col("academic_year")), sinks.COLLEGE_SHEET)


def _application_sheet(t) -> DataFrame:
    rows = enrich.star(t.apps, t.students, t.colleges, t.rules, t.payments_raw)
    open_items = t.deficiencies.where("status = 'OPEN'").groupBy("application_id").agg(F.count(F.lit(1)).alias("open_deficiencies"))
    staged = lifecycle.with_stage_defaults(rows.join(open_items, "application_id", "left"), "application_status")
    return sinks.sheet(staged.withColumns({
        "register_number": F.col("student_id"), "scheme_name": F.col("scheme_id"), "application_year": F.col("academic_year")}),
        sinks.APPLICATION_SHEET)


def _named(t, rows: DataFrame) -> DataFrame:
    """Rows of applications with the names of student and college.

    The names are joined to the applications first: rows of theirs, the largest tables, are moved once.
    """
    apps = t.apps_raw.select("application_id", "student_id", "scheme_id", "academic_year")
    named = (apps.join(t.students.select("student_id", "college_id", "full_name"), "student_id", "left")
             .join(t.colleges.select("college_id", "college_name"), "college_id", "left"))
    return rows.join(named, "application_id", "left").withColumn("scheme_name", F.col("scheme_id"))


def _payment_sheet(t) -> DataFrame:
    return sinks.sheet(_named(t, t.payments_raw), sinks.PAYMENT_SHEET)


def _deficiency_sheet(t) -> DataFrame:
    rows = t.deficiencies.select("*", enrich.required_action(F.col("deficiency_type")).alias("action"),
                                 F.date_add(F.col("created_at").cast("date"), 14).alias("due_on"))
    return sinks.sheet(_named(t, rows), sinks.DEFICIENCY_SHEET)


def _history_sheet(t) -> DataFrame:
    return sinks.sheet(lifecycle.status_steps(t.history), sinks.HISTORY_SHEET)


SHEETS = {"college": _college_sheet, "applications": _application_sheet, "payments": _payment_sheet,
          "deficiencies": _deficiency_sheet, "history": _history_sheet}


def _exported(t, *names: str) -> dict[str, DataFrame]:
    """The sheets written as one version and read again.  The second run of the version has to change nothing."""
    folder = work_folder(t.spark)
    sheets = {name: SHEETS[name](t) for name in names}
    if not commits.publish(sheets, folder, VERSION) or commits.publish(sheets, folder, VERSION):
        raise RuntimeError("a version has to be published once")
    return commits.published(t.spark, folder)


def _sheet_sql(layout, values: dict[str, str], source: str) -> str:
    """Headers over SQL values; a header without a value shows its default."""
    shown = [f"coalesce(nullif(CAST({values[c]} AS VARCHAR), ''), '{d}') AS \"{h}\"" if c in values else f"'{d}' AS \"{h}\""
             for h, c, d in layout]
    return f"SELECT {', '.join(shown)} FROM {source}"


def _second(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


_LAST = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY reviewed_at DESC,
 line_number DESC, reviewer_id DESC, part_number DESC) AS rn FROM reviews) WHERE rn = 1),
v AS (SELECT application_id, count_if(mismatch) AS m, count(*) AS n FROM uploads GROUP BY 1),
o AS (SELECT application_id, count(*) AS o FROM deficiencies WHERE status = 'OPEN' GROUP BY 1)"""


@query("college_sheet", "SNK-01 PRJ-02 JOI-01", f"""WITH {_LAST} """ + _sheet_sql(sinks.COLLEGE_SHEET, {
    "register_number": "s.student_id", "full_name": "full_name", "course": "course", "academic_year": "academic_year",
    "account_status": "account_status", "scheme_id": "scheme_id", "application_year": "academic_year", "application_id": "a.application_id",
    "application_status": "application_status", "document_status": "document_status",
    "verification": "CASE WHEN a.application_id IS NOT NULL THEN CASE WHEN m > 0 THEN 'FLAGGED' WHEN n > 0 THEN 'VERIFIED' ELSE 'PENDING' END END",
    "mismatches": "CASE WHEN a.application_id IS NOT NULL THEN coalesce(m, 0) END",
    "pending_correction": "CASE WHEN o = 1 THEN 'Yes (1 item)' WHEN o > 1 THEN 'Yes (' || o || ' items)' END",
    "reviewer": "'Officer (' || reviewer_id || ')'", "decision": "decision", "submitted_at": _second("submitted_at"),
}, "students s LEFT JOIN apps_raw a USING (student_id) LEFT JOIN r ON a.application_id = r.application_id LEFT JOIN v ON a.application_id"
   " = v.application_id LEFT JOIN o ON a.application_id = o.application_id"))
def _(t):
    return _exported(t, "college")["college"]


_STAGES = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in lifecycle.STAGE_DEFAULTS)
_ALIASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lifecycle.STAGE_ALIASES.items())


@query("application_sheet", "SNK-02 JOI-04 RUL-23", f"""
WITH p AS (SELECT application_id, sum(sanctioned) AS s, coalesce(sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END), 0) AS c,
 arg_max(payment_status, (instalment, payment_id, payment_status)) AS last FROM payments_raw GROUP BY 1),
o AS (SELECT application_id, count(*) AS o FROM deficiencies WHERE status = 'OPEN' GROUP BY 1),
g AS (SELECT * FROM (VALUES {_STAGES}) AS g(stage, stage_label, who_must_act, next_action)),
a AS (SELECT *, CASE application_status {_ALIASES} ELSE application_status END AS stage FROM apps) """ + _sheet_sql(sinks.APPLICATION_SHEET, {
    "application_id": "a.application_id", "register_number": "a.student_id", "full_name": "full_name", "college_id": "a.college_id",
    "college_name": "college_name", "state": "k.state", "course": "course", "department": "department", "academic_year": "academic_year",
    "application_year": "academic_year", "scheme_id": "a.scheme_id", "scheme_name": "a.scheme_id", "application_status": "application_status",
    "document_status": "document_status", "open_deficiencies": "o", "last_payment_status": "last", "sanctioned_total": "s", "paid_total": "c",
    "stage_label": "stage_label", "who_must_act": "who_must_act", "next_action": "next_action", "submitted_at": _second("submitted_at"),
}, "a LEFT JOIN students t USING (student_id) LEFT JOIN colleges k ON a.college_id = k.college_id LEFT JOIN p ON a.application_id"
   " = p.application_id LEFT JOIN o ON a.application_id = o.application_id LEFT JOIN g ON a.stage = g.stage"))
def _(t):
    return _exported(t, "applications")["applications"]


_WHO = "LEFT JOIN apps a USING (application_id) LEFT JOIN students s ON a.student_id = s.student_id LEFT JOIN colleges c ON a.college_id = c.college_id"


@query("payment_sheet", "SNK-02", _sheet_sql(sinks.PAYMENT_SHEET, {
    "payment_id": "payment_id", "application_id": "application_id", "full_name": "full_name", "college_name": "college_name",
    "scheme_name": "a.scheme_id", "academic_year": "a.academic_year", "instalment": "instalment", "sanctioned": "sanctioned", "paid": "paid",
    "payment_status": "payment_status", "paid_on": _second("paid_on")}, f"payments_raw p {_WHO}"))
def _(t):
    return _exported(t, "payments")["payments"]


@query("deficiency_sheet", "SNK-02 PRJ-04", _sheet_sql(sinks.DEFICIENCY_SHEET, {
    "application_id": "application_id", "full_name": "full_name", "college_name": "college_name", "deficiency_type": "deficiency_type",
    "action": "CASE deficiency_type WHEN 'UNCLEAR_DOCUMENT' THEN 'Upload clear and legible copy of document' WHEN 'INVALID_INFORMATION' THEN"
              " 'Contact issuing authority or correct registration information' ELSE 'Verify and submit corrected document metadata' END",
    "severity": "severity", "status": "status", "created_at": _second("created_at"),
    "due_on": "strftime(CAST(created_at AS DATE) + 14, '%Y-%m-%d')"}, f"deficiencies d {_WHO}"))
def _(t):
    return _exported(t, "deficiencies")["deficiencies"]


@query("history_sheet", "SNK-02 WIN-06", "WITH h AS (SELECT *, lag(new_status) OVER (PARTITION BY application_id ORDER BY changed_at, history_id)"
       " AS before FROM history) " + _sheet_sql(sinks.HISTORY_SHEET, {
           "history_id": "history_id", "application_id": "application_id", "previous_status": "before", "new_status": "new_status",
           "changed_at": _second("changed_at")}, "h"))
def _(t):
    return _exported(t, "history")["history"]


@query("export_bundle", "SNK-01 SNK-02", """
SELECT 'college' AS dataset, count(*) AS rows, CAST(26 AS INT) AS columns FROM students LEFT JOIN apps_raw USING (student_id)
UNION ALL SELECT 'applications', count(*), 27 FROM apps_raw UNION ALL SELECT 'payments', count(*), 15 FROM payments_raw
UNION ALL SELECT 'deficiencies', count(*), 13 FROM deficiencies UNION ALL SELECT 'history', count(*), 10 FROM history""")
def _(t):
    """All five datasets under one note."""
    parts = [df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))
             for name, df in _exported(t, *SHEETS).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- logs ------------------------------------------------------------------------------------------

@query("event_log", "SNK-05 STR-05", """
SELECT history_id, application_id, new_status, CAST(changed_at AS DATE) AS on_day,
 'w' || (history_id % 3) AS writer, CAST(1 + (history_id // 3) % 2 AS BIGINT) AS sequence FROM history""")
def _(t):
    """Three writers append two batches each; every batch is sent twice and is in the log once."""
    folder = work_folder(t.spark)
    rows = t.history.select("history_id", "application_id", "new_status", F.col("changed_at").cast("date").alias("on_day"))
    for _ in range(2):
        for w in range(3):
            for n in (1, 2):
                batch = rows.where((F.col("history_id") % 3 == w) & (F.floor(F.col("history_id") / 3) % 2 + 1 == n))
                commits.append_once(batch, folder, f"w{w}", n)
    return commits.log(t.spark, folder, rows.schema)


@query("json_results", "SNK-03 SRC-05", """
SELECT application_id, verification_id, document_type, mismatch, CAST(processed_at AS DATE) AS on_day FROM uploads""")
def _(t):
    """Results as JSON lines, read back as a manifest."""
    folder = work_folder(t.spark)
    rows = t.uploads.select("application_id", "verification_id", "document_type", "mismatch", F.col("processed_at").cast("date").alias("on_day"))
    sinks.write_json_lines(rows, folder)
    return readers.manifest(t.spark, folder, rows.schema)


# --- ingest ----------------------------------------------------------------------------------------

# A roster as colleges send it: own header spellings, blanks, empty cells, quoted amounts, lines cut off or too long.
_HEADER = "Reg No,STUDENT NAME ,Email,Income"
_NAME = "CASE WHEN row_number % 11 = 3 THEN '' ELSE coalesce(full_name, '') END"
_BROKEN = {"CASE WHEN row_number % 13 = 5": "'R1,cut off'", "WHEN row_number % 17 = 6": "'R2,a,b@c,1,too,many'"}
_LINE = " ".join(f"{case} THEN {line}" for case, line in _BROKEN.items()) + (
    f" ELSE concat(coalesce(register_number, ''), ' ,', {_NAME}, ',', email, ',',"
    " CASE WHEN row_number % 7 = 0 THEN '\"Rs 1,20,000\"' ELSE '95000' END) END")


@query("roster_files", "SRC-04 RUL-26", f"""
WITH c AS (SELECT {_LINE} AS line, CASE WHEN row_number % 13 = 5 THEN 1 WHEN row_number % 17 = 6 THEN 2 ELSE 0 END AS broken,
 trim(coalesce(register_number, '')) AS number, {_NAME} AS name, email,
 CASE WHEN row_number % 7 = 0 THEN CAST(120000 AS DOUBLE) ELSE CAST(95000 AS DOUBLE) END AS income FROM roster),
r AS (SELECT *, CASE WHEN broken > 0 THEN 'wrong number of columns' ELSE concat_ws('; ', CASE WHEN number = '' THEN 'Missing Register Number' END,
 CASE WHEN name = '' THEN 'Missing Student Name' END, CASE WHEN NOT contains(email, '@') THEN 'Missing or invalid Email' END) END AS reasons FROM c)
SELECT CASE broken WHEN 1 THEN 'R1' WHEN 2 THEN 'R2' ELSE nullif(number, '') END AS register_number,
 CASE broken WHEN 1 THEN 'cut off' WHEN 2 THEN 'a' ELSE nullif(name, '') END AS full_name,
 CASE broken WHEN 1 THEN NULL WHEN 2 THEN 'b@c' ELSE email END AS email, CASE WHEN reasons = '' THEN income END AS family_income,
 CASE WHEN reasons = '' THEN 'Computer Science' END AS department, CASE WHEN broken > 0 THEN line END AS line, reasons FROM r""")
def _(t):
    """Roster files with broken lines, read back: good rows and quarantined ones with their reasons."""
    folder, files = work_folder(t.spark), 8
    sent = t.roster.select((F.col("row_number") % files).alias("file"), F.lit(1).alias("part"), F.expr(_LINE).alias("line"))
    heads = t.spark.range(files).select(F.col("id").alias("file"), F.lit(0).alias("part"), F.lit(_HEADER).alias("line"))
    (sent.unionByName(heads).repartition("file").sortWithinPartitions("file", "part").select("file", "line")
     .write.mode("overwrite").partitionBy("file").text(folder))
    good, bad = readers.tolerant_roster(t.spark, folder, "c1")
    kept = good.select("register_number", "full_name", "email", "family_income", "department", F.lit(None).cast("string").alias("line"),
                       F.lit("").alias("reasons"))
    return kept.unionByName(bad.select(
        "register_number", "full_name", "email", F.lit(None).cast("double").alias("family_income"),
        F.lit(None).cast("string").alias("department"), F.col("_line").alias("line"), F.concat_ws("; ", "reasons").alias("reasons")))


_JSON = """CASE WHEN verification_id % 9 = 4 THEN concat('{"id": "', CAST(verification_id AS STRING_), '", "type": "')
 WHEN verification_id % 10 = 3 THEN concat('{"type": "', document_type, '"}')
 ELSE concat('{"id": "', CAST(verification_id AS STRING_), '", "type": "', document_type, '", "wrong": ', CASE WHEN mismatch THEN 'true' ELSE 'false' END,
  ', "more": [1]}') END"""


@query("manifest_files", "SRC-05", f"""
WITH l AS (SELECT *, {_JSON.replace("STRING_", "VARCHAR")} AS line, CASE WHEN verification_id % 9 = 4 THEN 'not readable'
 WHEN verification_id % 10 = 3 THEN 'no id' END AS reason FROM uploads)
SELECT CASE WHEN reason IS NULL THEN CAST(verification_id AS VARCHAR) END AS id, CASE WHEN reason IS NULL THEN document_type END AS type,
 CASE WHEN reason IS NULL THEN mismatch END AS wrong, CASE WHEN reason IS NOT NULL THEN line END AS line, reason FROM l""")
def _(t):
    """A manifest with lines cut off and lines without an id, read back."""
    folder = work_folder(t.spark)
    t.uploads.select(F.expr(_JSON.replace("STRING_", "STRING")).alias("value")).write.mode("overwrite").text(folder)
    good, bad = readers.tolerant_manifest(t.spark, folder, "id string, type string, wrong boolean", "id")
    none = (lambda name, kind: F.lit(None).cast(kind).alias(name))
    return good.select("*", none("line", "string"), none("reason", "string")).unionByName(bad.select(
        none("id", "string"), none("type", "string"), none("wrong", "boolean"), F.col("value").alias("line"), "reason"))


@query("file_copies", "SRC-09 TXT-23", """
WITH f AS (SELECT doc_id, sha256(coalesce(text, '') || chr(10)) AS fingerprint, strlen(coalesce(text, '')) + 1 AS length FROM documents)
SELECT doc_id, fingerprint, CAST(length AS BIGINT) AS length, count(*) OVER (PARTITION BY fingerprint) AS copies,
 min(doc_id) OVER (PARTITION BY fingerprint) AS first_doc FROM f""")
def _(t):
    """One file a document, read as bytes: fingerprint, copies and the first of them."""
    folder = work_folder(t.spark)
    hashed = t.spark.createDataFrame([], "doc_id long, length long, fingerprint string")
    hashed.write.parquet(f"{folder}/hashed")
    docs = t.raw("documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    for found in readers.file_batches(t.spark, sinks.write_texts(docs, f"{folder}/files", "name", "text")):
        ids = found.select(sinks.file_name(F.col("path")).try_cast("long").alias("doc_id"), "length", "content")
        documents.hashed(ids).write.mode("append").parquet(f"{folder}/hashed")
    marked = documents.fingerprints(t.spark.read.schema(hashed.schema).parquet(f"{folder}/hashed"), content=None)
    first = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc"))
    return marked.join(first, "fingerprint").select("doc_id", "fingerprint", "length", "copies", "first_doc")
