"""Status history, rule versions, alerts and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions import lexicon
from stipendia.functions.scalars import as_instant, first_case, is_true, seconds_between
from stipendia.operators.frames import count_if, latest_by, numbered, with_key_count, with_neighbours
from stipendia.operators.metrics import pending_college

# Allowed moves of an application (from, to).
TRANSITIONS = [
    ("DRAFT", "SUBMITTED"), ("RESUBMITTED", "SUBMITTED"), ("CORRECTION_REQUIRED", "RESUBMITTED"),
    ("SUBMITTED", "COLLEGE_REVIEW"), ("RESUBMITTED", "COLLEGE_REVIEW"), ("SUBMITTED", "CORRECTION_REQUIRED"),
    ("RESUBMITTED", "CORRECTION_REQUIRED"), ("COLLEGE_REVIEW", "CORRECTION_REQUIRED"),
    ("SUBMITTED", "MINISTRY_SCRUTINY"), ("RESUBMITTED", "MINISTRY_SCRUTINY"),
    ("COLLEGE_REVIEW", "MINISTRY_SCRUTINY"), ("MINISTRY_SCRUTINY", "ELIGIBILITY_CONFIRMED"),
    ("MINISTRY_SCRUTINY", "SELECTED"), ("MINISTRY_SCRUTINY", "NOT_SELECTED"),
    ("ELIGIBILITY_CONFIRMED", "SELECTED"), ("ELIGIBILITY_CONFIRMED", "NOT_SELECTED"),
    ("SELECTED", "AWARD_ACCEPTANCE"), ("SELECTED", "SANCTIONED"), ("AWARD_ACCEPTANCE", "SANCTIONED"),
    ("SANCTIONED", "PAYMENT_PENDING"), ("SANCTIONED", "PAID"), ("PAYMENT_PENDING", "PAID"), ("PAID", "CONTINUATION"),
    ("PAID", "COMPLETED"), ("CONTINUATION", "COMPLETED"),
]
# Stage spellings accepted for a stage.
STAGE_ALIASES = {"IN_PROCESS": "COLLEGE_REVIEW", "IN_PROGRESS": "COLLEGE_REVIEW",
                 "DOCUMENT_ISSUES": "CORRECTION_REQUIRED", "DOCUMENT_ISSUE": "CORRECTION_REQUIRED",
                 "CORRECTION": "CORRECTION_REQUIRED", "PROCESS": "SANCTIONED", "PROCESSED": "SANCTIONED"}
# Stage, label, who must act, next action.
STAGE_DEFAULTS = [
    ("DRAFT", "Application Created", "Student", "Complete document upload and submit application"),
    ("DOCUMENT_VERIFICATION", "Documents Uploaded & OCR", "Student / College Verifier",
     "Verify OCR certificate extractions and bonafide credentials"),
    ("ELIGIBILITY_CONFIRMED", "Eligibility Pre-Check", "Eligibility Verification Cell",
     "Proceed to institutional college-level verification"),
    ("COLLEGE_REVIEW", "College Verification (In Process)", "College Verification Officer",
     "College committee visual certificate check and bonafide sign-off"),
    ("CORRECTION_REQUIRED", "Document Issues / Correction Required", "Student (Resolve Document Issues)",
     "Student must re-upload flagged document and resubmit"),
    ("MINISTRY_SCRUTINY", "Ministry Scrutiny (In Process)", "Ministry Scrutiny Committee",
     "State/Ministry scrutiny officer verifies institutional recommendation"),
    ("SELECTION", "Selection Committee Evaluation", "Selection Committee",
     "Selection committee evaluates merit ranking and quota"),
    ("SANCTIONED", "Award & Sanction (Processed)", "Sanctioning Authority",
     "Generate formal award letter and sanction order"),
    ("PAID", "DBT Payment Credit (Processed)", "PFMS / Bank DBT Cell",
     "Direct Benefit Transfer credit via NPCI Aadhaar-seeded bank account"),
    ("COMPLETED", "Renewal / Completion (Processed)", "Student / Institution",
     "Application cycle completed. Track renewal period."),
]
# Statuses an external portal may report.
EXTERNAL_STATUSES = ["SUBMITTED", "UNDER_VERIFICATION", "DEFICIENCY", "VERIFIED", "SELECTED", "SANCTIONED",
                     "PAYMENT_PROCESSED", "OTHER", "UNKNOWN"]


# --- history ------------------------------------------------------------------------------------

def status_steps(history: DataFrame) -> DataFrame:
    """Every event with the status before it and the seconds until the next one."""
    rows = with_neighbours(history, ["application_id"], [F.col("changed_at"), F.col("history_id")],
                           {"new_status": "previous_status"}, {"changed_at": "next_at"})
    return rows.withColumn("dwell_seconds", seconds_between(F.col("changed_at"), F.col("next_at"))).drop("next_at")


def stored_previous_disagrees(history: DataFrame) -> DataFrame:
    """Events whose recorded previous status is not the status that came before."""
    w = status_steps(history.withColumnRenamed("previous_status", "recorded_previous"))
    return w.where(F.col("previous_status").isNotNull()
                   & ~F.col("recorded_previous").eqNullSafe(F.col("previous_status")))


def illegal_moves(history: DataFrame, allowed: list[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """Moves between different statuses that no rule allows."""
    spark = history.sparkSession
    table = spark.createDataFrame(allowed, "previous_status string, new_status string")
    moves = status_steps(history).where(F.col("previous_status").isNotNull()
                                        & (F.col("previous_status") != F.col("new_status")))
    return moves.join(table, ["previous_status", "new_status"], "left_anti")


def forwarded_with_open_items(history: DataFrame, deficiencies: DataFrame) -> DataFrame:
    """Applications forwarded to scrutiny although a deficiency is open."""
    open_ = deficiencies.where(F.col("status") == "OPEN").select("application_id")
    return history.where(F.col("new_status") == "MINISTRY_SCRUTINY").join(open_, "application_id", "left_semi")


def status_after_review(decision: Column, status: Column) -> Column:
    return first_case([(decision == "VERIFIED", "COLLEGE_REVIEW"),
                       (decision == "CORRECTION_REQUESTED", "CORRECTION_REQUIRED")], status)


def status_after_submit(status: Column) -> Column:
    """New status of a submission, NULL when the status does not allow one."""
    return first_case([(status == "CORRECTION_REQUIRED", "RESUBMITTED"),
                       (status.isin("DRAFT", "RESUBMITTED"), "SUBMITTED")], F.lit(None).cast("string"))


def stage_of(raw: Column) -> Column:
    return F.coalesce(first_case([(raw == k, v) for k, v in STAGE_ALIASES.items()], F.lit(None).cast("string")), raw)


def with_stage_defaults(apps: DataFrame, column: str = "lifecycle_stage") -> DataFrame:
    """Label, owner and next action of the stage; unknown stages keep NULL.

    Fixed values are looked up in the row, as a join would gather the applications of each of a few stages in one task.
    """
    names = ["stage_label", "who_must_act", "next_action"]
    table = F.create_map(*[c for stage, *values in STAGE_DEFAULTS for c in (
        F.lit(stage), F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)]))])
    known = F.element_at(table, F.col("stage"))
    return apps.withColumn("stage", stage_of(F.col(column))).withColumns({n: known[n] for n in names})


def current_state(history: DataFrame) -> DataFrame:
    """Latest status per application."""
    return latest_by(history, ["application_id"], ["changed_at", "history_id"],
                     ["new_status", "changed_at", "history_id"])


def document_versions(documents: DataFrame) -> DataFrame:
    """Version number of every upload and whether a later one replaced it.

    Prior versions stay as rows; each knows the version that followed it.
    """
    rows = numbered(documents, ["application_id", "document_type"],
                    [F.col("processed_at"), F.col("verification_id")], "version")
    last = rows.groupBy("application_id", "document_type").agg(F.max("version").alias("versions"))
    out = rows.join(last, ["application_id", "document_type"])
    return out.withColumn("is_current", F.col("version") == F.col("versions"))


# --- rules --------------------------------------------------------------------------------------

def version_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Same version is replaced, a new version is added; validity ends where the next begins."""
    both = rules.withColumn("_fresh", F.lit(0)).unionByName(changes.withColumn("_fresh", F.lit(1)))
    kept = latest_by(both, ["scheme_id", "rule_version"], ["_fresh", "effective_from"]).drop("_fresh", "effective_to")
    return with_neighbours(kept, ["scheme_id"], [F.col("effective_from"), F.col("rule_version")], {},
                           {"effective_from": "effective_to"})


def rule_at(rules: DataFrame, as_of: str) -> DataFrame:
    """The version of each scheme's rule in force at ``as_of``."""
    day = F.lit(as_of).cast("date")
    live = rules.where((F.col("effective_from") <= day)
                       & (F.col("effective_to").isNull() | (F.col("effective_to") > day)))
    return latest_by(live, ["scheme_id"], ["effective_from", "rule_version"])


# --- alerts -------------------------------------------------------------------------------------

def overdue_applications(apps: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """Cases past the college deadline of their scheme with the days since."""
    late = rules.where(F.col("college_deadline") < as_instant(as_of)).select("scheme_id", "college_deadline")
    days = F.ceil(seconds_between(F.col("college_deadline"), as_instant(as_of)) / F.lit(86_400.0)).cast("long")
    return apps.where(pending_college()).join(late, "scheme_id").withColumn("days_overdue", days)


def delay_alerts(overdue: DataFrame, alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Overdue cases without an alert in the last ``hours``."""
    since = as_instant(as_of) - F.make_dt_interval(hours=F.lit(hours))
    recent = alerts.where(F.col("created_at") >= since).select("application_id")
    return overdue.join(recent, "application_id", "left_anti")


def delay_summary(overdue: DataFrame, created: DataFrame) -> DataFrame:
    new = created.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = overdue.agg(F.count(F.lit(1)).alias("overdue"))
    return out.select("overdue", new.alias("created"), F.greatest(
        F.lit(0).cast("long"), F.col("overdue") - new).alias("suppressed"))


# --- integrity ----------------------------------------------------------------------------------

def payment_violations(payments: DataFrame, apps: DataFrame) -> DataFrame:
    """Confirmed payments without reference, or whose application is not in a paid state."""
    rows = payments.where(F.col("payment_status") == "CONFIRMED").join(
        apps.select("application_id", "application_status"), "application_id", "left")
    return rows.withColumn("violation", first_case([
        (~is_true(F.length(F.trim("payment_reference")) > 0), "missing_reference"),
        (~is_true(F.col("application_status").isin("PAID", "CONTINUATION", "COMPLETED")), "application_not_paid")],
        F.lit(None).cast("string"))).where(F.col("violation").isNotNull())


def duplicate_applications(apps: DataFrame) -> DataFrame:
    """Applications that share student, scheme and year with another one."""
    counted = with_key_count(apps, ["student_id", "scheme_id", "academic_year"], "same_key")
    return counted.where(F.col("same_key") > 1)


def external_events(reports: DataFrame, previous: DataFrame) -> DataFrame:
    """Accepted external statuses as history rows."""
    ok = reports.where(F.col("external_status").isin(EXTERNAL_STATUSES))
    return ok.join(previous.select("application_id", F.col("external_status").alias("_before")),
                   "application_id", "left").select(
        "application_id", F.coalesce("_before", F.lit("UNTRACKED")).alias("previous_status"),
        F.concat(F.lit("EXTERNAL_"), "external_status").alias("new_status"), "changed_at",
        F.coalesce("portal", F.lit("OFFICIAL_GOVT_PORTAL_MANUAL")).alias("source"))


def status_enum_report(apps: DataFrame) -> DataFrame:
    """Rows per status outside the known list (data-quality finding)."""
    known = [s for s, _ in lexicon.STAGES]
    return apps.groupBy("application_status").agg(F.count(F.lit(1)).alias("rows")).where(
        ~F.col("application_status").isin(known))


def quota_report(requests: DataFrame, limit: int, minutes: int = 15) -> DataFrame:
    """Keys that exceed ``limit`` requests in a fixed window."""
    counts = requests.groupBy("key", F.window("at", f"{minutes} minutes").alias("w")).agg(
        count_if(F.lit(True), "requests"))
    return counts.where(F.col("requests") > limit).select(
        "key", F.col("w.start").alias("window_start"), "requests")
