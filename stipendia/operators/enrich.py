"""Wide tables: star enrichment, latest rows, case files, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions.scalars import filled, first_case, is_true
from stipendia.operators.frames import count_if, latest_by
from stipendia.operators.metrics import payments_per_application


def star(apps: DataFrame, students: DataFrame, colleges: DataFrame, rules: DataFrame,
         payments: DataFrame) -> DataFrame:
    """Applications with student, college, scheme and payment columns.

    Payments are summed per application before the join, so the fact keeps one
    row per application.  Colleges and rules are left to the size-based choice
    of the optimizer.
    """
    paid = payments_per_application(payments)
    people = students.drop("college_id", "category")
    places = colleges
    schemes = rules.select("scheme_id", "rule_version", "college_deadline")
    return (apps.join(people, "student_id", "left").join(places, "college_id", "left")
            .join(schemes, "scheme_id", "left").join(paid, "application_id", "left"))


def latest_review(reviews: DataFrame) -> DataFrame:
    return latest_by(reviews, ["application_id"], ["reviewed_at", "line_number", "reviewer_id", "part_number"],
                     ["reviewer_id", "decision", "reviewed_at"])


def latest_ticket(tickets: DataFrame) -> DataFrame:
    return latest_by(tickets, ["student_id"], ["opened_at", "ticket_id"], ["ticket_id", "opened_at"])


def check_counts(verifications: DataFrame) -> DataFrame:
    """Mismatches and all checks per application."""
    return verifications.groupBy("application_id").agg(
        count_if(is_true(F.col("mismatch")), "mismatches"), F.count(F.lit(1)).alias("checks"))


def verification_label(mismatches: Column, checks: Column) -> Column:
    return first_case([(is_true(mismatches > 0), "FLAGGED"), (is_true(checks > 0), "VERIFIED")], "PENDING")


def pending_label(open_items: Column) -> Column:
    n = F.coalesce(open_items, F.lit(0))
    return (F.when(n == 1, "Yes (1 item)").when(n > 1, F.format_string("Yes (%d items)", n)).otherwise("No"))


def admin_table(apps: DataFrame, students: DataFrame, colleges: DataFrame, reviews: DataFrame,
                tickets: DataFrame, verifications: DataFrame, deficiencies: DataFrame) -> DataFrame:
    """One row per application with the latest review and ticket and its check counts.

    What is keyed by student is joined first and what is keyed by application after it, so each key moves the rows once.
    """
    items = deficiencies.groupBy("application_id").agg(count_if(F.col("status") == "OPEN", "open_items"))
    rows = (apps.join(students.select("student_id", "full_name", "course"), "student_id", "left")
            .join(latest_ticket(tickets), "student_id", "left")
            .join(colleges.select("college_id", "college_name"), "college_id", "left")
            .join(latest_review(reviews), "application_id", "left")
            .join(check_counts(verifications), "application_id", "left")
            .join(items, "application_id", "left"))
    return rows.select(
        "application_id", "student_id", "full_name", "course", "college_name", "scheme_id", "application_status",
        "reviewer_id", F.coalesce("decision", F.lit("PENDING")).alias("decision"), "ticket_id",
        F.coalesce("mismatches", F.lit(0)).alias("mismatches"),
        verification_label(F.col("mismatches"), F.col("checks")).alias("verification"),
        pending_label(F.col("open_items")).alias("pending_correction"))


def nested_record(admin: DataFrame) -> DataFrame:
    """The admin row as nested groups."""
    return admin.select(
        "application_id",
        F.struct("student_id", "full_name", "course", "college_name").alias("student"),
        F.struct("application_id", "scheme_id", "application_status", "verification").alias("application"),
        F.struct("reviewer_id", "decision").alias("review"),
        F.struct("ticket_id", "pending_correction", "mismatches").alias("support"))


def case_file(apps: DataFrame, reviews: DataFrame, deficiencies: DataFrame, eligibility: DataFrame,
              history: DataFrame) -> DataFrame:
    """Everything known about each application as dated lines.

    One line per child row instead of arrays, so that an application with very
    many children is never held by one task; readers sort by
    (application_id, section, at).  An application without any child row has one
    line with a null section.
    """
    def lines(df: DataFrame, section: str, at: str, detail: Column) -> DataFrame:
        return df.select("application_id", F.lit(section).alias("section"), F.col(at).alias("at"),
                         detail.alias("detail"))

    newest = latest_by(eligibility, ["application_id"], ["evaluated_at", "result"], ["evaluated_at", "result"])
    child = (lines(newest, "eligibility", "evaluated_at", F.col("result"))
             .unionByName(lines(deficiencies, "deficiency", "created_at",
                                F.concat_ws(" ", "deficiency_type", "severity", "status")))
             .unionByName(lines(reviews, "review", "reviewed_at",
                                F.concat_ws(" ", "decision", F.col("reviewer_id").cast("string"))))
             .unionByName(lines(history, "history", "changed_at", F.col("new_status"))))
    return apps.select("application_id", "application_status").join(child, "application_id", "left")


# --- export projections --------------------------------------------------------------------------

def dash(col: str) -> Column:
    return F.coalesce(filled(F.col(col).cast("string")), F.lit("—")).alias(col)


def application_export(rows: DataFrame) -> DataFrame:
    """Export columns of an application; placeholders appear only here."""
    return rows.select(
        dash("application_id"), dash("full_name"), dash("college_name"), dash("state"), dash("course"),
        dash("department"), "academic_year", dash("scheme_id"), dash("application_status"),
        F.coalesce("document_status", F.lit("PENDING")).alias("document_status"),
        F.coalesce("last_payment_status", F.lit("PENDING")).alias("payment_status"),
        F.coalesce("sanctioned_total", F.lit(0)).cast("double").alias("sanctioned"),
        F.coalesce("paid_total", F.lit(0)).cast("double").alias("paid"))


def required_action(kind: Column) -> Column:
    return first_case([
        (kind == "UNCLEAR_DOCUMENT", "Upload clear and legible copy of document"),
        (kind == "INVALID_INFORMATION", "Contact issuing authority or correct registration information")],
        "Verify and submit corrected document metadata")


def deficiency_export(deficiencies: DataFrame) -> DataFrame:
    """Deficiency rows with the action asked for and the due date 14 days after creation."""
    return deficiencies.select(
        "application_id", F.coalesce("deficiency_type", F.lit("DATA_MISMATCH")).alias("deficiency_type"),
        required_action(F.col("deficiency_type")).alias("action"), F.coalesce("severity", F.lit("HIGH")).alias("severity"),
        F.coalesce("status", F.lit("OPEN")).alias("status"),
        F.date_format(F.date_add(F.col("created_at").cast("date"), 14), "yyyy-MM-dd").alias("due_on"))


def history_export(history: DataFrame) -> DataFrame:
    return history.select("history_id", "application_id", F.coalesce("previous_status", F.lit("NONE")).alias(
        "previous_status"), "new_status", F.date_format("changed_at", "yyyy-MM-dd HH:mm").alias("changed_at"))
