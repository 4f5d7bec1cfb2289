"""Operational dashboards over applications, payments, documents and deficiencies.

Inputs are the entity tables of ``stipendia.schemas``.  Every job takes an
explicit ``as_of`` where time matters and aggregates on the map side first, so
a scheme, college or reviewer that owns most rows does not load one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions import lexicon
from stipendia.functions.scalars import (as_instant, first_case, half_up, half_up_to, is_true, money,
                                         percent, percent1, seconds_between, status_label)
from stipendia.operators.frames import count_if, exact_median, share_of_total

DAY = 86_400


def status_in(*states: str) -> Column:
    return is_true(F.col("application_status").isin(list(states)))


def past_college() -> Column:
    return F.col("college_verified_at").isNotNull() | status_in(*lexicon.PAST_COLLEGE)


def pending_college() -> Column:
    return status_in(*lexicon.PENDING_COLLEGE)


def verified_documents() -> Column:
    return is_true(F.col("document_status") == "VERIFIED")


def total(col: str, name: str, cond: Column | None = None) -> Column:
    value = F.col(col) if cond is None else F.when(cond, F.col(col))
    return F.coalesce(F.sum(value), F.lit(0)).cast("decimal(18,2)").alias(name)


def confirmed() -> Column:
    return is_true(F.col("payment_status") == "CONFIRMED")


def overdue(as_of: str) -> Column:
    return is_true(F.col("college_deadline") < as_instant(as_of))


# --- tiles ---------------------------------------------------------------------------------------

def national_tiles(apps: DataFrame, students: DataFrame, colleges: DataFrame) -> DataFrame:
    """Twelve counts in one pass over each table."""
    people = students.agg(F.count(F.lit(1)).alias("n")).scalar()
    places = colleges.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = apps.agg(
        F.count(F.lit(1)).alias("applications"),
        count_if(status_in("SUBMITTED", "DOCUMENT_VERIFICATION", "COLLEGE_REVIEW"), "pending_review"),
        count_if(status_in("CORRECTION_REQUIRED"), "corrections"),
        count_if(verified_documents(), "documents_verified"),
        count_if(status_in("MINISTRY_SCRUTINY"), "in_scrutiny"),
        count_if(status_in(*lexicon.SELECTED_FAMILY), "selected"),
        count_if(status_in("NOT_SELECTED"), "not_selected"),
        count_if(status_in("AWARD_ACCEPTANCE", "SANCTIONED", "PAID"), "awarded"),
        count_if(status_in("PAID"), "paid"),
        count_if(status_in("CONTINUATION"), "continuation"))
    return counts.select(places.alias("all_colleges"), people.alias("all_students"), *counts.columns)


def college_tiles(apps: DataFrame) -> DataFrame:
    return apps.groupBy("college_id").agg(
        F.count(F.lit(1)).alias("applications"),
        count_if(status_in("DRAFT", "SUBMITTED", "COLLEGE_REVIEW"), "pending"),
        count_if(status_in("CORRECTION_REQUIRED"), "corrections"),
        count_if(verified_documents(), "documents_verified"),
        count_if(status_in("COLLEGE_REVIEW") & verified_documents(), "ready_to_forward"),
        count_if(~status_in("DRAFT"), "submitted"))


def college_counts(colleges: DataFrame, students: DataFrame, apps: DataFrame) -> DataFrame:
    heads = students.groupBy("college_id").agg(F.count(F.lit(1)).alias("students"))
    counts = apps.groupBy("college_id").agg(
        F.count(F.lit(1)).alias("applications"),
        count_if(verified_documents(), "verified"),
        count_if(status_in("DRAFT", "SUBMITTED", "COLLEGE_REVIEW"), "pending"),
        count_if(status_in("CORRECTION_REQUIRED"), "deficient"),
        count_if(status_in("SELECTED", "SANCTIONED", "PAID"), "selected"),
        count_if(status_in("PAID"), "paid"))
    out = (colleges.select("college_id", "college_name", "state").join(heads, "college_id", "left")
           .join(counts, "college_id", "left"))
    return out.fillna(0, ["students", *counts.columns[1:]])


def status_distribution(apps: DataFrame) -> DataFrame:
    counts = apps.groupBy("application_status").agg(F.count(F.lit(1)).alias("applications"))
    return share_of_total(counts, "applications")


# --- payments ------------------------------------------------------------------------------------

def payment_totals(payments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    out = payments.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("records"), count_if(confirmed(), "confirmed_count"),
        count_if(F.col("payment_status") == "PENDING", "pending_count"),
        total("sanctioned", "sanctioned_total"), total("paid", "paid_total", confirmed()))
    return out.withColumn("students_paid_percent", percent1(F.col("confirmed_count"), F.col("records"), 0.0)
                          ).withColumn("amount_paid_percent",
                                       percent1(F.col("paid_total"), F.col("sanctioned_total"), 0.0))


def payments_per_application(payments: DataFrame) -> DataFrame:
    """All instalments of an application in one row, with the state of the latest instalment."""
    latest = F.struct("instalment", "payment_id", "payment_status")
    return payments.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("instalments"), total("sanctioned", "sanctioned_total"),
        total("paid", "paid_total", confirmed()),
        F.max_by("payment_status", latest).alias("last_payment_status"))


def scheme_comparison(apps: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per scheme; payments are scoped by the applications passed in."""
    per_app = payments_per_application(payments)
    out = apps.join(per_app, "application_id", "left").groupBy("scheme_id").agg(
        F.count(F.lit(1)).alias("applications"), count_if(~status_in("DRAFT"), "submitted"),
        count_if(verified_documents(), "verified"),
        count_if(status_in(*lexicon.SELECTED_FAMILY), "selected"),
        count_if(status_in(*lexicon.DECIDED), "decided"),
        total("sanctioned_total", "sanctioned"), total("paid_total", "paid"))
    return (out.withColumn("selection_rate", percent(F.col("selected"), F.col("decided")))
            .withColumn("verification_rate", percent(F.col("verified"), F.col("submitted")))
            .withColumn("paid_rate", percent(F.col("paid"), F.col("sanctioned")))
            .withColumn("average_award", F.when((F.col("selected") > 0) & (F.col("sanctioned") > 0), half_up(
                F.col("sanctioned").cast("double") / F.col("selected"))).otherwise(F.lit(0).cast("long"))))


def student_coverage(payments: DataFrame) -> DataFrame:
    """Distinct approved and paid students per college, through one row per student."""
    per_student = payments.groupBy("college_id", "student_id").agg(F.max(confirmed()).alias("is_paid"))
    out = per_student.groupBy("college_id").agg(
        F.count(F.lit(1)).alias("approved_students"), count_if(F.col("is_paid"), "paid_students"))
    return out.withColumn("coverage_rate", percent(F.col("paid_students"), F.col("approved_students")))


def college_performance(colleges: DataFrame, apps: DataFrame, rules: DataFrame, payments: DataFrame,
                        as_of: str) -> DataFrame:
    """Review completion, deadline-driven overdue cases and payment coverage per college."""
    dated = apps.join(rules.select("scheme_id", "college_deadline"), "scheme_id", "left")
    work = dated.groupBy("college_id").agg(
        F.count(F.lit(1)).alias("applications"), count_if(past_college(), "completed"),
        count_if(pending_college(), "pending"), count_if(pending_college() & overdue(as_of), "overdue"))
    out = (colleges.select("college_id", "college_name", "state").join(work, "college_id", "left")
           .join(student_coverage(payments), "college_id", "left")
           .fillna(0, ["applications", "completed", "pending", "overdue", "approved_students", "paid_students"]))
    return (out.withColumn("completion_rate", percent(F.col("completed"), F.col("completed") + F.col("pending")))
            .withColumn("overdue_rate", percent(F.col("overdue"), F.col("pending"), 0))
            .select("college_id", "college_name", "state", "applications", "completed", "pending",
                    "completion_rate", "overdue", "overdue_rate", "approved_students", "paid_students",
                    "coverage_rate"))


def by_completion(df: DataFrame) -> DataFrame:
    """Rate first, volume for colleges without a rate; a total order."""
    return df.orderBy(F.col("completion_rate").desc_nulls_last(), F.col("applications").desc(), "college_id")


def disbursement_overview(payments: DataFrame) -> DataFrame:
    """Student and institution rows and their total, by grouping sets."""
    kind = F.when(F.col("recipient_type") == "INSTITUTIONAL_FEE", "INSTITUTION").otherwise("STUDENT")
    partial = is_true(F.col("is_partial") | ((F.col("paid") > 0) & (F.col("paid") < F.col("sanctioned"))))
    reversed_ = F.col("payment_status") == "REVERSED"
    out = payments.withColumn("recipient", kind).rollup("recipient").agg(
        total("sanctioned", "sanctioned_total"), total("paid", "confirmed_paid", confirmed()),
        count_if(confirmed(), "transactions"), count_if(reversed_, "reversals"),
        total("paid", "reversed_amount", reversed_), count_if(partial, "partial_count"),
        total("paid", "partial_amount", partial))
    return (out.withColumn("recipient", F.coalesce("recipient", F.lit("TOTAL")))
            .withColumn("coverage_percent", percent(F.col("confirmed_paid"), F.col("sanctioned_total"))))


def budget_utilisation(rules: DataFrame, payments: DataFrame) -> DataFrame:
    spent = payments.groupBy("scheme_id").agg(total("paid", "utilized", confirmed()))
    out = rules.where(F.col("allocated_budget") > 0).join(spent, "scheme_id", "left").fillna(0, ["utilized"])
    left = F.greatest(F.lit(0).cast("decimal(18,2)"), F.col("allocated_budget") - F.col("utilized"))
    return out.select("scheme_id", money(F.col("allocated_budget")).alias("allocated"), "utilized",
                      money(left).alias("remaining"),
                      percent(F.col("utilized"), F.col("allocated_budget")).alias("utilization_rate"),
                      (F.col("utilized") > F.col("allocated_budget")).alias("over_budget"))


# --- time ----------------------------------------------------------------------------------------

def stage_spans(apps: DataFrame) -> DataFrame:
    """Positive durations in seconds, one row per finished stage of an application."""
    decided = F.coalesce("selected_at", "scrutinized_at")
    granted = F.coalesce("sanctioned_at", "selected_at")
    spans = F.map_from_entries(F.array(
        F.struct(F.lit("college_review"), seconds_between(F.col("submitted_at"), F.col("college_verified_at"))),
        F.struct(F.lit("ministry_scrutiny"), seconds_between(F.col("college_verified_at"), decided)),
        F.struct(F.lit("disbursement"), seconds_between(granted, F.col("paid_at")))))
    return apps.select("application_id", F.explode(spans).alias("stage", "seconds")).where(F.col("seconds") > 0)


def stage_durations(apps: DataFrame, exact: bool = True) -> DataFrame:
    """Mean and median hours and days per stage; the median is exact unless asked otherwise."""
    spans = stage_spans(apps)
    means = spans.groupBy("stage").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("seconds").alias("seconds"),
        F.percentile_approx("seconds", 0.5, 10_000).cast("double").alias("approx"))
    out = means.withColumn("median_seconds", F.col("approx"))
    if exact:
        out = means.join(exact_median(spans, ["stage"], "seconds", DAY, "median_seconds"), "stage")
    mean = half_up_to(F.col("seconds") / F.col("samples") / 3600.0, 1)
    median = half_up_to(F.col("median_seconds") / 3600.0, 1)
    return out.select("stage", "samples", mean.alias("mean_hours"), median.alias("median_hours"),
                      half_up_to(mean / 24.0, 1).alias("mean_days"),
                      half_up_to(median / 24.0, 1).alias("median_days"))


def open_case_ages(apps: DataFrame, as_of: str) -> DataFrame:
    """Open cases with their waiting days and bucket, one row per application."""
    days = F.greatest(F.lit(0), F.floor(seconds_between(F.col("submitted_at"), as_instant(as_of)) / F.lit(DAY)))
    bucket = first_case([(F.col("age_days") <= top, name) for name, top in lexicon.AGE_BUCKETS],
                        lexicon.AGE_BUCKET_LAST)
    ids = [c for c in ("application_id", "college_id") if c in apps.columns]
    return (apps.where(pending_college()).withColumn("age_days", days.cast("long"))
            .select(*ids, "age_days").withColumn("bucket", bucket))


def age_buckets(apps: DataFrame, as_of: str) -> DataFrame:
    """Counts per bucket, all four always present; members come from ``open_case_ages``."""
    ages = open_case_ages(apps, as_of)
    counts = ages.groupBy("bucket").agg(F.count(F.lit(1)).alias("cases"), F.sum("age_days").alias("days"))
    names = [n for n, _ in lexicon.AGE_BUCKETS] + [lexicon.AGE_BUCKET_LAST]
    domain = apps.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, bucket string")
    out = domain.join(counts, "bucket", "left").fillna(0, ["cases", "days"])
    return out.select("position", "bucket", "cases",
                      F.when(F.col("cases") > 0, half_up_to(F.col("days") / F.col("cases"), 1)
                             ).alias("average_days"))


def weekly_trend(apps: DataFrame, as_of: str, weeks: int = 8) -> DataFrame:
    """Submissions and completed reviews in trailing 7-day bins that end at ``as_of``."""
    def week_of(col: str) -> Column:
        ago = seconds_between(F.col(col), as_instant(as_of))
        # bins are [start, end): an event exactly one week old opens the newest bin
        index = F.lit(weeks) - F.floor((ago - 1) / F.lit(7 * DAY))
        return F.when((ago > 0) & (ago <= weeks * 7 * DAY), index.cast("int"))

    marks = F.array(F.struct(week_of("submitted_at").alias("week"), F.lit("s").alias("kind")),
                    F.struct(week_of("college_verified_at").alias("week"), F.lit("r").alias("kind")))
    counts = (apps.select(F.inline(marks)).where(F.col("week").isNotNull()).groupBy("week")
              .agg(count_if(F.col("kind") == "s", "submissions"), count_if(F.col("kind") == "r", "reviews")))
    domain = apps.sparkSession.range(1, weeks + 1).select(F.col("id").cast("int").alias("week"))
    return domain.join(counts, "week", "left").fillna(0, ["submissions", "reviews"])


def deadlines(rules: DataFrame, as_of: str, soon_days: int = 15) -> DataFrame:
    left = F.ceil(seconds_between(as_instant(as_of), F.col("college_deadline")) / F.lit(float(DAY)))
    return rules.select("scheme_id", "rule_version", left.cast("long").alias("days_left")).withColumn(
        "state", first_case([(F.col("days_left").isNull(), "Deadline not configured"),
                             (F.col("days_left") < 0, "Overdue"), (F.col("days_left") <= soon_days, "Approaching")],
                            "Normal"))


# --- breakdowns ----------------------------------------------------------------------------------

def cohort_funnel(apps: DataFrame) -> DataFrame:
    """Five steps of the non-draft cohort, with a flag where a step exceeds the one before."""
    cohort = apps.where(~status_in("DRAFT"))
    row = cohort.agg(
        F.count(F.lit(1)).alias("s1"), count_if(past_college(), "s2"),
        count_if(F.col("scrutinized_at").isNotNull() | status_in(*lexicon.PAST_SCRUTINY), "s3"),
        count_if(status_in(*lexicon.PAST_SCRUTINY), "s4"), count_if(status_in("PAID"), "s5"))
    names = ["Submitted", "College verified", "Scrutiny passed", "Selected and sanctioned", "Payment confirmed"]
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("stage"),
                               F.col(f"s{i + 1}").alias("applications"), F.col(f"s{max(i, 1)}").alias("before"),
                               F.col("s1").alias("cohort")) for i, n in enumerate(names)])
    return row.select(F.inline(steps)).select(
        "step", "stage", "applications", percent(F.col("applications"), F.col("cohort"), 0).alias("share"),
        (F.col("applications") <= F.col("before")).alias("monotone"))


def stage_histogram(apps: DataFrame) -> DataFrame:
    """All known stages in order, zero-filled, then statuses outside the list."""
    counts = apps.groupBy("application_status").agg(F.count(F.lit(1)).alias("applications"))
    domain = apps.sparkSession.createDataFrame(
        [(i, k, label) for i, (k, label) in enumerate(lexicon.STAGES)], "position int, stage string, label string")
    known = domain.join(counts, domain.stage == counts.application_status, "left").select(
        "position", "stage", "label", F.coalesce("applications", F.lit(0)).alias("applications"))
    unseen = counts.join(domain, counts.application_status == domain.stage, "left_anti").select(
        F.lit(len(lexicon.STAGES)).alias("position"), F.col("application_status").alias("stage"),
        status_label(F.col("application_status")).alias("label"), "applications")
    submitted = apps.agg(F.count_if(~status_in("DRAFT")).alias("n")).scalar()
    return known.unionByName(unseen).withColumn("share", percent(F.col("applications"), submitted, 0))


def department_breakdown(apps: DataFrame, students: DataFrame) -> DataFrame:
    """Department totals and their courses from one rollup."""
    people = students.select("student_id", F.coalesce("department", F.lit("General / Unassigned")).alias("department"),
                             F.coalesce("course", F.lit("UG / Other")).alias("course"))
    rows = apps.select("student_id").join(people, "student_id", "left").fillna(
        {"department": "General / Unassigned", "course": "UG / Other"})
    cube = rows.rollup("department", "course").agg(F.count(F.lit(1)).alias("applications"),
                                                   F.grouping_id().alias("level")).where(F.col("level") < 2)
    size = apps.agg(F.count(F.lit(1)).alias("n")).scalar()
    return cube.select("department", F.when(F.col("level") == 0, F.col("course")).otherwise("ALL").alias("course"),
                       "applications", percent(F.col("applications"), size, 0).alias("share"))


def reason_pareto(deficiencies: DataFrame, is_rejection: Column) -> DataFrame:
    """Correction reasons and official rejections, each with its share of all rows."""
    counts = deficiencies.groupBy(
        F.when(is_true(is_rejection), "Official Rejection").otherwise("Correction Required").alias("category"),
        F.coalesce("deficiency_type", F.lit("OTHER")).alias("reason")).agg(F.count(F.lit(1)).alias("cases"))
    return share_of_total(counts, "cases").withColumn("label", F.replace("reason", F.lit("_"), F.lit(" ")))


def reviewer_workload(apps: DataFrame, rules: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Load per reviewer; unassigned cases form a pool.

    Ministry form without rules (decided or pending), college form with rules
    (completed, pending, overdue).  The key is coalesced, not joined, so the
    pool only costs one partial row per task.
    """
    reviewer = F.coalesce(F.col("reviewer_id").cast("string"), F.lit("POOL")).alias("reviewer")
    if rules is None:
        return apps.groupBy(reviewer).agg(
            F.count(F.lit(1)).alias("assigned"), count_if(status_in(*lexicon.DECIDED), "completed"),
            count_if(~status_in(*lexicon.DECIDED), "pending"))
    dated = apps.join(rules.select("scheme_id", "college_deadline"), "scheme_id", "left")
    waiting = ~past_college() & pending_college()
    return dated.groupBy(reviewer).agg(
        F.count(F.lit(1)).alias("assigned"), count_if(past_college(), "completed"),
        count_if(waiting, "pending"), count_if(waiting & overdue(as_of), "overdue"))


def continuation_tracking(apps: DataFrame, payments: DataFrame, min_attendance: float = 75) -> DataFrame:
    """Continuation counts from recorded columns only; unknown attendance is not counted as met."""
    renewing = status_in("CONTINUATION")
    follow_up = payments.agg(F.count_if((F.col("instalment") > 1) & confirmed()).alias("n")).scalar()
    out = apps.agg(
        count_if(renewing, "continuation"), count_if(renewing & verified_documents(), "cleared"),
        count_if(renewing & ~verified_documents(), "pending"),
        count_if(renewing & is_true(F.col("open_deficiencies") > 0), "flagged"),
        count_if(renewing & is_true(F.col("attendance") >= min_attendance), "attendance_met"),
        count_if(status_in("AWARD_ACCEPTANCE"), "award_accepted"))
    return out.select("*", follow_up.alias("follow_up_paid"))


def document_quality(documents: DataFrame) -> DataFrame:
    c = F.col("confidence")
    out = documents.agg(
        F.count(F.lit(1)).alias("documents"), count_if(is_true(F.col("verification_status") == "VERIFIED"), "verified"),
        count_if(is_true(c >= 80), "high"), count_if(is_true((c >= 50) & (c < 80)), "moderate"),
        count_if(is_true(c < 50), "low"), count_if(c.isNull(), "unknown"))
    return out.withColumn("verified_rate", percent(F.col("verified"), F.col("documents")))


def open_deficiencies(deficiencies: DataFrame) -> DataFrame:
    return deficiencies.groupBy("application_id").agg(
        count_if(F.col("status") == "OPEN", "open_items"), F.count(F.lit(1)).alias("all_items")).withColumn(
        "may_forward", F.col("open_items") == 0)


def summary_report(apps: DataFrame, payments: DataFrame, colleges: DataFrame, filters: dict | None = None) -> DataFrame:
    """Report row: what was filtered, what was covered, six summary figures."""
    filters = filters or {}
    paid = payments.agg(F.count(F.lit(1)).alias("payments_audited"), total("paid", "paid_amount", confirmed()),
                        total("sanctioned", "sanctioned_amount"))
    places = colleges.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = apps.agg(F.count(F.lit(1)).alias("applications"), count_if(~status_in("DRAFT"), "submitted"),
                      count_if(verified_documents(), "documents_verified"),
                      count_if(status_in("SELECTED", "SANCTIONED", "PAID"), "selected"))
    one = paid.select(F.struct("*").alias("p")).scalar()
    out = counts.select(*[F.lit(str(filters.get(k, "ALL"))).alias(f"filter_{k}")
                          for k in ("scheme_id", "academic_year", "state", "college_id")],
                        places.alias("colleges_represented"), "*", one.alias("_p"))
    return out.select("*", "_p.*").drop("_p")


def export_summary(apps: DataFrame, payments: DataFrame) -> DataFrame:
    """Metric rows of the export: counts with their share, then amounts."""
    states = ["DRAFT", "SUBMITTED", "CORRECTION_REQUIRED", "RESUBMITTED", "COLLEGE_REVIEW", "MINISTRY_SCRUTINY",
              "SELECTED", "AWARD_ACCEPTANCE", "SANCTIONED", "PAID", "NOT_SELECTED"]
    counts = apps.agg(F.count(F.lit(1)).alias("ALL"), *[count_if(status_in(s), s) for s in states],
                      count_if(status_in("SELECTED", "SANCTIONED", "PAID"), "APPROVED"))
    rows = counts.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("metric"), F.col(s).cast("double").alias("value"),
                 percent1(F.col(s), F.col("ALL"), 0.0).alias("percent")) for s in ["ALL", *states, "APPROVED"]])))
    t = payment_totals(payments)
    rest = F.greatest(F.lit(0).cast("decimal(18,2)"), F.col("sanctioned_total") - F.col("paid_total"))
    amounts = t.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value"), p.alias("percent")) for n, v, p in [
            ("SANCTIONED_AMOUNT", F.col("sanctioned_total"), F.lit(None).cast("double")),
            ("PAID_AMOUNT", F.col("paid_total"), F.col("amount_paid_percent")),
            ("OUTSTANDING_AMOUNT", rest, F.lit(None).cast("double")),
            ("PENDING_PAYMENTS", F.col("pending_count"), F.lit(None).cast("double"))]])))
    return rows.unionByName(amounts)


def college_cards(apps: DataFrame, students: DataFrame, payments: DataFrame) -> DataFrame:
    """Card figures per college; the amount comes from payments."""
    people = students.groupBy("college_id").agg(
        F.count(F.lit(1)).alias("registered"), count_if(is_true(F.col("account_status") == "ACTIVE"), "active"))
    work = apps.groupBy("college_id").agg(
        count_if(~status_in("DRAFT"), "submitted"), count_if(past_college(), "completed"),
        count_if(status_in("COLLEGE_REVIEW"), "in_review"), count_if(status_in("CORRECTION_REQUIRED"), "corrections"),
        count_if(status_in("SELECTED", "SANCTIONED", "PAID"), "selected"), count_if(status_in("PAID"), "paid"))
    money_ = payments.groupBy("college_id").agg(total("paid", "confirmed_amount", confirmed()))
    out = (people.join(work, "college_id", "left").join(money_, "college_id", "left").fillna(0))
    base = F.col("submitted")
    return (out.withColumn("invited", F.col("registered") - F.col("active"))
            .withColumn("activation_rate", percent(F.col("active"), F.col("registered"), 0))
            .withColumn("completion_rate", percent(F.col("completed"), base, 0))
            .withColumn("selection_rate", percent(F.col("selected"), base, 0))
            .withColumn("coverage_rate", percent(F.col("paid"), base, 0)))


def rule_status_groups(schemes: DataFrame) -> DataFrame:
    """Schemes per verification state; the scheme table is a bounded catalogue."""
    return schemes.groupBy("rule_status").agg(
        F.count(F.lit(1)).alias("schemes"), F.array_join(F.array_sort(F.collect_list("scheme_id")), ",").alias("scheme_ids"))
