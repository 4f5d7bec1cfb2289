"""Dashboard queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipendia.operators import filters, metrics
from stipendia.operators.frames import page, page_after
from stipendia.plans.mapping import AS_OF
from stipendia.plans.registry import query

PENDING = "('SUBMITTED', 'COLLEGE_REVIEW', 'CORRECTION_REQUIRED')"
PAST = "('MINISTRY_SCRUTINY', 'SELECTED', 'SANCTIONED', 'PAID')"
DECIDED = "('SELECTED', 'SANCTIONED', 'PAID', 'NOT_SELECTED')"
FAMILY = "('SELECTED', 'SANCTIONED', 'PAID', 'AWARD_ACCEPTANCE')"
DONE = f"(college_verified_at IS NOT NULL OR application_status IN {PAST})"


def pct(part: str, whole: str, empty: str = "NULL") -> str:
    return (f"CASE WHEN {whole} > 0 THEN CAST(floor(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0 + 0.5)"
            f" AS BIGINT) ELSE {empty} END")


def pct1(part: str, whole: str) -> str:
    return (f"CASE WHEN {whole} > 0 THEN floor(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0 * 10.0 + 0.5)"
            f" / 10.0 ELSE 0.0 END")


def as_double(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("national_tiles", "AGG-01 SRC-02 FIL-02", f"""
SELECT (SELECT count(*) FROM nation) AS all_colleges, (SELECT count(*) FROM customer) AS all_students,
 count(*) AS applications, count_if(application_status IN ('SUBMITTED', 'COLLEGE_REVIEW')) AS pending_review,
 count_if(application_status = 'CORRECTION_REQUIRED') AS corrections,
 count_if(document_status = 'VERIFIED') AS documents_verified,
 count_if(application_status = 'MINISTRY_SCRUTINY') AS in_scrutiny,
 count_if(application_status IN {FAMILY}) AS selected, count_if(application_status = 'NOT_SELECTED') AS not_selected,
 count_if(application_status IN ('AWARD_ACCEPTANCE', 'SANCTIONED', 'PAID')) AS awarded,
 count_if(application_status = 'PAID') AS paid, count_if(application_status = 'CONTINUATION') AS continuation
FROM apps_raw""")
def _(t):
    return metrics.national_tiles(t.apps_raw, t.students, t.colleges)


@query("college_tiles", "AGG-02 FIL-03", """
SELECT college_id, count(*) AS applications,
 count_if(application_status IN ('DRAFT', 'SUBMITTED', 'COLLEGE_REVIEW')) AS pending,
 count_if(application_status = 'CORRECTION_REQUIRED') AS corrections,
 count_if(document_status = 'VERIFIED') AS documents_verified,
 count_if(application_status = 'COLLEGE_REVIEW' AND document_status = 'VERIFIED') AS ready_to_forward,
 count_if(application_status NOT IN ('DRAFT')) AS submitted FROM apps GROUP BY college_id""")
def _(t):
    return metrics.college_tiles(t.apps)


@query("college_counts", "AGG-03", """
SELECT c.college_id, c.college_name, c.state, coalesce(h.students, 0) AS students,
 coalesce(applications, 0) AS applications, coalesce(verified, 0) AS verified, coalesce(pending, 0) AS pending,
 coalesce(deficient, 0) AS deficient, coalesce(selected, 0) AS selected, coalesce(paid, 0) AS paid
FROM colleges c LEFT JOIN (SELECT college_id, count(*) AS students FROM students GROUP BY 1) h USING (college_id)
LEFT JOIN (SELECT college_id, count(*) AS applications, count_if(document_status = 'VERIFIED') AS verified,
 count_if(application_status IN ('DRAFT', 'SUBMITTED', 'COLLEGE_REVIEW')) AS pending,
 count_if(application_status = 'CORRECTION_REQUIRED') AS deficient,
 count_if(application_status IN ('SELECTED', 'SANCTIONED', 'PAID')) AS selected,
 count_if(application_status = 'PAID') AS paid FROM apps GROUP BY 1) a USING (college_id)""")
def _(t):
    return metrics.college_counts(t.colleges, t.students, t.apps)


@query("status_distribution", "AGG-04 WIN-07", f"""
SELECT application_status, count(*) AS applications,
 {pct("count(*)", "(SELECT count(*) FROM orders)", "0")} AS share FROM apps_raw GROUP BY 1""")
def _(t):
    return metrics.status_distribution(t.apps_raw)


@query("payment_totals", "AGG-05 FIL-01 FIL-04", f"""
SELECT scheme_id, count(*) AS records, count_if(payment_status = 'CONFIRMED') AS confirmed_count,
 count_if(payment_status = 'PENDING') AS pending_count, CAST(sum(sanctioned) AS DOUBLE) AS sanctioned_total,
 CAST(coalesce(sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END), 0) AS DOUBLE) AS paid_total,
 {pct1("count_if(payment_status = 'CONFIRMED')", "count(*)")} AS students_paid_percent,
 {pct1("coalesce(sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END), 0)", "sum(sanctioned)")}
  AS amount_paid_percent
FROM payments WHERE academic_year IN (1998, 1999) AND payment_status IN ('CONFIRMED', 'PENDING', 'REVERSED')
GROUP BY scheme_id""")
def _(t):
    rows = filters.by_params(t.payments, academic_year=[1998, 1999],
                             payment_status=["CONFIRMED", "PENDING", "REVERSED"], college_id=None)
    return as_double(metrics.payment_totals(rows, ["scheme_id"]), "sanctioned_total", "paid_total")


@query("scheme_comparison", "AGG-06 JOI-04", f"""
WITH per_app AS (SELECT application_id, sum(sanctioned) AS s,
  coalesce(sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END), 0) AS p FROM payments_raw GROUP BY 1),
m AS (SELECT scheme_id, count(*) AS applications, count_if(application_status <> 'DRAFT') AS submitted,
  count_if(document_status = 'VERIFIED') AS verified, count_if(application_status IN {FAMILY}) AS selected,
  count_if(application_status IN {DECIDED}) AS decided, coalesce(sum(s), 0) AS sanctioned, coalesce(sum(p), 0) AS paid
  FROM apps_raw LEFT JOIN per_app USING (application_id) GROUP BY scheme_id)
SELECT scheme_id, applications, submitted, verified, selected, decided, CAST(sanctioned AS DOUBLE) AS sanctioned,
 CAST(paid AS DOUBLE) AS paid, {pct("selected", "decided")} AS selection_rate,
 {pct("verified", "submitted")} AS verification_rate, {pct("paid", "sanctioned")} AS paid_rate,
 CASE WHEN selected > 0 AND sanctioned > 0 THEN CAST(floor(CAST(sanctioned AS DOUBLE) / selected + 0.5) AS BIGINT)
  ELSE 0 END AS average_award FROM m""")
def _(t):
    return as_double(metrics.scheme_comparison(t.apps_raw, t.payments_raw), "sanctioned", "paid")


@query("college_performance", "AGG-07 AGG-11 JOI-01 JOI-06 SRT-04", f"""
WITH w AS (SELECT college_id, count(*) AS applications, count_if({DONE}) AS completed,
  count_if(application_status IN {PENDING}) AS pending,
  count_if(application_status IN {PENDING} AND college_deadline < TIMESTAMP '{AS_OF}') AS overdue
  FROM apps_timed LEFT JOIN rules USING (scheme_id) GROUP BY college_id),
p AS (SELECT college_id, count(DISTINCT student_id) AS approved_students,
  count(DISTINCT CASE WHEN payment_status = 'CONFIRMED' THEN student_id END) AS paid_students
  FROM payments GROUP BY college_id),
j AS (SELECT c.college_id, college_name, state, coalesce(applications, 0) AS applications,
  coalesce(completed, 0) AS completed, coalesce(pending, 0) AS pending, coalesce(overdue, 0) AS overdue,
  coalesce(approved_students, 0) AS approved_students, coalesce(paid_students, 0) AS paid_students
  FROM colleges c LEFT JOIN w USING (college_id) LEFT JOIN p USING (college_id))
SELECT college_id, college_name, state, applications, completed, pending,
 {pct("completed", "(completed + pending)")} AS completion_rate, overdue, {pct("overdue", "pending", "0")} AS overdue_rate,
 approved_students, paid_students, {pct("paid_students", "approved_students")} AS coverage_rate FROM j""")
def college_performance(t):
    return metrics.by_completion(
        metrics.college_performance(t.colleges, t.apps_timed, t.rules, t.payments, AS_OF))


def _span(expr: str) -> str:
    return f"date_diff('second', {expr})"


@query("stage_durations", "AGG-08", f"""
WITH s AS (SELECT 'college_review' AS stage, {_span("submitted_at, college_verified_at")} AS sec FROM apps_timed
 UNION ALL SELECT 'ministry_scrutiny', {_span("college_verified_at, coalesce(selected_at, scrutinized_at)")} FROM apps_timed
 UNION ALL SELECT 'disbursement', {_span("coalesce(sanctioned_at, selected_at), paid_at")} FROM apps_timed),
m AS (SELECT stage, count(*) AS samples, floor(sum(sec) / count(*) / 3600.0 * 10.0 + 0.5) / 10.0 AS mean_hours,
 floor(median(sec) / 3600.0 * 10.0 + 0.5) / 10.0 AS median_hours FROM s WHERE sec > 0 GROUP BY stage)
SELECT stage, samples, mean_hours, median_hours, floor(mean_hours / 24.0 * 10.0 + 0.5) / 10.0 AS mean_days,
 floor(median_hours / 24.0 * 10.0 + 0.5) / 10.0 AS median_days FROM m""")
def _(t):
    return metrics.stage_durations(t.apps_timed)


@query("cohort_funnel", "AGG-09", f"""
WITH c AS (SELECT * FROM apps_timed WHERE application_status <> 'DRAFT'),
r AS (SELECT count(*) AS s1, count_if({DONE}) AS s2,
 count_if(scrutinized_at IS NOT NULL OR application_status IN ('SELECTED', 'SANCTIONED', 'PAID')) AS s3,
 count_if(application_status IN ('SELECTED', 'SANCTIONED', 'PAID')) AS s4,
 count_if(application_status = 'PAID') AS s5 FROM c),
u AS (SELECT 1 AS step, 'Submitted' AS stage, s1 AS applications, s1 AS prev, s1 FROM r
 UNION ALL SELECT 2, 'College verified', s2, s1, s1 FROM r UNION ALL SELECT 3, 'Scrutiny passed', s3, s2, s1 FROM r
 UNION ALL SELECT 4, 'Selected and sanctioned', s4, s3, s1 FROM r
 UNION ALL SELECT 5, 'Payment confirmed', s5, s4, s1 FROM r)
SELECT step, stage, applications, {pct("applications", "s1", "0")} AS share, applications <= prev AS monotone FROM u""")
def _(t):
    return metrics.cohort_funnel(t.apps_timed)


_DISB = f"""CAST(sum(sanctioned) AS DOUBLE) AS sanctioned_total,
 CAST(coalesce(sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END), 0) AS DOUBLE) AS confirmed_paid,
 count_if(payment_status = 'CONFIRMED') AS transactions, count_if(payment_status = 'REVERSED') AS reversals,
 CAST(coalesce(sum(CASE WHEN payment_status = 'REVERSED' THEN paid END), 0) AS DOUBLE) AS reversed_amount,
 count_if(is_partial OR (paid > 0 AND paid < sanctioned)) AS partial_count,
 CAST(coalesce(sum(CASE WHEN is_partial OR (paid > 0 AND paid < sanctioned) THEN paid END), 0) AS DOUBLE) AS partial_amount,
 {pct("coalesce(sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END), 0)", "sum(sanctioned)")} AS coverage_percent"""


@query("disbursement_overview", "AGG-10", f"""
SELECT CASE WHEN recipient_type = 'INSTITUTIONAL_FEE' THEN 'INSTITUTION' ELSE 'STUDENT' END AS recipient, {_DISB}
FROM payments_raw GROUP BY 1 UNION ALL SELECT 'TOTAL', {_DISB} FROM payments_raw""")
def _(t):
    return as_double(metrics.disbursement_overview(t.payments_raw), "sanctioned_total", "confirmed_paid",
                     "reversed_amount", "partial_amount")


@query("student_coverage", "AGG-11", f"""
WITH p AS (SELECT college_id, count(DISTINCT student_id) AS approved_students,
 count(DISTINCT CASE WHEN payment_status = 'CONFIRMED' THEN student_id END) AS paid_students FROM payments GROUP BY 1)
SELECT *, {pct("paid_students", "approved_students")} AS coverage_rate FROM p""")
def _(t):
    return metrics.student_coverage(t.payments)


@query("continuation_tracking", "AGG-12", """
SELECT count_if(application_status = 'CONTINUATION') AS continuation,
 count_if(application_status = 'CONTINUATION' AND document_status = 'VERIFIED') AS cleared,
 count_if(application_status = 'CONTINUATION' AND document_status <> 'VERIFIED') AS pending,
 count_if(application_status = 'CONTINUATION' AND coalesce(open_deficiencies, 0) > 0) AS flagged,
 count_if(application_status = 'CONTINUATION' AND attendance >= 92) AS attendance_met,
 count_if(application_status = 'AWARD_ACCEPTANCE') AS award_accepted,
 (SELECT count_if(instalment > 1 AND payment_status = 'CONFIRMED') FROM payments_raw) AS follow_up_paid
FROM apps_timed""")
def _(t):
    return metrics.continuation_tracking(t.apps_timed, t.payments_raw, 92)


@query("ministry_workload", "AGG-13", f"""
SELECT coalesce(CAST(reviewer_id AS VARCHAR), 'POOL') AS reviewer, count(*) AS assigned,
 count_if(application_status IN {DECIDED}) AS completed, count_if(application_status NOT IN {DECIDED}) AS pending
FROM apps_timed GROUP BY 1""")
def _(t):
    return metrics.reviewer_workload(t.apps_timed)


@query("college_workload", "AGG-13 JOI-06", f"""
SELECT coalesce(CAST(reviewer_id AS VARCHAR), 'POOL') AS reviewer, count(*) AS assigned,
 count_if({DONE}) AS completed, count_if(NOT {DONE} AND application_status IN {PENDING}) AS pending,
 count_if(NOT {DONE} AND application_status IN {PENDING} AND college_deadline < TIMESTAMP '{AS_OF}') AS overdue
FROM apps_timed LEFT JOIN rules USING (scheme_id) GROUP BY 1""")
def _(t):
    return metrics.reviewer_workload(t.apps_timed, t.rules, AS_OF)


@query("document_quality", "AGG-14", f"""
SELECT count(*) AS documents, count_if(verification_status = 'VERIFIED') AS verified,
 count_if(confidence >= 80) AS high, count_if(confidence >= 50 AND confidence < 80) AS moderate,
 count_if(confidence < 50) AS low, count_if(confidence IS NULL) AS "unknown",
 {pct("count_if(verification_status = 'VERIFIED')", "count(*)")} AS verified_rate FROM doc_checks""")
def _(t):
    return metrics.document_quality(t.doc_checks)


@query("budget_utilisation", "AGG-15", f"""
WITH s AS (SELECT scheme_id, sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END) AS u FROM payments GROUP BY 1)
SELECT scheme_id, CAST(allocated_budget AS DOUBLE) AS allocated, CAST(coalesce(u, 0) AS DOUBLE) AS utilized,
 CAST(greatest(0, allocated_budget - coalesce(u, 0)) AS DOUBLE) AS remaining,
 {pct("coalesce(u, 0)", "allocated_budget")} AS utilization_rate, coalesce(u, 0) > allocated_budget AS over_budget
FROM rules LEFT JOIN s USING (scheme_id) WHERE allocated_budget > 0""")
def _(t):
    return as_double(metrics.budget_utilisation(t.rules, t.payments), "allocated", "utilized", "remaining")


@query("stage_histogram", "AGG-16 SET-02 PRJ-06", f"""
WITH d AS (SELECT * FROM (VALUES (0, 'DRAFT', 'Draft'), (1, 'SUBMITTED', 'Submitted'),
 (2, 'COLLEGE_REVIEW', 'College Review'), (3, 'CORRECTION_REQUIRED', 'Correction Required'),
 (4, 'MINISTRY_SCRUTINY', 'Ministry Scrutiny'), (5, 'SELECTED', 'Selected'), (6, 'SANCTIONED', 'Sanctioned'),
 (7, 'PAID', 'Paid Confirmed'), (8, 'CONTINUATION', 'Continuation')) AS d(position, stage, label)),
c AS (SELECT application_status AS s, count(*) AS n FROM apps_raw GROUP BY 1),
u AS (SELECT d.position, d.stage, d.label, coalesce(n, 0) AS n FROM d LEFT JOIN c ON d.stage = c.s
 UNION ALL SELECT 9, s, CASE s WHEN 'NOT_SELECTED' THEN 'Not Selected' WHEN 'AWARD_ACCEPTANCE' THEN 'Award Acceptance' END,
 n FROM c WHERE s NOT IN (SELECT stage FROM d))
SELECT position, stage, label, n AS applications,
 {pct("n", "(SELECT count(*) FROM apps_raw WHERE application_status <> 'DRAFT')", "0")} AS share FROM u""")
def _(t):
    return metrics.stage_histogram(t.apps_raw)


@query("department_breakdown", "AGG-17", f"""
WITH r AS (SELECT department, course FROM apps_raw JOIN students USING (student_id))
SELECT department, course, count(*) AS applications, {pct("count(*)", "(SELECT count(*) FROM orders)", "0")} AS share
FROM r GROUP BY 1, 2
UNION ALL SELECT department, 'ALL', count(*), {pct("count(*)", "(SELECT count(*) FROM orders)", "0")} FROM r GROUP BY 1""")
def _(t):
    return metrics.department_breakdown(t.apps_raw, t.students)


@query("reason_pareto", "AGG-18 WIN-07", f"""
SELECT CASE WHEN severity = 'HIGH' AND status = 'OPEN' THEN 'Official Rejection' ELSE 'Correction Required' END AS category,
 deficiency_type AS reason, count(*) AS cases, {pct("count(*)", "(SELECT count(*) FROM deficiencies)", "0")} AS share,
 replace(deficiency_type, '_', ' ') AS label FROM deficiencies GROUP BY 1, 2""")
def _(t):
    rejected = (F.col("severity") == "HIGH") & (F.col("status") == "OPEN")
    return metrics.reason_pareto(t.deficiencies, rejected)


@query("age_buckets", "AGG-19", f"""
WITH o AS (SELECT greatest(0, CAST(floor(date_diff('second', submitted_at, TIMESTAMP '2000-01-10 00:00:00') / 86400.0)
  AS BIGINT)) AS d FROM apps_raw WHERE application_status IN {PENDING}),
b AS (SELECT CASE WHEN d <= 3 THEN '0-3' WHEN d <= 7 THEN '4-7' WHEN d <= 14 THEN '8-14' ELSE '14+' END AS bucket, d FROM o),
n AS (SELECT * FROM (VALUES (0, '0-3'), (1, '4-7'), (2, '8-14'), (3, '14+')) AS v(position, bucket))
SELECT position, n.bucket, count(d) AS cases,
 CASE WHEN count(d) > 0 THEN floor(sum(d) / count(d) * 10.0 + 0.5) / 10.0 END AS average_days
FROM n LEFT JOIN b ON n.bucket = b.bucket GROUP BY 1, 2""")
def _(t):
    return metrics.age_buckets(t.apps_raw, "2000-01-10 00:00:00")


@query("open_case_ages", "AGG-19", f"""
SELECT application_id, college_id, age_days, CASE WHEN age_days <= 3 THEN '0-3' WHEN age_days <= 7 THEN '4-7'
 WHEN age_days <= 14 THEN '8-14' ELSE '14+' END AS bucket FROM (SELECT application_id, college_id,
 CAST(floor(date_diff('second', submitted_at, TIMESTAMP '{AS_OF}') / 86400.0) AS BIGINT) AS age_days
 FROM apps WHERE application_status IN {PENDING})""")
def _(t):
    return metrics.open_case_ages(t.apps, AS_OF)


@query("weekly_trend", "AGG-20", f"""
WITH w AS (SELECT unnest(range(1, 9)) AS week),
b AS (SELECT CAST(week AS INT) AS week, TIMESTAMP '{AS_OF}' - to_days(CAST((9 - week) * 7 AS INT)) AS lo,
 TIMESTAMP '{AS_OF}' - to_days(CAST((8 - week) * 7 AS INT)) AS hi FROM w)
SELECT week, (SELECT count(*) FROM apps_timed WHERE submitted_at >= lo AND submitted_at < hi) AS submissions,
 (SELECT count(*) FROM apps_timed WHERE college_verified_at >= lo AND college_verified_at < hi) AS reviews FROM b""")
def _(t):
    return metrics.weekly_trend(t.apps_timed, AS_OF)


@query("deadlines", "AGG-21", f"""
WITH d AS (SELECT scheme_id, rule_version, count(o.o_orderkey) AS applications,
 CAST(ceil(date_diff('second', TIMESTAMP '{AS_OF}', college_deadline) / 86400.0) AS BIGINT) AS days_left
 FROM rules LEFT JOIN orders o ON o.o_orderpriority = scheme_id GROUP BY scheme_id, rule_version, college_deadline)
SELECT scheme_id, rule_version, days_left, CASE WHEN days_left IS NULL THEN 'Deadline not configured'
 WHEN days_left < 0 THEN 'Overdue' WHEN days_left <= 15 THEN 'Approaching' ELSE 'Normal' END AS state, applications FROM d""")
def _(t):
    counts = t.apps_raw.groupBy("scheme_id").agg(F.count(F.lit(1)).alias("applications"))
    return metrics.deadlines(t.rules, AS_OF).join(counts, "scheme_id", "left").fillna(0, ["applications"])


@query("open_deficiencies", "AGG-22", """
SELECT application_id, count_if(status = 'OPEN') AS open_items, count(*) AS all_items,
 count_if(status = 'OPEN') = 0 AS may_forward FROM deficiencies GROUP BY application_id""")
def _(t):
    return metrics.open_deficiencies(t.deficiencies)


@query("summary_report", "AGG-23 FIL-06 FIL-07", """
WITH a AS (SELECT * FROM apps WHERE college_id IN (SELECT college_id FROM colleges WHERE state = 'ASIA')),
p AS (SELECT * FROM payments WHERE college_id IN (SELECT college_id FROM colleges WHERE state = 'ASIA'))
SELECT 'ALL' AS filter_scheme_id, 'ALL' AS filter_academic_year, 'ASIA' AS filter_state, 'ALL' AS filter_college_id,
 (SELECT count(*) FROM colleges WHERE state = 'ASIA') AS colleges_represented, count(*) AS applications,
 count_if(application_status <> 'DRAFT') AS submitted, count_if(document_status = 'VERIFIED') AS documents_verified,
 count_if(application_status IN ('SELECTED', 'SANCTIONED', 'PAID')) AS selected,
 (SELECT count(*) FROM p) AS payments_audited,
 (SELECT CAST(sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END) AS DOUBLE) FROM p) AS paid_amount,
 (SELECT CAST(sum(sanctioned) AS DOUBLE) FROM p) AS sanctioned_amount FROM a""")
def _(t):
    where = F.col("state") == "ASIA"
    apps = filters.scoped(filters.in_state(t.apps, t.colleges, "ASIA"), "MINISTRY_ADMIN")
    payments = filters.in_state(t.payments, t.colleges, "ASIA")
    return as_double(metrics.summary_report(apps, payments, t.colleges.where(where), {"state": "ASIA"}),
                     "paid_amount", "sanctioned_amount")


_STATES = ["DRAFT", "SUBMITTED", "CORRECTION_REQUIRED", "RESUBMITTED", "COLLEGE_REVIEW", "MINISTRY_SCRUTINY", "SELECTED",
           "AWARD_ACCEPTANCE", "SANCTIONED", "PAID", "NOT_SELECTED"]
_STATE_ROWS = " UNION ALL ".join(
    f"SELECT '{s}' AS metric, count_if(application_status = '{s}') AS v FROM apps_raw" for s in _STATES)


@query("export_summary", "AGG-24 AGG-04 SNK-02", f"""
WITH m AS (SELECT 'ALL' AS metric, count(*) AS v FROM apps_raw UNION ALL {_STATE_ROWS}
 UNION ALL SELECT 'APPROVED', count_if(application_status IN ('SELECTED', 'SANCTIONED', 'PAID')) FROM apps_raw),
p AS (SELECT sum(sanctioned) AS s, sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END) AS d,
 count_if(payment_status = 'PENDING') AS n FROM payments_raw)
SELECT metric, CAST(v AS DOUBLE) AS value, {pct1("v", "(SELECT count(*) FROM orders)")} AS percent FROM m
UNION ALL SELECT 'SANCTIONED_AMOUNT', CAST(s AS DOUBLE), NULL FROM p
UNION ALL SELECT 'PAID_AMOUNT', CAST(d AS DOUBLE), {pct1("d", "s")} FROM p
UNION ALL SELECT 'OUTSTANDING_AMOUNT', CAST(greatest(0, s - d) AS DOUBLE), NULL FROM p
UNION ALL SELECT 'PENDING_PAYMENTS', CAST(n AS DOUBLE), NULL FROM p""")
def _(t):
    return metrics.export_summary(t.apps_raw, t.payments_raw)


@query("college_cards", "AGG-26", f"""
WITH s AS (SELECT college_id, count(*) AS registered, count_if(account_status = 'ACTIVE') AS active FROM students GROUP BY 1),
w AS (SELECT college_id, count_if(application_status <> 'DRAFT') AS submitted, count_if({DONE}) AS completed,
 count_if(application_status = 'COLLEGE_REVIEW') AS in_review, count_if(application_status = 'CORRECTION_REQUIRED') AS corrections,
 count_if(application_status IN ('SELECTED', 'SANCTIONED', 'PAID')) AS selected,
 count_if(application_status = 'PAID') AS paid FROM apps_timed GROUP BY 1),
m AS (SELECT college_id, sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END) AS c FROM payments GROUP BY 1)
SELECT college_id, registered, active, submitted, completed, in_review, corrections, selected, paid,
 CAST(coalesce(c, 0) AS DOUBLE) AS confirmed_amount, registered - active AS invited,
 {pct("active", "registered", "0")} AS activation_rate, {pct("completed", "submitted", "0")} AS completion_rate,
 {pct("selected", "submitted", "0")} AS selection_rate, {pct("paid", "submitted", "0")} AS coverage_rate
FROM s JOIN w USING (college_id) LEFT JOIN m USING (college_id)""")
def _(t):
    return as_double(metrics.college_cards(t.apps_timed, t.students, t.payments), "confirmed_amount")


@query("student_search", "FIL-05 PRJ-01 SRT-01", """
SELECT student_id, full_name, college_id FROM students
WHERE contains(lower(full_name), '00012') OR contains(lower(category), 'build')""")
def _(t):
    return filters.search(t.students, ["full_name", "category"], "00012").unionByName(
        filters.search(t.students, ["category"], "BUILD")).select("student_id", "full_name", "college_id").distinct()


@query("decision_window", "FIL-04 FIL-03", """
SELECT application_id, CAST(selected_at AS DATE) AS selected_on FROM apps_timed
WHERE selected_at >= TIMESTAMP '1998-01-01 00:00:00' AND selected_at <= TIMESTAMP '1998-12-31 00:00:00'
 AND route <> 'EXTERNAL_TRACKING'""")
def _(t):
    from stipendia.functions.scalars import not_equal_or_missing
    rows = filters.in_date_range(t.apps_timed, "decisionDate", "1998-01-01 00:00:00", "1998-12-31 00:00:00")
    return rows.where(not_equal_or_missing(F.col("route"), "EXTERNAL_TRACKING")).select(
        "application_id", F.col("selected_at").cast("date").alias("selected_on"))


@query("recent_applications", "SRT-02 SRT-01", """
SELECT application_id, scheme_id, CAST(submitted_at AS DATE) AS submitted_on FROM apps_raw
ORDER BY submitted_at DESC, application_id DESC LIMIT 50""")
def _(t):
    return t.apps_raw.orderBy(F.col("submitted_at").desc(), F.col("application_id").desc()).limit(50).select(
        "application_id", "scheme_id", F.col("submitted_at").cast("date").alias("submitted_on"))


@query("application_page", "SRT-03", """
WITH f AS (SELECT application_id, application_status FROM apps_raw WHERE application_status = 'PAID')
SELECT application_id, application_status, (SELECT count(*) FROM f) AS total,
 CAST(ceil((SELECT count(*) FROM f) / 25.0) AS BIGINT) AS pages FROM f ORDER BY application_id DESC LIMIT 25 OFFSET 50""")
def _(t):
    rows = filters.by_params(t.apps_raw, application_status="PAID").select("application_id", "application_status")
    return page(rows, [F.col("application_id").desc()], 3, 25, key=-F.col("application_id"))


@query("deep_page", "SRT-03", """
WITH f AS (SELECT payment_id, instalment, paid FROM payments_raw), n AS (SELECT count(*) AS total FROM f)
SELECT payment_id, instalment, CAST(paid AS DOUBLE) AS paid, total, CAST(ceil(total / 100.0) AS BIGINT) AS pages
FROM (SELECT *, row_number() OVER (ORDER BY payment_id, instalment) AS rn FROM f), n
WHERE rn > (CAST(floor(total / 200.0) AS BIGINT) - 1) * 100 AND rn <= CAST(floor(total / 200.0) AS BIGINT) * 100""")
def _(t):
    """The page in the middle of all payments."""
    rows = t.payments_raw.select("payment_id", "instalment", F.col("paid").cast("double").alias("paid"))
    middle = rows.agg(F.floor(F.count(F.lit(1)) / 200).alias("n")).scalar()
    return page(rows, [F.col("payment_id"), F.col("instalment")], middle, 100, key=F.col("payment_id"))


@query("keyset_page", "SRT-03", """
SELECT application_id, scheme_id FROM apps_raw WHERE application_id > 500 ORDER BY application_id LIMIT 40""")
def _(t):
    return page_after(t.apps_raw.select("application_id", "scheme_id"), "application_id", 500, 40)


@query("colleges_with_decisions", "SRC-03 SET-01 JOI-02 FIL-08", """
SELECT college_id, college_name FROM colleges WHERE college_id IN (SELECT college_id FROM students WHERE student_id IN
 (SELECT student_id FROM apps_raw WHERE application_status = 'AWARD_ACCEPTANCE'))""")
def _(t):
    awarded = filters.members(t.students, filters.by_params(t.apps_raw, application_status="AWARD_ACCEPTANCE")
                              .select("student_id").distinct(), "student_id")
    return filters.members(t.colleges, awarded.select("college_id").distinct(), "college_id").select(
        "college_id", "college_name").orderBy("college_name")
