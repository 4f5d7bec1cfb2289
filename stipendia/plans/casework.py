"""Case-level queries: enrichment, histories, matching, selection, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipendia.functions.scalars import as_instant
from stipendia.operators import eligibility, enrich, intake, lifecycle
from stipendia.operators.frames import upsert
from stipendia.plans.dashboards import PENDING, pct
from stipendia.plans.mapping import AS_OF
from stipendia.plans.registry import query

_PAID = """per_app AS (SELECT application_id, count(*) AS instalments, sum(sanctioned) AS s,
 coalesce(sum(CASE WHEN payment_status = 'CONFIRMED' THEN paid END), 0) AS p,
 arg_max(payment_status, (instalment, payment_id, payment_status)) AS last_payment_status FROM payments_raw GROUP BY 1)"""


@query("application_export", "JOI-01 JOI-04 PRJ-02 SNK-02 AGG-05", f"""
WITH {_PAID}
SELECT CAST(a.application_id AS VARCHAR) AS application_id, full_name, college_name, c.state, course, department,
 academic_year, a.scheme_id, application_status, document_status,
 coalesce(last_payment_status, 'PENDING') AS payment_status, CAST(coalesce(s, 0) AS DOUBLE) AS sanctioned,
 CAST(coalesce(p, 0) AS DOUBLE) AS paid
FROM apps a LEFT JOIN students t USING (student_id) LEFT JOIN colleges c ON a.college_id = c.college_id
LEFT JOIN per_app p ON a.application_id = p.application_id""")
def _(t):
    return enrich.application_export(enrich.star(t.apps, t.students, t.colleges, t.rules, t.payments_raw))


@query("latest_review", "JOI-03 WIN-02", """
SELECT application_id, reviewer_id, decision, CAST(reviewed_at AS DATE) AS reviewed_on FROM (SELECT *,
 row_number() OVER (PARTITION BY application_id ORDER BY reviewed_at DESC, line_number DESC, reviewer_id DESC,
 part_number DESC) AS rn FROM reviews) WHERE rn = 1""")
def _(t):
    return enrich.latest_review(t.reviews).withColumn("reviewed_on", F.col("reviewed_at").cast("date")).drop("reviewed_at")


@query("admin_table", "JOI-01 JOI-03 JOI-05 PRJ-03 PRJ-05 SNK-01", """
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY reviewed_at DESC,
 line_number DESC, reviewer_id DESC, part_number DESC) AS rn FROM reviews) WHERE rn = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY opened_at DESC, ticket_id DESC) AS rn
 FROM tickets) WHERE rn = 1),
v AS (SELECT application_id, count_if(mismatch) AS m, count(*) AS n FROM uploads GROUP BY 1),
d AS (SELECT application_id, count_if(status = 'OPEN') AS o FROM deficiencies GROUP BY 1)
SELECT a.application_id, a.student_id, full_name, course, college_name, a.scheme_id, application_status,
 r.reviewer_id, coalesce(decision, 'PENDING') AS decision, ticket_id, coalesce(m, 0) AS mismatches,
 CASE WHEN m > 0 THEN 'FLAGGED' WHEN n > 0 THEN 'VERIFIED' ELSE 'PENDING' END AS verification,
 CASE WHEN coalesce(o, 0) = 0 THEN 'No' WHEN o = 1 THEN 'Yes (1 item)' ELSE 'Yes (' || o || ' items)' END
  AS pending_correction
FROM apps a LEFT JOIN students s ON a.student_id = s.student_id LEFT JOIN colleges c ON a.college_id = c.college_id
LEFT JOIN r ON a.application_id = r.application_id LEFT JOIN k ON a.student_id = k.student_id
LEFT JOIN v ON a.application_id = v.application_id LEFT JOIN d ON a.application_id = d.application_id""")
def _(t):
    return enrich.admin_table(t.apps, t.students, t.colleges, t.reviews, t.tickets, t.uploads, t.deficiencies)


@query("nested_record", "PRJ-03", """
WITH k AS (SELECT student_id, max_by(ticket_id, opened_at) AS ticket_id FROM tickets GROUP BY 1)
SELECT application_id, full_name, scheme_id, ticket_id FROM apps a LEFT JOIN students s USING (student_id)
LEFT JOIN k USING (student_id)""")
def _(t):
    rows = enrich.admin_table(t.apps, t.students, t.colleges, t.reviews, t.tickets, t.uploads, t.deficiencies)
    return enrich.nested_record(rows).select(
        "application_id", "student.full_name", "application.scheme_id", "support.ticket_id")


@query("case_file", "JOI-19 JOI-03", """
WITH c AS (SELECT application_id, 'eligibility' AS section, submitted_at AS moment, document_status AS detail FROM apps_raw
 UNION ALL SELECT application_id, 'deficiency', created_at, deficiency_type || ' ' || severity || ' ' || status FROM deficiencies
 UNION ALL SELECT application_id, 'review', reviewed_at, decision || ' ' || reviewer_id FROM reviews
 UNION ALL SELECT application_id, 'history', changed_at, new_status FROM history)
SELECT application_id, application_status, section, CAST(moment AS DATE) AS on_day, detail
FROM apps_raw LEFT JOIN c USING (application_id)""")
def _(t):
    results = t.apps_raw.select("application_id", F.col("submitted_at").alias("evaluated_at"),
                                F.col("document_status").alias("result"))
    return enrich.case_file(t.apps_raw, t.reviews, t.deficiencies, results, t.history).withColumn(
        "on_day", F.col("at").cast("date")).drop("at")


@query("deficiency_export", "PRJ-04 SNK-02", """
SELECT application_id, deficiency_type, CASE deficiency_type
 WHEN 'UNCLEAR_DOCUMENT' THEN 'Upload clear and legible copy of document'
 WHEN 'INVALID_INFORMATION' THEN 'Contact issuing authority or correct registration information'
 ELSE 'Verify and submit corrected document metadata' END AS action, severity, status,
 strftime(CAST(created_at AS DATE) + 14, '%Y-%m-%d') AS due_on FROM deficiencies""")
def _(t):
    return enrich.deficiency_export(t.deficiencies)


# --- history -------------------------------------------------------------------------------------

@query("status_steps", "WIN-06", """
SELECT history_id, application_id, new_status,
 lag(new_status) OVER w AS previous_status,
 date_diff('second', changed_at, lead(changed_at) OVER w) AS dwell_seconds
FROM history WINDOW w AS (PARTITION BY application_id ORDER BY changed_at, history_id)""")
def _(t):
    return lifecycle.status_steps(t.history).select(
        "history_id", "application_id", "new_status", "previous_status", "dwell_seconds")


_MOVES = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "error")]


@query("illegal_moves", "RUL-22 WIN-06", """
WITH s AS (SELECT history_id, application_id, new_status, lag(new_status) OVER (PARTITION BY application_id
 ORDER BY changed_at, history_id) AS previous_status FROM history)
SELECT history_id, application_id, previous_status, new_status FROM s WHERE previous_status IS NOT NULL
 AND previous_status <> new_status AND previous_status || '>' || new_status NOT IN
 ('signup>view', 'view>click', 'click>purchase', 'purchase>view', 'view>error')""")
def _(t):
    return lifecycle.illegal_moves(t.history, _MOVES).select(
        "history_id", "application_id", "previous_status", "new_status")


@query("forwarded_with_open_items", "RUL-22 AGG-22", """
SELECT application_id, application_status AS new_status FROM apps_raw WHERE application_status = 'MINISTRY_SCRUTINY'
 AND application_id IN (SELECT application_id FROM deficiencies WHERE status = 'OPEN')""")
def _(t):
    moves = t.apps_raw.select("application_id", F.col("application_status").alias("new_status"))
    return lifecycle.forwarded_with_open_items(moves, t.deficiencies)


@query("current_state", "STR-03 SNK-04 WIN-02", """
SELECT application_id, new_status, history_id FROM (SELECT *, row_number() OVER (PARTITION BY application_id
 ORDER BY changed_at DESC, history_id DESC) AS rn FROM history) WHERE rn = 1""")
def _(t):
    return lifecycle.current_state(t.history).drop("changed_at")


@query("state_upsert", "SNK-04", """
WITH n AS (SELECT * FROM history WHERE changed_at >= TIMESTAMP '2024-01-20 00:00:00'),
o AS (SELECT * FROM history WHERE changed_at < TIMESTAMP '2024-01-20 00:00:00'),
f AS (SELECT application_id, max_by(new_status, changed_at) AS s, max(changed_at) AS c FROM n GROUP BY 1),
g AS (SELECT application_id, max_by(new_status, changed_at) AS s, max(changed_at) AS c FROM o GROUP BY 1)
SELECT coalesce(f.application_id, g.application_id) AS application_id, coalesce(f.s, g.s) AS new_status
FROM f FULL JOIN g USING (application_id)""")
def _(t):
    cut = as_instant("2024-01-20 00:00:00")
    old = lifecycle.current_state(t.history.where(F.col("changed_at") < cut))
    new = lifecycle.current_state(t.history.where(F.col("changed_at") >= cut))
    return upsert(old, new, ["application_id"], "changed_at").select("application_id", "new_status")


@query("document_versions", "WIN-05", """
SELECT application_id, document_type, verification_id, row_number() OVER (PARTITION BY application_id, document_type
 ORDER BY processed_at, verification_id) AS version, count(*) OVER (PARTITION BY application_id, document_type) AS n
FROM uploads""".replace("count(*)", "CAST(count(*)").replace("document_type) AS n", "document_type) AS INT) AS versions"))
def _(t):
    return lifecycle.document_versions(t.uploads).select(
        "application_id", "document_type", "verification_id", F.col("version").cast("long").alias("version"),
        F.col("versions").cast("int").alias("versions"))


@query("stage_defaults", "RUL-23 RUL-22", """
WITH s AS (SELECT application_id, CASE application_status WHEN 'SUBMITTED' THEN 'COLLEGE_REVIEW'
 WHEN 'SELECTED' THEN 'SELECTION' ELSE application_status END AS stage FROM apps_raw)
SELECT stage, count(*) AS applications, CASE stage WHEN 'DRAFT' THEN 'Student'
 WHEN 'COLLEGE_REVIEW' THEN 'College Verification Officer'
 WHEN 'CORRECTION_REQUIRED' THEN 'Student (Resolve Document Issues)'
 WHEN 'MINISTRY_SCRUTINY' THEN 'Ministry Scrutiny Committee' WHEN 'SELECTION' THEN 'Selection Committee'
 WHEN 'SANCTIONED' THEN 'Sanctioning Authority' WHEN 'PAID' THEN 'PFMS / Bank DBT Cell' END AS who_must_act
FROM s GROUP BY stage""")
def _(t):
    raw = F.when(F.col("application_status") == "SUBMITTED", "IN_PROCESS").when(
        F.col("application_status") == "SELECTED", "SELECTION").otherwise(F.col("application_status"))
    rows = lifecycle.with_stage_defaults(t.apps_raw.withColumn("lifecycle_stage", raw))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("applications"), F.max("who_must_act").alias("who_must_act"))


@query("duplicate_applications", "RUL-32 WIN-04", """
SELECT application_id, student_id, scheme_id, academic_year, same_key FROM (SELECT *, count(*) OVER
 (PARTITION BY student_id, scheme_id, academic_year) AS same_key FROM apps_raw) WHERE same_key > 1""")
def _(t):
    return lifecycle.duplicate_applications(t.apps_raw).select(
        "application_id", "student_id", "scheme_id", "academic_year", "same_key")


# --- alerts and integrity ------------------------------------------------------------------------

_ALERTS = "SELECT application_id, max(created_at) AS created_at FROM deficiencies GROUP BY 1"
_OVERDUE = f"""late AS (SELECT application_id, a.scheme_id, CAST(ceil(date_diff('second', college_deadline,
 TIMESTAMP '{AS_OF}') / 86400.0) AS BIGINT) AS days_overdue FROM apps_raw a JOIN rules USING (scheme_id)
 WHERE application_status IN {PENDING} AND college_deadline < TIMESTAMP '{AS_OF}'),
fresh AS (SELECT * FROM late WHERE application_id NOT IN (SELECT application_id FROM deficiencies
 WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR))"""


def _delays(t):
    overdue = lifecycle.overdue_applications(t.apps_raw, t.rules, AS_OF)
    return overdue, lifecycle.delay_alerts(overdue, t.deficiencies, AS_OF)


@query("delay_alerts", "JOI-07 JOI-08 RUL-21", f"WITH {_OVERDUE} SELECT application_id, scheme_id, days_overdue FROM fresh")
def _(t):
    return _delays(t)[1].select("application_id", "scheme_id", "days_overdue")


@query("delay_summary", "RUL-21", f"""
WITH {_OVERDUE} SELECT (SELECT count(*) FROM late) AS overdue, (SELECT count(*) FROM fresh) AS created,
 (SELECT count(*) FROM late) - (SELECT count(*) FROM fresh) AS suppressed""")
def _(t):
    overdue, fresh = _delays(t)
    return lifecycle.delay_summary(overdue, fresh)


@query("payment_violations", "RUL-24", """
SELECT p.payment_id, p.application_id, CASE WHEN p.officer_id < 5 THEN 'missing_reference' ELSE 'application_not_paid' END
 AS violation FROM payments_raw p JOIN apps_raw a USING (application_id) WHERE payment_status = 'CONFIRMED'
 AND (p.officer_id < 5 OR application_status NOT IN ('PAID', 'CONTINUATION', 'COMPLETED'))""")
def _(t):
    paid = t.payments_raw.withColumn("payment_reference", F.when(
        F.col("officer_id") >= 5, F.concat(F.lit("UTR"), F.col("payment_id").cast("string"))))
    return lifecycle.payment_violations(paid, t.apps_raw).select("payment_id", "application_id", "violation")


@query("external_events", "RUL-30 SNK-05", """
SELECT application_id, CASE WHEN route = 'EXTERNAL_TRACKING' THEN 'SUBMITTED' ELSE 'UNTRACKED' END AS previous_status,
 'EXTERNAL_' || application_status AS new_status FROM apps_raw
WHERE application_status IN ('SUBMITTED', 'SELECTED', 'SANCTIONED')""")
def _(t):
    reports = t.apps_raw.select("application_id", F.col("application_status").alias("external_status"),
                                F.col("submitted_at").alias("changed_at"), F.lit(None).cast("string").alias("portal"))
    before = t.apps_raw.where(F.col("route") == "EXTERNAL_TRACKING").select(
        "application_id", F.lit("SUBMITTED").alias("external_status"))
    return lifecycle.external_events(reports, before).select("application_id", "previous_status", "new_status")


@query("quota_report", "STR-04", """
SELECT "key", CAST(w AS TIMESTAMP) AS window_start, n AS requests FROM (SELECT application_id % 10 AS "key",
 time_bucket(INTERVAL 15 MINUTE, changed_at) AS w, count(*) AS n FROM history GROUP BY 1, 2) WHERE n > 2""")
def _(t):
    requests = t.history.select((F.col("application_id") % 10).alias("key"), F.col("changed_at").alias("at"))
    return lifecycle.quota_report(requests, 2)


@query("rule_versions", "RUL-25 WIN-06", """
SELECT scheme_id, rule_version, CAST(effective_from AS VARCHAR) AS effective_from,
 CAST(lead(effective_from) OVER (PARTITION BY scheme_id ORDER BY effective_from, rule_version) AS VARCHAR) AS effective_to,
 (SELECT count(*) FROM orders WHERE o_orderpriority = scheme_id) AS applications
FROM (SELECT scheme_id, rule_version, effective_from FROM rules WHERE scheme_id <> '5-LOW'
 UNION ALL SELECT scheme_id, '2002.1', DATE '2000-07-01' FROM rules WHERE max_income > 5000
 UNION ALL SELECT scheme_id, rule_version, DATE '1997-06-01' FROM rules WHERE scheme_id = '5-LOW')""")
def _(t):
    new = t.rules.where("max_income > 5000").withColumns(
        {"rule_version": F.lit("2002.1"), "effective_from": F.lit("2000-07-01").cast("date")})
    same = t.rules.where("scheme_id = '5-LOW'").withColumn("effective_from", F.lit("1997-06-01").cast("date"))
    uses = t.apps_raw.groupBy("scheme_id").agg(F.count(F.lit(1)).alias("applications"))
    return lifecycle.version_rules(t.rules, new.unionByName(same)).join(uses, "scheme_id").select(
        "scheme_id", "rule_version", F.col("effective_from").cast("string").alias("effective_from"),
        F.col("effective_to").cast("string").alias("effective_to"), "applications")


@query("rule_at_date", "RUL-25 JOI-06", """
WITH v AS (SELECT scheme_id, rule_version, effective_from FROM rules
 UNION ALL SELECT scheme_id, '2002.1', DATE '2000-07-01' FROM rules WHERE max_income > 5000),
l AS (SELECT *, row_number() OVER (PARTITION BY scheme_id ORDER BY effective_from DESC, rule_version DESC) AS rn
 FROM v WHERE effective_from <= DATE '2001-08-02')
SELECT a.application_id, l.rule_version FROM apps_raw a JOIN l USING (scheme_id) WHERE rn = 1""")
def _(t):
    new = t.rules.where("max_income > 5000").withColumns(
        {"rule_version": F.lit("2002.1"), "effective_from": F.lit("2000-07-01").cast("date")})
    live = lifecycle.rule_at(lifecycle.version_rules(t.rules, new), AS_OF).select("scheme_id", "rule_version")
    return t.apps_raw.join(live, "scheme_id").select("application_id", "rule_version")


# --- eligibility ---------------------------------------------------------------------------------

_MATCH = """x AS (SELECT p.*, s.scheme_id, s.gender AS sg, s.income_limit AS sl, s.category AS sc, s.state AS ss,
 s.district AS sd, s.course AS sk, s.requires_disability AS rd, s.requires_govt_school AS rg, s.requires_agri_labor AS ra,
 s.requires_armed_forces AS rf, s.requires_first_graduate AS r1, s.requires_govt_quota AS rq, s.potential_if_disabled AS pd,
 coalesce(p.agri_labor, CASE WHEN p.parent_occupation IS NOT NULL THEN true END) AS al,
 lower(coalesce(p.quota_type, 'unknown')) AS qt FROM profiles p CROSS JOIN schemes s),
c AS (SELECT *, [
 CASE WHEN sg <> 'All' THEN CASE WHEN gender IS NULL OR gender = 'All' THEN 2 WHEN gender <> sg THEN 1 ELSE 0 END END,
 CASE WHEN sl = 99999999 THEN 0 WHEN income IS NULL THEN 2 WHEN income > sl THEN 1 ELSE 0 END,
 CASE WHEN sc <> 'All' THEN CASE WHEN category IS NULL THEN 2 WHEN upper(sc) = upper(category)
   OR (sc = 'BC' AND category IN ('MBC', 'DNC')) OR (sc = 'OBC' AND category IN ('BC', 'MBC')) THEN 0 ELSE 1 END END,
 CASE WHEN ss IN ('All', 'All-India', 'All-India / National') THEN 0 WHEN state IS NULL THEN 2 WHEN state <> ss THEN 1 ELSE 0 END,
 CASE WHEN sd <> 'All' THEN CASE WHEN district IS NULL THEN 2 WHEN district <> sd THEN 1 ELSE 0 END END,
 CASE WHEN sk <> 'All' THEN CASE WHEN course IS NULL OR course = 'All' THEN 2 WHEN course <> sk THEN 1 ELSE 0 END END,
 CASE WHEN rd = 1 THEN CASE WHEN disabled IS NULL THEN 2 WHEN NOT disabled THEN 1 ELSE 0 END END,
 CASE WHEN rg = 1 THEN CASE WHEN govt_school IS NULL THEN 2 WHEN NOT govt_school THEN 1 ELSE 0 END END,
 CASE WHEN ra = 1 THEN CASE WHEN al IS NULL THEN 2 WHEN NOT al THEN 1 ELSE 0 END END,
 CASE WHEN rf = 1 THEN CASE WHEN armed_forces IS NULL THEN 2 WHEN NOT armed_forces THEN 1 ELSE 0 END END,
 CASE WHEN r1 = 1 THEN CASE WHEN first_graduate IS NULL THEN 2 WHEN NOT first_graduate THEN 1 ELSE 0 END END,
 CASE WHEN rq = 1 AND category IN ('BC', 'MBC', 'DNC', 'DNT') THEN CASE qt WHEN 'unknown' THEN 2 WHEN 'management' THEN 1
   ELSE 0 END END] AS v FROM x),
n AS (SELECT *, CAST(len(list_filter(v, lambda e: e = 1)) AS INT) AS failed,
 CAST(len(list_filter(v, lambda e: e = 2)) AS INT) AS missing FROM c),
m AS (SELECT *, CASE WHEN failed > 0 THEN 'NOT MATCHED' WHEN missing > 0 THEN CASE WHEN pd = 1 AND disabled
  AND (course IS NULL OR course IN ('Engineering', 'Diploma')) THEN 'POTENTIAL MATCH' ELSE 'NEEDS MORE INFORMATION' END
  ELSE 'CONFIRMED MATCH' END AS match_type FROM n),
matches AS (SELECT student_id, scheme_id, match_type, failed, missing, match_type = 'CONFIRMED MATCH' AS eligible,
 CASE match_type WHEN 'POTENTIAL MATCH' THEN 55 WHEN 'CONFIRMED MATCH' THEN least(100, 70
  + CASE WHEN sc <> 'All' AND upper(sc) = upper(category) THEN 10 ELSE 0 END
  + CASE WHEN sk <> 'All' AND lower(sk) = lower(course) THEN 10 ELSE 0 END
  + CASE WHEN sd <> 'All' AND lower(sd) = lower(district) THEN 5 ELSE 0 END
  + CASE WHEN income > 0 AND sl <> 99999999 AND CAST(income AS DOUBLE) / sl < 0.6 THEN 5 ELSE 0 END) ELSE 0 END AS score
 FROM m)"""


def _matches(t):
    return eligibility.open_matches(t.profiles, t.schemes)


@query("scheme_matches", "JOI-09 RUL-01 RUL-02 RUL-03 RUL-04 SRC-07",
       f"WITH {_MATCH} SELECT student_id, scheme_id, match_type, score, eligible, failed, missing FROM matches")
def _(t):
    return eligibility.match_all(t.profiles, t.schemes).drop("criteria")


@query("pair_outcomes", "JOI-09 RUL-02",
       f"WITH {_MATCH} SELECT student_id, scheme_id, match_type, score, eligible, failed, missing FROM matches")
def _(t):
    return eligibility.match_all(t.profiles, t.schemes).drop("criteria")


@query("criteria_outcomes", "RUL-01", f"""
WITH {_MATCH}, k AS (SELECT *, unnest(['gender', 'income', 'category', 'state', 'district', 'course', 'disability',
 'government_school', 'parent_occupation', 'armed_forces', 'first_graduate', 'admission_quota']) AS criterion,
 unnest(v) AS code FROM m)
SELECT scheme_id, criterion, CASE code WHEN 0 THEN 'PASSED' WHEN 1 THEN 'FAILED' ELSE 'NEEDS_INFO' END AS status,
 count(*) AS students FROM k WHERE code IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    rows = eligibility.match_all(t.profiles, t.schemes).select("scheme_id", F.inline_outer("criteria")).where(
        F.col("criterion").isNotNull())
    return rows.groupBy("scheme_id", "criterion", "status").agg(
        F.count(F.lit(1)).alias("students"))


@query("best_schemes", "WIN-03 RUL-03", f"""
WITH {_MATCH} SELECT student_id, scheme_id, score, "rank" FROM (SELECT *, CAST(row_number() OVER (PARTITION BY student_id
 ORDER BY score DESC, scheme_id) AS INT) AS "rank" FROM matches WHERE match_type = 'CONFIRMED MATCH') WHERE "rank" <= 4""")
def _(t):
    return eligibility.ranked_schemes(_matches(t), 4, [eligibility.CONFIRMED]).select(
        "student_id", "scheme_id", "score", "rank")


@query("match_groups", "AGG-27", f"""
WITH {_MATCH} SELECT scheme_id, CASE WHEN match_type IN ('CONFIRMED MATCH', 'POTENTIAL MATCH') THEN 'confirmed_or_potential'
 WHEN match_type = 'NEEDS MORE INFORMATION' THEN 'needs_information' ELSE 'not_matched' END AS match_group,
 count(*) AS pairs FROM matches GROUP BY 1, 2""")
def _(t):
    return eligibility.match_groups(_matches(t), t.profiles, t.schemes)


_SIMPLE = [("pms-sc", ["SC"], 250000, ["ug", "pg", "diploma"], None),
           ("pms-bc", ["BC", "MBC"], 200000, ["ug"], None),
           ("minority", ["MIN"], 300000, ["ug", "pg"], None),
           ("wards", ["SC", "BC", "MBC", "GENERAL", "MUSLIM"], 450000, ["ug", "pg", "diploma"], "armed_forces")]
_APPLICANT = ["c_custkey AS applicant_id", "CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal * 50) AS BIGINT) END AS income",
              "CASE c_mktsegment WHEN 'BUILDING' THEN ' bc ' WHEN 'AUTOMOBILE' THEN 'sc' WHEN 'MACHINERY' THEN 'mbc'"
              " WHEN 'HOUSEHOLD' THEN 'Muslim' ELSE 'General' END AS community",
              "CASE WHEN c_acctbal < 3000 THEN 'UG' WHEN c_acctbal < 6000 THEN 'pg' WHEN c_acctbal < 8000 THEN '' ELSE 'phd' END"
              " AS course", "c_acctbal > 5000 AS armed_forces"]
_SIMPLE_ROWS = ", ".join(
    f"('{i}', {c}, {m}, {k}, {'NULL' if s is None else repr(s)})" for i, c, m, k, s in _SIMPLE)


@query("simple_matches", "JOI-10", f"""
WITH a AS (SELECT {', '.join(_APPLICANT)} FROM customer), s AS (SELECT * FROM (VALUES {_SIMPLE_ROWS})
 AS s(scheme_id, communities, max_income, courses, special))
SELECT applicant_id, scheme_id FROM a CROSS JOIN s WHERE (list_contains(communities, upper(trim(community)))
 OR (list_contains(communities, 'MIN') AND upper(trim(community)) IN ('MUSLIM', 'CHRISTIAN', 'SIKH', 'BUDDHIST', 'JAIN', 'PARSI')))
 AND income <= max_income AND (trim(course) = '' OR list_contains(courses, lower(trim(course))))
 AND (special IS DISTINCT FROM 'armed_forces' OR armed_forces)""")
def _(t):
    catalogue = t.spark.createDataFrame(
        _SIMPLE, "scheme_id string, communities array<string>, max_income long, courses array<string>, special_condition string")
    return eligibility.simple_matches(t.raw("customer").selectExpr(*_APPLICANT), catalogue)


# --- selection -----------------------------------------------------------------------------------

_SELECT = """cand AS (SELECT application_id, a.student_id, a.scheme_id, family_income, marks,
 coalesce(family_income <= max_income, false) AS i, coalesce(marks >= min_marks, false) AS m,
 coalesce(document_status = 'VERIFIED', false) AS d FROM apps_raw a LEFT JOIN students s ON a.student_id = s.student_id
 JOIN rules r ON a.scheme_id = r.scheme_id WHERE application_status IN ('MINISTRY_SCRUTINY', 'ELIGIBILITY_CONFIRMED',
 'SUBMITTED', 'COLLEGE_REVIEW') AND route <> 'EXTERNAL_TRACKING'),
rk AS (SELECT application_id, row_number() OVER (PARTITION BY scheme_id ORDER BY marks DESC, family_income, application_id) AS rn
 FROM cand WHERE i AND m AND d),
pre AS (SELECT c.*, CASE WHEN rn <= 25 THEN CAST(rn AS INT) END AS "rank", CASE WHEN rn <= 25 THEN 'RECOMMENDED_FOR_SELECTION'
 WHEN rn > 25 THEN 'QUOTA_WAITLIST' ELSE 'NOT_RECOMMENDED' END AS decision FROM cand c LEFT JOIN rk USING (application_id))"""


def _preview(t):
    rows = eligibility.selection_candidates(t.apps_raw, t.students, t.rules)
    return eligibility.selection_preview(rows, 25)


@query("selection_preview", "WIN-01 RUL-06", f"""
WITH {_SELECT} SELECT application_id, scheme_id, "rank", decision, concat_ws('; ',
 CASE WHEN NOT i THEN 'income above ceiling or unknown' END, CASE WHEN NOT m THEN 'marks below minimum' END,
 CASE WHEN NOT d THEN 'documents not verified' END,
 CASE WHEN decision = 'QUOTA_WAITLIST' THEN 'selection quota exceeded' END) AS reasons FROM pre""")
def _(t):
    return _preview(t).select("application_id", "scheme_id", "rank", "decision",
                              F.concat_ws("; ", "reasons").alias("reasons"))


@query("selection_summary", "RUL-06", f"""
WITH {_SELECT} SELECT scheme_id, count(*) AS evaluated, count("rank") AS recommended,
 count_if(decision = 'QUOTA_WAITLIST') AS waitlisted, CAST(greatest(0, 25 - count("rank")) AS BIGINT) AS quota_remaining
FROM pre GROUP BY 1""")
def _(t):
    return eligibility.selection_summary(_preview(t), 25)


@query("selection_apply", "RUL-07", f"""
WITH {_SELECT} SELECT a.application_id, application_status AS previous_status, 'SELECTED' AS new_status FROM apps_raw a
JOIN pre ON a.application_id = pre.application_id WHERE "rank" IS NOT NULL""")
def _(t):
    chosen = _preview(t).where(F.col("rank").isNotNull())
    _, events = eligibility.apply_selection(t.apps_raw, chosen, as_instant(AS_OF))
    return events.select("application_id", "previous_status", "new_status")


@query("rule_impact", "RUL-05 SET-05", f"""
WITH x AS (SELECT a.scheme_id, family_income, marks, coalesce(family_income <= max_income AND marks >= min_marks, false) AS n,
 coalesce(family_income <= max_income * 0.5 AND marks >= min_marks - 50000 AND (r.category IS NULL OR r.category = s.category),
 false) AS p FROM apps_raw a LEFT JOIN students s USING (student_id) JOIN rules r ON a.scheme_id = r.scheme_id),
y AS (SELECT scheme_id, count(*) AS applications, count(family_income) AS evaluated, count_if(n) AS eligible_now,
 count_if(p) AS eligible_then, count_if(p AND NOT n) AS newly_eligible, count_if(n AND NOT p) AS newly_ineligible FROM x GROUP BY 1)
SELECT *, eligible_then - eligible_now AS net_change, {pct("eligible_then", "evaluated")} AS then_rate FROM y""")
def _(t):
    proposed = t.rules.select("scheme_id", (F.col("max_income") * F.lit(0.5).cast("decimal(3,1)")).alias("max_income"),
                              (F.col("min_marks") - 50000).alias("min_marks"), "category")
    return eligibility.rule_impact(t.apps_raw, t.students, t.rules, proposed)


@query("eligibility_changes", "SET-05", """
WITH b AS (SELECT student_id FROM students WHERE family_income <= 4000), a AS (SELECT student_id FROM students
 WHERE family_income <= 6000 AND category <> 'BUILDING')
SELECT student_id, 'newly_eligible' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT student_id, 'newly_ineligible' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(t):
    s = t.students
    return eligibility.change_sets(s.where("family_income <= 4000").select("student_id"),
                                   s.where("family_income <= 6000 AND category <> 'BUILDING'").select("student_id"))


# --- ingest --------------------------------------------------------------------------------------

_INTAKE = """reg AS (SELECT DISTINCT college_id, register_number FROM taken_keys), acc AS (SELECT DISTINCT lower(email) AS mail FROM taken_keys),
inc AS (SELECT * FROM roster),
cnt AS (SELECT college_id, register_number, count(*) AS n FROM inc WHERE register_number <> '' GROUP BY 1, 2),
ver AS (SELECT i.row_number, i.college_id, CASE WHEN coalesce(i.register_number, '') = '' OR full_name IS NULL
  OR NOT contains(email, '@') THEN 'INVALID' WHEN n > 1 OR r.college_id IS NOT NULL OR mail IS NOT NULL THEN 'DUPLICATE'
  ELSE 'VALID' END AS verdict, CASE WHEN n > 1 THEN 'Duplicate register number within uploaded file'
  WHEN r.college_id IS NOT NULL THEN 'Register number already registered in college'
  WHEN mail IS NOT NULL THEN 'Email already exists in system' END AS duplicate_reason
 FROM inc i LEFT JOIN cnt c USING (college_id, register_number) LEFT JOIN reg r USING (college_id, register_number)
 LEFT JOIN acc ON lower(i.email) = mail)"""


def _checked(t):
    return intake.verdicts(t.roster, t.register, t.register.select("email"))


@query("intake_verdicts", "RUL-26 JOI-13 WIN-04 PRJ-07 SRC-04",
       f"WITH {_INTAKE} SELECT row_number, college_id, verdict, duplicate_reason FROM ver".replace(
           "row_number", '"row_number"'))
def _(t):
    return _checked(t).select("row_number", "college_id", "verdict", "duplicate_reason")


@query("intake_summary", "RUL-26 RUL-29", f"""
WITH {_INTAKE} SELECT count(*) AS rows, count_if(verdict = 'VALID') AS valid, count_if(verdict = 'DUPLICATE') AS duplicate,
 count_if(verdict = 'INVALID') AS invalid FROM ver""".replace("row_number", '"row_number"').replace("AS rows", 'AS "rows"'))
def _(t):
    return intake.verdict_summary(_checked(t))


@query("intake_accepted", "RUL-29", f"""
WITH {_INTAKE} SELECT college_id, count(*) AS accepted FROM ver WHERE verdict = 'VALID' GROUP BY 1""".replace(
    "row_number", '"row_number"'))
def _(t):
    return intake.accepted(_checked(t)).groupBy("college_id").agg(F.count(F.lit(1)).alias("accepted"))

