"""Consistency, validity and readiness queries over the derived cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipendia.functions import names, values
from stipendia.functions.scalars import as_instant
from stipendia.operators import consistency, readiness
from stipendia.plans.certificates import cases
from stipendia.plans.mapping import AS_OF
from stipendia.plans.registry import query


def ladder(a: str, b: str, strict: str = "false") -> str:
    """Status of two upper-case names whose differences are order, one trailing initial or spelling."""
    la, lb = f"string_split(lower({a}), ' ')", f"string_split(lower({b}), ' ')"
    words = (lambda t: f"list_sort(list_filter({t}, lambda w: length(w) > 1))")
    singles = (lambda t: f"len(list_filter({t}, lambda w: length(w) = 1))")
    sim = f"(1.0 - levenshtein(lower({a}), lower({b})) / CAST(greatest(length({a}), length({b})) AS DOUBLE))"
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'MISSING' WHEN {a} = {b} OR list_sort({la}) = list_sort({lb}) THEN 'EXACT_MATCH'
 WHEN {words(la)} = {words(lb)} AND ({singles(la)} > 0) <> ({singles(lb)} > 0) THEN CASE WHEN {strict} THEN 'LIKELY_MATCH' ELSE 'EXACT_MATCH' END
 WHEN {sim} >= 0.85 THEN CASE WHEN {strict} THEN 'MINOR_DIFFERENCE' ELSE 'LIKELY_MATCH' END ELSE 'MISMATCH' END"""


_SIM = "(CAST(greatest(length({a}), length({b})) - levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})))"


def sim(a: str, b: str) -> str:
    return _SIM.format(a=a, b=b)


@query("name_comparison", "TXT-24 TXT-25", f"""
SELECT student_id, {ladder("full_name", "name12")} AS loose_status, {ladder("full_name", "name12", "true")} AS strict_status,
 {sim("full_name", "name12")} AS similarity FROM cases""")
def _(t):
    rows = names.with_name_match(cases(t), "full_name", "name12", False, "loose")
    rows = names.with_name_match(rows, "full_name", "name12", True, "strict")
    return rows.select("student_id", "loose_status", "strict_status",
                       names.similarity(F.col("full_name"), F.col("name12")).alias("similarity"))


_CODE = """CASE WHEN bal < 500 THEN 'BC' WHEN seg = 'MACHINERY' THEN 'MBC' WHEN seg = 'BUILDING' THEN 'BC' WHEN seg = 'AUTOMOBILE'
 THEN 'SC' WHEN seg = 'HOUSEHOLD' THEN 'ST' ELSE 'DNC' END"""
_FRESH = """CASE WHEN valid_upto IS NULL THEN CASE WHEN date_diff('day', strptime(issue_date, '%d-%m-%Y')::DATE, DATE '2001-08-02') / CAST(30.44 AS DOUBLE) > 12
 THEN 'outside_window' ELSE 'needs_confirmation' END WHEN nat < 5 THEN 'needs_confirmation'
 WHEN strptime(valid_upto, '%d-%m-%Y')::DATE < DATE '2001-08-02' THEN 'expired'
 WHEN date_diff('day', DATE '2001-08-02', strptime(valid_upto, '%d-%m-%Y')::DATE) <= 30 THEN 'warning' ELSE 'valid' END"""
_VIEW = f"""v AS (SELECT *, {_CODE} AS entered_code, {_FRESH} AS freshness FROM cases),
w AS (SELECT *, CASE WHEN dob = dob12 THEN 'MATCH' ELSE 'MISMATCH' END AS dob_status,
 CASE WHEN income_entered IS NULL THEN 'WARNING' WHEN income_entered <> income THEN 'MISMATCH' WHEN freshness = 'expired' THEN 'EXPIRED'
 ELSE 'MATCH' END AS income_status, CASE WHEN community = entered_code THEN 'MATCH' ELSE 'MISMATCH' END AS community_status FROM v)"""


def _fresh():
    return values.income_freshness(F.col("issue_date"), F.col("valid_upto"), F.col("nat") >= 5, F.lit(12), as_instant(AS_OF))


@query("value_comparison", "TXT-26 RUL-13", f"""
WITH {_VIEW} SELECT student_id, dob_status, income_status, community_status, freshness FROM w""")
def _(t):
    rows = cases(t).withColumn("freshness", _fresh())
    c = F.col
    return rows.select(
        "student_id", values.compare_birth_dates(F.replace("dob12", F.lit("-"), F.lit(".")), c("dob")).alias("dob_status"),
        values.compare_incomes(c("income").cast("string"), c("income_entered").cast("string"), c("freshness")).alias("income_status"),
        values.compare_communities(c("community"), c("category_entered")).alias("community_status"), "freshness")


def case_documents(t):
    """Four documents per case with name, birth date, parent and confidence."""
    doc = (lambda i, kind, name, dob, parent, conf: F.struct(
        F.lit(i).alias("position"), F.lit(kind).alias("doc_type"), F.col(name).alias("name"),
        (F.col(dob) if dob else F.lit(None).cast("string")).alias("dob"),
        (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent_name"), F.lit(conf).alias("confidence")))
    return cases(t).select(F.col("student_id").alias("case_id"), F.inline(F.array(
        doc(0, "ms10", "full_name", "dob", "parent_name", 91), doc(1, "ms12", "name12", "dob12", None, 88),
        doc(2, "community", "full_name", None, "parent_name", 85), doc(3, "income", "income_holder", None, "parent_name", 79))))


_DOCS = """docs AS (SELECT student_id AS case_id, unnest([0, 1, 2, 3]) AS position, unnest([full_name, name12, full_name, income_holder]) AS name
 FROM cases)"""


@query("case_status", "RUL-16 JOI-11 EVL-09", f"""
WITH {_DOCS}, p AS (SELECT a.case_id, {ladder("a.name", "b.name")} AS s FROM docs a JOIN docs b ON a.case_id = b.case_id
 AND a.position < b.position), f AS (SELECT case_id, max(CASE WHEN s = 'MISMATCH' THEN 1 ELSE 0 END) AS bad,
 max(CASE WHEN s = 'LIKELY_MATCH' THEN 1 ELSE 0 END) AS mild FROM p GROUP BY 1)
SELECT f.case_id, 4 AS documents, CASE WHEN bad = 1 OR dob <> dob12 THEN 'SIGNIFICANT CONFLICT' WHEN mild = 1 THEN 'MINOR DIFFERENCE'
 ELSE 'CONSISTENT' END AS status, CASE WHEN dob <> dob12 THEN 'SIGNIFICANT CONFLICT' ELSE 'CONSISTENT' END AS dob_status,
 'CONSISTENT' AS parent_status FROM f JOIN cases c ON f.case_id = c.student_id""".replace("4 AS documents", "CAST(4 AS BIGINT) AS documents"))
def _(t):
    return consistency.evaluate_cases(case_documents(t))


@query("case_name_pairs", "JOI-11 TXT-24", f"""
WITH {_DOCS} SELECT a.case_id, a.position AS position_a, b.position AS position_b, {ladder("a.name", "b.name")} AS status
FROM docs a JOIN docs b ON a.case_id = b.case_id AND a.position < b.position""")
def _(t):
    sources = F.array(*[F.struct(F.lit(str(i)).alias("source"), F.col(n).alias("name"), F.lit(False).alias("strict"))
                        for i, n in enumerate(["full_name", "name12", "full_name", "income_holder"])])
    rows = cases(t).select(F.col("student_id").alias("case_id"), sources.alias("name_sources"))
    return consistency.name_pairs(rows).select(
        "case_id", F.col("source_a").cast("int").alias("position_a"), F.col("source_b").cast("int").alias("position_b"),
        F.col("pair_status").alias("status"))


@query("consensus_names", "RUL-17", f"""
WITH {_DOCS}, k AS (SELECT *, replace(name, ' ', '') AS key FROM docs), g AS (SELECT case_id, key, count(*) AS n, min(position) AS p,
 arg_min(name, position) AS shown FROM k GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id
 ORDER BY n DESC, p) AS rn FROM g) WHERE rn = 1),
c AS (SELECT b.case_id, b.shown, b.n, b.p, bool_or(levenshtein(g.key, b.key) > 2) AS conflict FROM b JOIN g ON g.case_id = b.case_id GROUP BY 1, 2, 3, 4)
SELECT case_id, shown AS consensus_name, CASE WHEN conflict THEN 'NEEDS_REVIEW' ELSE 'HIGH_CONFIDENCE' END AS status,
 CASE WHEN conflict THEN 60 WHEN n >= 2 THEN least(98, 85 + n * 4) ELSE 91 END AS confidence, n AS agreements, 4 AS documents, conflict
FROM c""".replace("4 AS documents", "CAST(4 AS BIGINT) AS documents").replace(" AS confidence,", "::BIGINT AS confidence,").replace(
    "CASE WHEN conflict THEN 60 WHEN n >= 2 THEN least(98, 85 + n * 4) ELSE 91 END", "(CASE WHEN conflict THEN 60 WHEN n >= 2 THEN least(98, 85 + n * 4) ELSE 91 END)"))
def _(t):
    return consistency.consensus_names(case_documents(t))


def score_input(t):
    c = F.col
    return cases(t).select(
        c("student_id").alias("case_id"), c("full_name").alias("aadhaar_name"), c("dob").alias("aadhaar_dob"),
        c("full_name").alias("community_name"), F.lit(None).cast("string").alias("community_dob"),
        c("income_holder").alias("income_name"), F.lit(None).cast("string").alias("income_dob"),
        c("full_name").alias("tenth_name"), c("dob").alias("tenth_dob"), c("name12").alias("twelfth_name"),
        c("dob12").alias("twelfth_dob"), c("bank_holder"), c("account_type"),
        F.when(c("income_applicant") == "parent", "Parent").otherwise("Self").alias("relationship"),
        F.when(c("nat") < 20, c("parent_name")).alias("parent_reference"), c("income").cast("string").alias("cert_income"),
        c("income_entered").cast("string").alias("entered_income"), "issue_date", "valid_upto",
        (c("nat") >= 5).alias("expiry_confirmed"), F.lit(12).alias("window_months"), c("community").alias("cert_community"),
        c("category_entered").alias("entered_community"), F.lit(True).alias("has_aadhaar"), (c("bal") >= -500).alias("has_bank"),
        F.lit(True).alias("has_tenth"), F.lit(True).alias("has_twelfth"), (c("nat") != 7).alias("has_community"),
        F.lit(True).alias("has_income"))


_SCORE = f"""{_VIEW}, src AS (SELECT student_id, unnest([full_name, CASE WHEN nat <> 7 THEN full_name END,
 CASE WHEN income_applicant = 'student' THEN income_holder END, full_name, name12, bank_holder]) AS name, unnest([0, 1, 2, 3, 4, 5]) AS pos,
 unnest([true, true, true, false, false, true]) AS strict FROM w), nn AS (SELECT * FROM src WHERE name IS NOT NULL),
pr AS (SELECT a.student_id, {ladder("a.name", "b.name", "(a.strict OR b.strict)")} AS s FROM nn a JOIN nn b ON a.student_id = b.student_id AND a.pos < b.pos),
nf AS (SELECT student_id, bool_or(s = 'MISMATCH') AS bad, bool_or(s IN ('LIKELY_MATCH', 'MINOR_DIFFERENCE')) AS mild FROM pr GROUP BY 1),
st AS (SELECT w.*, bad, CASE WHEN bad THEN 'FAIL' WHEN mild OR (income_applicant = 'parent' AND nat >= 20) THEN 'WARN' ELSE 'PASS' END AS name_state,
 CASE WHEN dob_status = 'MATCH' THEN 'PASS' ELSE 'FAIL' END AS dob_state,
 CASE WHEN income_status = 'MATCH' AND freshness IN ('valid', 'needs_confirmation') THEN 'PASS' WHEN income_status = 'MATCH' THEN 'WARN'
  WHEN income_status = 'WARNING' AND freshness <> 'expired' THEN 'PENDING' ELSE 'FAIL' END AS income_state,
 CASE WHEN nat = 7 THEN 'NOT_CHECKED' WHEN community_status = 'MATCH' THEN 'PASS' ELSE 'FAIL' END AS community_state,
 CASE WHEN bal < -500 THEN 'NOT_CHECKED' WHEN account_type = 'Single' THEN 'PASS' ELSE 'FAIL' END AS bank_state
 FROM w JOIN nf USING (student_id)),
sc AS (SELECT *, CAST(CASE name_state WHEN 'PASS' THEN 30 WHEN 'WARN' THEN 20 ELSE 0 END + CASE dob_state WHEN 'PASS' THEN 20 ELSE 0 END
 + CASE income_state WHEN 'PASS' THEN 20 WHEN 'WARN' THEN 15 ELSE 0 END + CASE community_state WHEN 'PASS' THEN 15 ELSE 0 END
 + CASE bank_state WHEN 'PASS' THEN 15 ELSE 0 END AS INT) AS score FROM st)"""


@query("consistency_score", "RUL-15 RUL-20", f"""
WITH {_SCORE} SELECT student_id AS case_id, name_state, dob_state, income_state, community_state, bank_state, score,
 CASE WHEN bad OR dob_state = 'FAIL' OR account_type = 'Joint' OR income_status = 'EXPIRED' OR community_status = 'MISMATCH'
 THEN 'Correction required' WHEN score >= 85 THEN 'High' WHEN score >= 60 THEN 'Moderate' ELSE 'Needs review' END AS label FROM sc""")
def _(t):
    return consistency.consistency_score(score_input(t), as_instant(AS_OF)).select(
        "case_id", "name_state", "dob_state", "income_state", "community_state", "bank_state", "score", "label")


def field_input(t):
    c = F.col
    return cases(t).select(
        c("student_id").alias("case_id"), c("full_name").alias("student_name"), "parent_name", "income_applicant",
        c("name12").alias("doc_name"), "dob", F.replace("dob12", F.lit("-"), F.lit("/")).alias("doc_dob"),
        c("community").alias("category"), F.when(c("nat") != 7, c("community")).alias("doc_category"),
        c("income_entered").alias("income"), c("income").alias("doc_income"), "income_holder", "bank_holder",
        F.lit("Tamil Nadu").alias("state"), F.when(c("nat") < 3, "TAMIL NADU").when(c("nat") < 6, "Kerala").alias("doc_state"))


@query("compared_fields", "RUL-11", f"""
WITH f AS (SELECT student_id, unnest(['name', 'date_of_birth', 'category', 'income', 'income_provider', 'bank_holder', 'state']) AS field,
 unnest([CASE WHEN {sim("full_name", "name12")} >= 0.90 THEN 'MATCH' WHEN {sim("full_name", "name12")} >= 0.75 THEN 'MINOR_DIFFERENCE' ELSE 'MISMATCH' END,
 CASE WHEN dob = dob12 THEN 'MATCH' ELSE 'MISMATCH' END, CASE WHEN nat = 7 THEN 'MISSING' ELSE 'MATCH' END,
 CASE WHEN income_entered IS NULL THEN 'MISSING' WHEN income = income_entered THEN 'MATCH'
  WHEN abs(income - income_entered) / CAST(greatest(income, income_entered) AS DOUBLE) <= 0.10 THEN 'MINOR_DIFFERENCE' ELSE 'MISMATCH' END,
 'MATCH', CASE WHEN {sim("full_name", "bank_holder")} >= 0.75 THEN 'MATCH' ELSE 'MISMATCH' END,
 CASE WHEN nat < 3 THEN 'MATCH' WHEN nat < 6 THEN 'MISMATCH' END]) AS status FROM cases)
SELECT student_id AS case_id, field, status FROM f WHERE status IS NOT NULL""")
def _(t):
    return consistency.compared_fields(field_input(t))


@query("document_matrix", "RUL-10", f"""
SELECT student_id AS case_id, CASE WHEN {sim("full_name", "name12")} < 0.75 OR {sim("full_name", "bank_holder")} < 0.75 THEN 'MISMATCH'
 ELSE 'MATCH' END AS name_status, CASE WHEN dob <> dob12 THEN 'MISMATCH' ELSE 'MATCH' END AS dob_status,
 CASE WHEN bal < 4000 THEN 'MATCH' ELSE 'MISMATCH' END AS gender_status, marks12 AS marks,
 CASE WHEN income_applicant = 'parent' THEN parent_name ELSE full_name END AS provider,
 date_diff('day', strptime(issue_date, '%d-%m-%Y')::DATE, DATE '2001-08-02') / CAST(30.44 AS DOUBLE) > 12 AS income_expired, nat < 20 AS ifsc_valid FROM cases""")
def _(t):
    c = F.col
    rows = cases(t).select(
        c("student_id").alias("case_id"), c("full_name").alias("aadhaar_name"), c("full_name").alias("tenth_name"),
        c("name12").alias("twelfth_name"), "bank_holder", F.lit("").alias("bonafide_name"), c("dob").alias("aadhaar_dob"),
        c("dob12").alias("tenth_dob"), F.lit("Female").alias("gender"), F.when(c("bal") < 4000, "FEMALE").otherwise("male").alias("doc_gender"),
        c("marks12").alias("twelfth_marks"), c("marks10").alias("tenth_marks"), F.lit("HSC").alias("twelfth_board"),
        F.lit("SSLC").alias("tenth_board"), c("community").alias("cert_community"), c("issue_date").alias("community_issue_date"),
        c("income").alias("cert_income"), "income_applicant", "parent_name", c("full_name").alias("student_name"), "issue_date",
        F.when(c("nat") < 20, F.concat(F.lit("sbin0"), F.substring("k", 4, 6))).otherwise("SBIN123").alias("ifsc"),
        F.lit("Tamil Nadu").alias("state"), F.lit("Salem").alias("district"))
    return consistency.document_matrix(rows, as_instant(AS_OF)).select(
        "case_id", c("identity.name").alias("name_status"), c("identity.dob").alias("dob_status"),
        c("identity.gender").alias("gender_status"), c("academic.marks").alias("marks"), c("financial.provider").alias("provider"),
        c("financial.expired").alias("income_expired"), c("bank.ifsc_valid").alias("ifsc_valid"))


@query("income_name_check", "RUL-20", f"""
SELECT student_id AS case_id, CASE WHEN income_applicant = 'parent' THEN 'SKIPPED' ELSE 'CHECKED' END AS student_name_check,
 income_applicant = 'parent' AS parent_name_used, CASE WHEN income_applicant = 'parent' THEN {ladder("parent_name", "income_holder")} END
 AS parent_match, CASE WHEN income_applicant = 'parent' THEN {ladder("parent_name", "income_holder")} = 'EXACT_MATCH' END AS parent_consistent
FROM cases""")
def _(t):
    return consistency.income_name_check(cases(t).withColumnRenamed("student_id", "case_id"))


_SCHEME_OF = "CASE WHEN nat < 10 THEN 'pms-sc' WHEN nat < 20 THEN 'tn-bc-mbc' ELSE 'unlisted' END"


@query("document_validity", "RUL-12 JOI-14", f"""
WITH d AS (SELECT student_id, nat, unnest(['income_certificate', 'community', 'ms12', 'photo']) AS doc_type, issue_date, valid_upto,
 {_SCHEME_OF} AS scheme FROM cases), x AS (SELECT *, CASE WHEN doc_type = 'income_certificate' THEN strptime(valid_upto, '%d-%m-%Y')::DATE END AS up,
 date_diff('day', strptime(issue_date, '%d-%m-%Y')::DATE, DATE '2001-08-02') / CAST(30.44 AS DOUBLE) AS age,
 CASE doc_type WHEN 'income_certificate' THEN CASE scheme WHEN 'pms-sc' THEN 'RULE-PMS-SC-INC-2025' WHEN 'tn-bc-mbc' THEN 'RULE-TN-BC-INC-2025' END
  WHEN 'community' THEN 'RULE-COMMUNITY-PERMANENT' WHEN 'ms12' THEN 'RULE-MARKSHEET-PERMANENT' END AS rule_id FROM d),
y AS (SELECT *, CASE WHEN up IS NOT NULL AND nat < 5 THEN 'NEEDS_CONFIRMATION' WHEN up < DATE '2001-08-02' THEN 'EXPIRED'
  WHEN date_diff('day', DATE '2001-08-02', up) <= 30 THEN 'EXPIRING_SOON' WHEN up IS NOT NULL THEN 'NOT_EXPIRED'
  WHEN doc_type IN ('community', 'ms12') THEN 'PERMANENT_RECORD' ELSE 'UNKNOWN_VALIDITY' END AS expiry_status,
 CASE WHEN rule_id IS NULL THEN 'NEEDS_CONFIRMATION' WHEN doc_type IN ('community', 'ms12') THEN 'WITHIN_WINDOW' WHEN age < 0 THEN 'NEEDS_CONFIRMATION'
  WHEN age > 12 THEN 'OUTSIDE_WINDOW' WHEN age > 6 THEN 'WITHIN_WINDOW_CAUTION' ELSE 'WITHIN_WINDOW' END AS acceptance_status FROM x)
SELECT student_id, doc_type, rule_id, expiry_status, acceptance_status, CASE WHEN expiry_status = 'EXPIRED' THEN 'expired'
 WHEN acceptance_status = 'OUTSIDE_WINDOW' THEN 'outside_window' WHEN rule_id IS NULL OR acceptance_status = 'NEEDS_CONFIRMATION'
 OR expiry_status = 'NEEDS_CONFIRMATION' THEN 'needs_confirmation' ELSE 'valid' END AS validity FROM y""")
def _(t):
    c = F.col
    docs = cases(t).select(
        "student_id", F.explode(F.array(*[F.lit(k) for k in ("income_certificate", "community", "ms12", "photo")])).alias("doc_type"),
        "issue_date", "valid_upto", (c("nat") >= 5).alias("expiry_confirmed"),
        F.when(c("nat") < 10, "pms-sc").when(c("nat") < 20, "tn-bc-mbc").otherwise("unlisted").alias("scheme_id"),
        F.lit("2025-26").alias("application_year"))
    docs = docs.withColumn("valid_upto", F.when(c("doc_type") == "income_certificate", c("valid_upto")))
    return consistency.document_validity(docs, consistency.validity_rules(t.spark), as_instant(AS_OF)).select(
        "student_id", "doc_type", "rule_id", "expiry_status", "acceptance_status", "validity")


@query("preparation_audit", "RUL-14 SET-06", """
WITH x AS (SELECT student_id, bal, nat, seg, account_type, seg <> 'FURNITURE' AS fg, nat < 20 AS fi FROM cases),
y AS (SELECT student_id, list_filter([['marksheet', 'true', CASE WHEN nat <> 3 THEN 'true' END], ['income', CAST(fi AS VARCHAR), CASE WHEN bal > 0 THEN 'true' END],
 ['community', CAST(fg AS VARCHAR), CASE WHEN bal > 1000 THEN 'true' END], ['identity', 'true', 'true'],
 ['bank', 'true', CASE WHEN account_type = 'Single' THEN 'true' END], ['name_consistency', 'true', CASE WHEN nat < 18 THEN 'true' END],
 ['dob_consistency', 'true', 'true'], ['validity', CAST(fi AS VARCHAR), CASE WHEN bal > 0 AND bal < 6000 THEN 'true' END],
 ['community_consistency', CAST(fg AS VARCHAR), CASE WHEN bal > 500 THEN 'true' END],
 ['confirmation', 'true', CASE WHEN bal > 2000 AND (NOT fg OR nat < 12) THEN 'true' END]], lambda z: z[2] = 'true') AS a FROM x)
SELECT student_id AS case_id, CAST(len(a) AS INT) AS applicable, CAST(len(list_filter(a, lambda z: z[3] = 'true')) AS INT) AS completed,
 CAST(floor(len(list_filter(a, lambda z: z[3] = 'true')) / CAST(len(a) AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS score,
 coalesce(array_to_string(list_transform(list_filter(a, lambda z: z[3] IS NULL), lambda z: z[1]), ','), '') AS next_actions FROM y""")
def _(t):
    c = F.col
    yes, no = F.lit(True), F.lit(False)
    rows = cases(t).select(
        c("student_id").alias("case_id"),
        F.when(c("seg") == "FURNITURE", F.array(F.lit("SC"), F.lit("GEN"))).otherwise(F.array(F.lit("SC"))).alias("communities"),
        F.when(c("nat") < 20, 250000).otherwise(999_999_999).alias("max_income"), yes.alias("has_marksheet"),
        (c("nat") != 3).alias("read_marksheet"), (c("bal") > 0).alias("has_income"), yes.alias("read_income"),
        (c("bal") > 1000).alias("has_community"), yes.alias("read_community"), c("full_name").alias("aadhaar_name"),
        c("dob").alias("aadhaar_dob"), no.alias("has_aadhaar"), "bank_holder", "account_type",
        F.when(c("nat") < 18, "PASS").otherwise("FAIL").alias("name_state"), F.lit("PASS").alias("dob_state"),
        F.when(c("bal") > 500, "MATCH").otherwise("MISMATCH").alias("community_status"),
        F.when(c("bal") < 6000, "valid").otherwise("expired").alias("validity"), (c("bal") > 2000).alias("confirmed_name"),
        no.alias("confirmed_dob"), yes.alias("confirmed_income"), (c("nat") < 12).alias("confirmed_community"))
    return consistency.preparation_audit(rows).select("case_id", "applicable", "completed", "score",
                                                      F.array_join("next_actions", ",").alias("next_actions"))


@query("assembled_profile", "RUL-19", """
SELECT student_id, CASE WHEN bal < 0 THEN name12 ELSE full_name END AS value, CASE WHEN bal < 0 THEN 'twelfth' WHEN bal < 4000 THEN 'identity'
 ELSE 'tenth' END AS source, CASE WHEN bal < 0 THEN 45 WHEN bal < 4000 THEN 100 ELSE 72 END AS confidence,
 CASE WHEN bal < 0 THEN 'untrusted' WHEN bal < 4000 THEN 'high' ELSE 'review' END AS band FROM cases""")
def _(t):
    c = F.col
    sources = [("identity", F.when(c("bal").between(0, 3999.999), c("full_name")), F.lit(100)),
               ("tenth", F.when(c("bal") >= 0, c("full_name")), F.lit(72)), ("twelfth", c("name12"), F.lit(45))]
    return cases(t).select("student_id", consistency.assembled(sources).alias("a")).select("student_id", "a.*")


def passes(t):
    """Three extraction passes per case that agree, differ or miss the name."""
    c = F.col
    none = F.lit(None).cast("string")
    one = (lambda i, name, conf, marks, mconf, school, sconf, year: F.struct(
        F.lit(i).alias("pass_no"), name.alias("name"), F.lit(conf).alias("name_confidence"), marks.cast("int").alias("marks"),
        F.lit(mconf).alias("marks_confidence"), school.alias("school"), F.lit(sconf).alias("school_confidence"), year.alias("year"),
        F.lit(conf * 100).alias("confidence")))
    return cases(t).select(c("student_id").alias("doc_id"), F.inline(F.array(
        one(0, c("full_name"), 0.70, F.lit(None), 0.0, none, 0.0, none),
        one(1, c("name12"), 0.80, c("marks10"), 0.6, F.lit("GOVT SCHOOL"), 0.9, F.lit("2020")),
        one(2, F.when(c("nat") < 15, c("full_name")).otherwise(F.lit("OTHER PERSON")), 0.65, c("marks12"), 0.9, F.lit("MODEL SCHOOL"), 0.5,
            F.lit("2021")))))


@query("reconciled_passes", "RUL-18", """
WITH n AS (SELECT student_id, marks12, unnest([full_name, name12, CASE WHEN nat < 15 THEN full_name ELSE 'OTHER PERSON' END]) AS name,
 unnest([0.70, 0.80, 0.65])::DOUBLE AS conf, unnest([0, 1, 2]) AS pass FROM cases),
g AS (SELECT *, count(*) OVER (PARTITION BY student_id, replace(name, ' ', '')) AS k FROM n),
s AS (SELECT *, conf + CASE WHEN k >= 2 THEN 0.20::DOUBLE ELSE 0 END AS total FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY total DESC, pass) AS rn FROM s)
SELECT student_id AS doc_id, 3::BIGINT AS passes, name, least(0.98::DOUBLE, floor(total * 100.0 + 0.5) / 100.0) AS name_confidence, marks12 AS marks,
 'GOVT SCHOOL' AS school, '2020' AS year FROM r WHERE rn = 1""")
def _(t):
    return consistency.reconcile_passes(passes(t), ["year"])


@query("agreed_candidate", "RUL-18", """
WITH n AS (SELECT student_id, unnest([full_name, name12, CASE WHEN nat < 15 THEN full_name ELSE 'OTHER PERSON' END]) AS name,
 unnest([70, 80, 65]) AS conf, unnest([0, 1, 2]) AS pass FROM cases),
g AS (SELECT student_id, replace(name, ' ', '') AS k, count(*) AS n, max(conf) AS c, min(pass) AS p, arg_max(name, conf) AS shown FROM n GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY n DESC, p) AS rn FROM g) WHERE rn = 1)
SELECT student_id AS doc_id, CASE WHEN n = 1 THEN 'NOT_DETECTED' WHEN c >= 75 THEN 'HIGH_CONFIDENCE' ELSE 'NEEDS_REVIEW' END AS status,
 CASE WHEN n > 1 THEN shown END AS name, CASE WHEN n > 1 THEN CAST(c AS DOUBLE) END AS confidence FROM b""")
def _(t):
    return consistency.agreed_candidate(passes(t).withColumn("confidence", F.floor(F.col("confidence") + 0.5).cast("double")))


# --- readiness -----------------------------------------------------------------------------------

def readiness_input(t):
    c = F.col
    none = (lambda kind: F.lit(None).cast(kind))
    profile = F.struct(
        c("full_name").alias("student_name"), c("income_applicant").alias("income_applicant"), c("dob").alias("dob"),
        c("income_entered").alias("income"), c("community").alias("category"), F.lit("Engineering").alias("course"),
        F.lit("Govt College Salem").alias("institution"), F.lit("ug").alias("level"),
        F.when(c("nat") < 15, "Tamil Nadu").when(c("nat") < 20, "Kerala").alias("state"), none("string").alias("domicile"),
        F.when(c("bal") < 3000, "management").when(c("bal") < 6000, "government").alias("quota_type"),
        F.when(c("bal") > 2000, True).alias("first_graduate"), none("boolean").alias("disability"),
        none("int").alias("disability_percentage"), none("string").alias("bank_holder"), none("string").alias("ifsc"),
        F.when(c("nat") < 5, False).when(c("nat") < 15, True).alias("aadhaar_bank_linked"),
        F.when(c("bal") < 100, "2024-25").otherwise("2025-26").alias("academic_year"), (c("bal") > 9000).alias("is_renewal"),
        F.lit(True).alias("otr_generated"), none("boolean").alias("face_auth_available"))
    docs = F.struct(
        c("full_name").alias("aadhaar_name"), c("full_name").alias("tenth_name"), c("name12").alias("twelfth_name"), c("bank_holder"),
        F.lit("").alias("bonafide_name"), c("dob").alias("aadhaar_dob"), c("dob12").alias("tenth_dob"),
        c("income_holder").alias("income_name"), F.lit(True).alias("has_income_cert"), c("income"),
        F.when(c("nat") != 2, F.lit("INC/1")).alias("certificate_number"), F.when(c("nat") != 4, F.lit("Tahsildar")).alias("authority"),
        c("issue_date"), F.when(c("nat") >= 12, c("valid_upto")).alias("expiry_date"),
        F.when(c("bal") < -800, F.array().cast("array<string>")).when(c("bal") < 2000, F.array(F.lit("income"), F.lit("tenth_marks"))).otherwise(
            F.array(F.lit("income"), F.lit("twelfth"), F.lit("passbook"), F.lit("aadhar"))).alias("uploaded_types"),
        F.when(c("nat") == 9, F.array(F.lit("x"))).alias("wrong_types"), F.when(c("nat") == 10, F.array(F.lit("x"), F.lit("y"), F.lit("z"))
                                                                               ).alias("low_quality"),
        F.when(c("bal") > 5000, F.lit("DNC")).alias("category"), F.when(c("nat") == 11, "Medical").alias("course"),
        none("string").alias("twelfth_course"), F.when(c("nat") == 12, "Private Academy Chennai").alias("institution"),
        F.when(c("nat") == 13, "SBIN00").otherwise("SBIN0000123").alias("ifsc"), none("boolean").alias("aadhaar_bank_linked"),
        none("int").alias("disability_percentage"), none("boolean").alias("disability_cert"), none("string").alias("previous_marks"))
    scheme = F.struct(
        F.lit("VERIFIED").alias("rule_status"), F.lit("TAMIL_NADU").alias("jurisdiction"), F.lit("Tamil Nadu").alias("state"),
        F.lit("UMIS").alias("portal"), F.lit("2025-26").alias("academic_year"), F.lit("ug / pg").alias("level"),
        F.array(F.lit("Aadhaar Card"), F.lit("Class 12 Marksheet"), F.lit("Income Certificate"), F.lit("Bank Passbook")).alias("required_documents"),
        F.lit(True).alias("requires_govt_quota"), F.lit(True).alias("requires_first_graduate"), F.lit(False).alias("domicile_required"),
        F.lit(False).alias("requires_disability"), none("int").alias("minimum_disability"), F.lit("50% marks").alias("renewal_conditions"))
    match = F.when(c("seg") == "HOUSEHOLD", "NOT MATCHED").when(c("seg") == "FURNITURE", "NEEDS MORE INFORMATION").otherwise("CONFIRMED MATCH")
    return cases(t).select("student_id", profile.alias("p"), docs.alias("d"), scheme.alias("s"), match.alias("match_type"))


_AGE = "date_diff('day', strptime(issue_date, '%d-%m-%Y')::DATE, DATE '2001-08-02') / CAST(30.44 AS DOUBLE) > 12"
_READY = f"""x AS (SELECT *, CAST({sim("full_name", "name12")} < 0.75 AS INT) + CAST({sim("full_name", "bank_holder")} < 0.75 AS INT) AS wrong,
 CASE WHEN bal < -800 THEN NULL WHEN bal < 2000 THEN 2 ELSE 0 END AS miss,
 CASE WHEN nat >= 12 AND valid_upto IS NOT NULL THEN strptime(valid_upto, '%d-%m-%Y')::DATE < DATE '2001-08-02' ELSE {_AGE} END AS stale,
 coalesce(abs(income - income_entered) / CAST(greatest(income, income_entered) AS DOUBLE) > 0.15, false) AS gap FROM cases),
y AS (SELECT student_id, CAST(greatest(0, 20 - least(15, wrong * 6) - CASE WHEN dob <> dob12 THEN 8 ELSE 0 END
  - CASE WHEN income_applicant = 'student' AND {sim("full_name", "income_holder")} < 0.70 THEN 6 ELSE 0 END) AS INT) AS identity_score,
 CAST(greatest(0, 20 - CASE WHEN miss IS NULL THEN 12 ELSE least(16, miss * 5) END - CASE WHEN nat = 9 THEN 5 ELSE 0 END
  - CASE WHEN nat = 10 THEN 8 ELSE 0 END - CASE WHEN nat = 2 THEN 3 ELSE 0 END - CASE WHEN nat = 4 THEN 2 ELSE 0 END) AS INT) AS documents_score,
 CASE WHEN seg = 'HOUSEHOLD' THEN 0 ELSE 20 END AS eligibility_score,
 CAST(greatest(0, 20 - CASE WHEN gap THEN 4 ELSE 0 END - CASE WHEN bal > 5000 AND community <> 'DNC' THEN 8 ELSE 0 END - CASE WHEN nat = 11 THEN 4 ELSE 0 END
  - CASE WHEN nat = 12 THEN 4 ELSE 0 END - CASE WHEN nat >= 15 AND nat < 20 THEN 10 ELSE 0 END) AS INT) AS application_score,
 CAST(greatest(0, 10 - CASE WHEN {sim("full_name", "bank_holder")} < 0.75 THEN 5 ELSE 0 END - CASE WHEN nat = 13 THEN 3 ELSE 0 END
  - CASE WHEN nat < 5 THEN 2 ELSE 0 END) AS INT) AS bank_score,
 CAST(10 - CASE WHEN stale THEN 6 ELSE 0 END - CASE WHEN bal < 100 THEN 3 ELSE 0 END AS INT) AS certificates_score,
 seg = 'FURNITURE' OR bal >= 6000 OR bal <= 2000 OR nat >= 20 OR nat >= 15 OR bal > 9000 AS unknown_required FROM x),
z AS (SELECT *, identity_score + documents_score + eligibility_score + application_score + bank_score + certificates_score AS total FROM y)"""


@query("readiness", "RUL-08 RUL-09 JOI-18 SRT-05", f"""
WITH {_READY} SELECT *, CASE WHEN unknown_required AND total >= 75 THEN 'NEEDS_CONFIRMATION' WHEN total >= 90 THEN 'READY_TO_SUBMIT'
 WHEN total >= 75 THEN 'REVIEW_BEFORE_SUBMIT' WHEN total >= 50 THEN 'CORRECTIONS_NEEDED' ELSE 'NOT_READY' END AS level FROM z""")
def _(t):
    return readiness.readiness(readiness_input(t), as_instant(AS_OF)).drop("findings", "missing_documents")


# Answers that make every kind of finding occur, by the student's number (struct, field, type, rows of condition and value).
_VARIED = [
    ("s", "rule_status", "string", [("k % 5 = 0", "'UNVERIFIED'"), ("true", "'VERIFIED'")]),
    ("s", "requires_disability", "boolean", [("true", "k % 3 = 0")]),
    ("s", "minimum_disability", "int", [("k % 6 = 0", "60")]),
    ("p", "disability", "boolean", [("k % 4 = 1", "true")]),
    ("p", "disability_percentage", "int", [("k % 7 = 2", "30"), ("k % 7 = 3", "50")]),
    ("d", "disability_cert", "boolean", [("true", "k % 2 = 0")]),
    ("s", "jurisdiction", "string", [("k % 8 = 1", "'CENTRAL'"), ("true", "'TAMIL_NADU'")]),
    ("s", "portal", "string", [("k % 9 = 0", "'NSP'")]),
    ("p", "otr_generated", "boolean", [("true", "k % 2 = 1")]),
    ("p", "face_auth_available", "boolean", [("k % 3 = 1", "true")]),
    ("s", "level", "string", [("k % 10 = 3", "'pg'")]),
    ("d", "issue_date", "string", [("k % 11 = 4", "NULL"), ("true", "d.issue_date")]),
    ("d", "expiry_date", "string", [("k % 11 = 4", "NULL"), ("true", "d.expiry_date")]),
    ("d", "has_income_cert", "boolean", [("true", "k % 12 <> 5")]),
    ("d", "previous_marks", "string", [("k % 2 = 0", "'seen'")]),
]


def varied_input(t):
    rows = readiness_input(t).withColumn("k", F.col("student_id").cast("long"))
    for part, field, kind, cases_ in _VARIED:
        value = "CASE " + " ".join(f"WHEN {c} THEN CAST({v} AS {kind})" for c, v in cases_) + " END"
        rows = rows.withColumn(part, F.col(part).withField(field, F.expr(value)))
    return rows.withColumn("match_type", F.expr("CASE WHEN k % 13 = 6 THEN 'POTENTIAL MATCH' ELSE match_type END")).drop("k")


_KINDS = [
    ("IDENTITY_NAME_MISMATCH", "HIGH", "wrong > 0", "least(15, wrong * 6)"), ("IDENTITY_DOB_MISMATCH", "HIGH", "dob <> dob12", "8"),
    ("IDENTITY_INCOME_NAME_MISMATCH", "HIGH", f"income_applicant = 'student' AND {sim('full_name', 'income_holder')} < 0.70", "6"),
    ("DOCS_MISSING_REQUIRED", "MEDIUM", "miss > 0", "least(16, miss * 5)"), ("DOCS_NONE_UPLOADED", "HIGH", "miss IS NULL", "12"),
    ("DOCS_WRONG_TYPE", "HIGH", "nat = 9", "5"), ("DOCS_LOW_QUALITY", "MEDIUM", "nat = 10", "8"),
    ("DOCS_MISSING_CERT_NUMBER", "LOW", "sid % 12 <> 5 AND nat = 2", "3"), ("DOCS_MISSING_AUTHORITY", "LOW", "sid % 12 <> 5 AND nat = 4", "2"),
    ("RULE_UNVERIFIED_NOTICE", "MEDIUM", "sid % 5 = 0", "0"), ("ELIG_POTENTIAL_ONLY", "MEDIUM", "sid % 13 = 6", "0"),
    ("ELIG_NEEDS_INFO", "HIGH", "sid % 13 <> 6 AND seg = 'FURNITURE'", "0"),
    ("ELIG_UNVERIFIED_GAP", "MEDIUM", "sid % 13 <> 6 AND seg = 'HOUSEHOLD' AND sid % 5 = 0", "0"),
    ("ELIG_NOT_MATCHED", "HIGH", "sid % 13 <> 6 AND seg = 'HOUSEHOLD' AND sid % 5 <> 0", "20"),
    ("ELIG_QUOTA_UNKNOWN", "HIGH", "sid % 8 <> 1 AND bal >= 6000", "0"), ("ELIG_QUOTA_MANAGEMENT", "HIGH", "sid % 8 <> 1 AND bal < 3000", "0"),
    ("ELIG_FIRST_GRAD_UNKNOWN", "HIGH", "sid % 8 <> 1 AND bal <= 2000", "0"), ("APP_INCOME_MISMATCH", "MEDIUM", "gap", "4"),
    ("APP_CATEGORY_MISMATCH", "HIGH", "bal > 5000 AND community <> 'DNC'", "8"), ("APP_COURSE_MISMATCH", "MEDIUM", "nat = 11", "4"),
    ("APP_INSTITUTION_MISMATCH", "MEDIUM", "nat = 12", "4"), ("APP_COURSE_LEVEL_MISMATCH", "HIGH", "sid % 10 = 3", "4"),
    ("APP_DOMICILE_MISSING", "MEDIUM", "sid % 8 <> 1 AND nat >= 20", "0"),
    ("APP_DOMICILE_MISMATCH", "HIGH", "sid % 8 <> 1 AND nat >= 15 AND nat < 20", "10"),
    ("APP_DISABILITY_PERCENTAGE_BELOW_MIN", "HIGH", "sid % 3 = 0 AND (sid % 7 = 2 OR (sid % 7 = 3 AND sid % 6 = 0))", "6"),
    ("APP_DISABILITY_PERCENTAGE_UNKNOWN", "MEDIUM", "sid % 3 = 0 AND sid % 7 NOT IN (2, 3) AND (sid % 4 = 1 OR sid % 2 = 0)", "0"),
    ("APP_DISABILITY_CERT_MISSING", "HIGH", "sid % 3 = 0 AND sid % 2 <> 0", "6"),
    ("BANK_HOLDER_MISMATCH", "HIGH", f"{sim('full_name', 'bank_holder')} < 0.75", "5"), ("BANK_IFSC_INVALID", "MEDIUM", "nat = 13", "3"),
    ("BANK_AADHAAR_NOT_SEEDED", "HIGH", "nat < 5", "2"), ("BANK_AADHAAR_SEEDING_UNKNOWN", "LOW", "nat >= 15", "0"),
    ("CERT_INCOME_EXPIRED", "HIGH", "stale AND sid % 11 <> 4", "6"), ("CERT_INCOME_DATE_MISSING", "MEDIUM", "sid % 11 = 4 AND sid % 12 <> 5", "0"),
    ("WRONG_ACADEMIC_YEAR", "MEDIUM", "bal < 100", "3"), ("RENEWAL_DOC_MISSING", "MEDIUM", "bal > 9000 AND sid % 2 = 1", "0"),
    ("NSP_2026_OTR_TRACKER", "MEDIUM", "(sid % 8 = 1 OR sid % 9 = 0) AND sid % 2 = 0", "0"),
    ("NSP_2026_FACE_AUTH_DEVICE", "LOW", "(sid % 8 = 1 OR sid % 9 = 0) AND sid % 3 <> 1", "0"),
]
_RAISED = ", ".join(f"CASE WHEN {cond} THEN {{'s': {('HIGH', 'MEDIUM', 'LOW').index(severity)}, 'n': {n}, 'id': '{name}', 'severity': '{severity}',"
                    f" 'points': CAST({points} AS INT)}} END" for n, (name, severity, cond, points) in enumerate(_KINDS))


@query("readiness_findings", "RUL-08 SRT-05", f"""
WITH {_READY}, k AS (SELECT *, CAST(student_id AS BIGINT) AS sid FROM x), f AS (SELECT student_id, list_sort(list_filter([{_RAISED}], lambda z: z IS NOT NULL)) AS found FROM k)
SELECT student_id, CAST(unnest(range(len(found))) AS INT) AS place, unnest(found).id AS id, unnest(found).severity AS severity,
 unnest(found).points AS points FROM f""")
def _(t):
    """Every finding of every student, gravest first."""
    checked = readiness.readiness(varied_input(t), as_instant(AS_OF))
    return checked.select("student_id", F.posexplode_outer("findings").alias("place", "f")).where("f is not null").select(
        "student_id", "place", "f.id", "f.severity", "f.points")


@query("finding_counts", "RUL-08", f"""
WITH {_READY}, k AS (SELECT *, CAST(student_id AS BIGINT) AS sid FROM x), f AS (SELECT unnest(list_filter([{_RAISED}], lambda z: z IS NOT NULL)) AS f FROM k)
SELECT f.id AS id, f.severity AS severity, count(*) AS cases FROM f GROUP BY 1, 2""")
def _(t):
    return readiness.finding_counts(readiness.readiness(varied_input(t), as_instant(AS_OF)))


@query("missing_documents", "JOI-18", f"""
WITH {_READY} SELECT student_id, unnest(CASE WHEN miss IS NULL THEN ['Aadhaar Card', 'Class 12 Marksheet', 'Income Certificate', 'Bank Passbook']
 ELSE ['Aadhaar Card', 'Bank Passbook'] END) AS label FROM x WHERE miss IS NULL OR miss > 0""")
def _(t):
    return readiness.readiness(readiness_input(t), as_instant(AS_OF)).select("student_id", F.explode("missing_documents").alias("label"))
