"""Readiness of an application before submission: findings, six dimensions, level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions import lexicon
from stipendia.functions.names import name_similarity
from stipendia.functions.scalars import any_of, filled, first_case, is_true, present
from stipendia.functions.values import certificate_age, is_ifsc, iso_date
from stipendia.operators.frames import balanced
from stipendia.operators.eligibility import NEEDS_INFO, NOT_MATCHED, POTENTIAL

# Words that let an upload stand for a checklist label (label words, upload words).
UPLOAD_WORDS = [
    (["marksheet", "class", "12th", "10th"], ["marksheet", "twelfth", "tenth", "class"]),
    (["bank", "passbook", "statement"], ["bank", "passbook", "statement"]),
    (["bonafide", "enrollment", "college", "admission"], ["bonafide", "college", "enrollment", "admission"]),
    (["aishe", "institute"], ["aishe", "institute", "bonafide", "college"]),
    (["aadhaar", "identity"], ["aadhaar", "aadhar", "identity"]),
    (["income"], ["income"]),
    (["community", "caste", "obc", "sc", "st"], ["community", "caste"]),
    (["first graduate"], ["first_graduate", "graduate"]),
    (["disability"], ["disability"]),
]


def upload_matches(label: Column, upload: Column) -> Column:
    l, u = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(upload, F.lit("")))
    has = (lambda text, words: any_of([F.contains(text, F.lit(w)) for w in words]))
    return F.contains(l, u) | F.contains(u, l) | any_of([has(l, a) & has(u, b) for a, b in UPLOAD_WORDS])


def missing_documents(required: Column, uploaded: Column) -> Column:
    """Checklist labels without a matching upload."""
    return F.filter(required, lambda label: ~F.exists(uploaded, lambda up: upload_matches(label, up)))


def _finding(name: str, severity: Column | str, dim: str, cond: Column, points: Column | int = 0,
             unknown: bool = False) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    points = F.lit(points) if isinstance(points, int) else points
    return F.when(is_true(cond), F.struct(
        F.lit(name).alias("id"), severity.alias("severity"), F.lit(dim).alias("dim"), points.cast("int").alias("points"),
        F.lit(unknown).alias("unknown")))


def findings(as_of: Column) -> list[Column]:
    """All findings over the columns ``p`` (profile), ``d`` (documents), ``s`` (scheme) and ``match_type``."""
    p, d, s = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"d.{c}")), (lambda c: F.col(f"s.{c}"))
    student = p("student_name")
    by_student = F.coalesce(p("income_applicant"), F.lit("student")) == "student"
    off = (lambda value, limit: present(value) & present(student) & (name_similarity(student, value) < limit))
    wrong_names = F.size(F.filter(F.array(d("aadhaar_name"), d("tenth_name"), d("twelfth_name"), d("bank_holder"),
                                          d("bonafide_name")), lambda v: off(v, 0.75)))
    other_day = (lambda v: iso_date(p("dob")) != iso_date(v))
    n_missing = F.size(F.col("missing_documents"))
    has_uploads, has_list = F.size(d("uploaded_types")) > 0, F.size(s("required_documents")) > 0
    has_income, number = is_true(d("has_income_cert")), (lambda c: F.size(F.coalesce(d(c), F.array().cast("array<string>"))))
    unverified = s("rule_status") == "UNVERIFIED"
    scheme_state = F.coalesce(s("state"), F.lit("All-India"))
    jurisdiction = F.coalesce(s("jurisdiction"), F.when(s("state") == "Tamil Nadu", "TAMIL_NADU").otherwise("CENTRAL"))
    central = (jurisdiction == "CENTRAL") | (scheme_state == "All-India")
    quota = F.coalesce(p("quota_type"), F.lit("unknown"))
    top = F.greatest(p("income"), d("income")).cast("double")
    gap = F.abs(p("income") - d("income")).cast("double") / F.nullif(top, F.lit(0.0))
    group = (lambda v: F.upper(F.trim(v)))
    unlike = (lambda a, b: present(a) & present(b) & (name_similarity(a, b) < 0.60))
    level_a, level_b = F.lower(s("level")), F.lower(p("level"))
    domicile = is_true(s("domicile_required")) | ((scheme_state != "All-India") & (jurisdiction != "CENTRAL"))
    home = filled(p("state"), p("domicile"))
    needs_disability = is_true(s("requires_disability"))
    floor_ = F.coalesce(s("minimum_disability"), F.lit(40))
    share = F.coalesce(p("disability_percentage"), d("disability_percentage"))
    holder = filled(d("bank_holder"), p("bank_holder"))
    ifsc = filled(d("ifsc"), p("ifsc"))
    seeded = F.coalesce(d("aadhaar_bank_linked"), p("aadhaar_bank_linked"))
    explicit = present(d("expiry_date"))
    age = certificate_age(F.when(~explicit, d("issue_date")), d("expiry_date"), 12, as_of)
    portal = central | is_true(s("portal") == "NSP")
    low, medium, high = lexicon.SEVERITIES[2], lexicon.SEVERITIES[1], lexicon.SEVERITIES[0]
    m = F.col("match_type")
    f = _finding
    return [
        f("IDENTITY_NAME_MISMATCH", high, "identity", wrong_names > 0, F.least(F.lit(15), wrong_names * 6)),
        f("IDENTITY_DOB_MISMATCH", high, "identity", is_true(other_day(d("tenth_dob"))) | is_true(other_day(d("aadhaar_dob"))), 8),
        f("IDENTITY_INCOME_NAME_MISMATCH", high, "identity", by_student & off(d("income_name"), 0.70), 6),
        f("DOCS_MISSING_REQUIRED", F.when(n_missing >= 3, high).otherwise(medium), "documents",
          has_list & has_uploads & (n_missing > 0), F.least(F.lit(16), n_missing * 5)),
        f("DOCS_NONE_UPLOADED", high, "documents", has_list & ~is_true(has_uploads), 12),
        f("DOCS_WRONG_TYPE", high, "documents", number("wrong_types") > 0, F.least(F.lit(10), number("wrong_types") * 5)),
        f("DOCS_LOW_QUALITY", medium, "documents", number("low_quality") > 0, F.least(F.lit(8), number("low_quality") * 3)),
        f("DOCS_MISSING_CERT_NUMBER", low, "documents", has_income & ~present(d("certificate_number")), 3),
        f("DOCS_MISSING_AUTHORITY", low, "documents", has_income & ~present(d("authority")), 2),
        f("RULE_UNVERIFIED_NOTICE", medium, "eligibility", unverified, 0, True),
        f("ELIG_POTENTIAL_ONLY", medium, "eligibility", m == POTENTIAL, 0, True),
        f("ELIG_NEEDS_INFO", high, "eligibility", m == NEEDS_INFO, 0, True),
        f("ELIG_UNVERIFIED_GAP", medium, "eligibility", (m == NOT_MATCHED) & is_true(unverified), 0, True),
        f("ELIG_NOT_MATCHED", high, "eligibility", (m == NOT_MATCHED) & ~is_true(unverified), 20),
        f("ELIG_QUOTA_UNKNOWN", high, "eligibility", ~central & is_true(s("requires_govt_quota")) & (quota == "unknown"), 0, True),
        f("ELIG_QUOTA_MANAGEMENT", high, "eligibility", ~central & is_true(s("requires_govt_quota")) & (quota == "management")),
        f("ELIG_FIRST_GRAD_UNKNOWN", high, "eligibility",
          ~central & is_true(s("requires_first_graduate")) & p("first_graduate").isNull(), 0, True),
        f("APP_INCOME_MISMATCH", medium, "application", gap > 0.15, 4),
        f("APP_CATEGORY_MISMATCH", high, "application", present(p("category")) & present(d("category"))
          & (group(p("category")) != group(d("category"))), 8),
        f("APP_COURSE_MISMATCH", medium, "application", unlike(p("course"), filled(d("course"), d("twelfth_course"))), 4),
        f("APP_INSTITUTION_MISMATCH", medium, "application", unlike(p("institution"), d("institution")), 4),
        f("APP_COURSE_LEVEL_MISMATCH", high, "application", present(s("level")) & present(p("level"))
          & ~F.contains(level_a, level_b) & ~F.contains(level_b, level_a), 4),
        f("APP_DOMICILE_MISSING", medium, "application", domicile & home.isNull(), 0, True),
        f("APP_DOMICILE_MISMATCH", high, "application", domicile & (scheme_state != "All-India")
          & (F.lower(home) != F.lower(scheme_state)), 10),
        f("APP_DISABILITY_PERCENTAGE_BELOW_MIN", high, "application", needs_disability & (share < floor_), 6),
        f("APP_DISABILITY_PERCENTAGE_UNKNOWN", medium, "application", needs_disability & share.isNull()
          & (is_true(p("disability")) | is_true(d("disability_cert"))), 0, True),
        f("APP_DISABILITY_CERT_MISSING", high, "application", needs_disability & ~is_true(d("disability_cert")), 6),
        f("BANK_HOLDER_MISMATCH", high, "bank", off(holder, 0.75), 5),
        f("BANK_IFSC_INVALID", medium, "bank", ifsc.isNotNull() & ~is_ifsc(ifsc), 3),
        f("BANK_AADHAAR_NOT_SEEDED", high, "bank", ~seeded, 2),
        f("BANK_AADHAAR_SEEDING_UNKNOWN", low, "bank", seeded.isNull(), 0, True),
        f("CERT_INCOME_EXPIRED", high, "certificates", age["expired"], 6),
        f("CERT_INCOME_DATE_MISSING", medium, "certificates", has_income & ~explicit & ~present(d("issue_date")), 0, True),
        f("WRONG_ACADEMIC_YEAR", medium, "certificates", s("academic_year") != p("academic_year"), 3),
        f("RENEWAL_DOC_MISSING", medium, "certificates", is_true(p("is_renewal")) & present(s("renewal_conditions"))
          & ~present(d("previous_marks")), 0, True),
        f("NSP_2026_OTR_TRACKER", medium, "certificates", portal & ~is_true(p("otr_generated")), 0, True),
        f("NSP_2026_FACE_AUTH_DEVICE", low, "certificates", portal & ~is_true(p("face_auth_available")), 0, True),
    ]


def _where(found: str, key: str, value: str) -> Column:
    return F.filter(found, lambda x: x[key] == value)


def readiness(rows: DataFrame, as_of: Column) -> DataFrame:
    """Findings by severity, score per dimension, total and level.

    Only the findings that hold are kept in the array; a dimension never falls
    below zero.
    """
    keys = [c for c in rows.columns if c not in ("p", "d", "s", "match_type")]
    uploads = F.coalesce("d.uploaded_types", F.array().cast("array<string>"))
    rows = balanced(rows).withColumn("missing_documents", missing_documents(F.col("s.required_documents"), uploads))
    raised = F.filter(F.array(*findings(as_of)), lambda x: x.isNotNull())
    rows = rows.withColumn("_found", raised)
    by_severity = F.flatten(F.array(*[_where("_found", "severity", s) for s in lexicon.SEVERITIES]))
    rows = rows.withColumn("findings", by_severity)
    dims = {}
    for dim, top in lexicon.READINESS_MAX.items():
        lost = F.aggregate(_where("findings", "dim", dim), F.lit(0), lambda a, x: a + x["points"])
        dims[f"{dim}_score"] = F.greatest(F.lit(0), F.lit(top) - lost)
    rows = rows.withColumns(dims)
    rows = rows.withColumn("total", sum((F.col(c) for c in list(dims)[1:]), F.col(list(dims)[0]))).withColumn(
        "unknown_required", F.exists("findings", lambda x: x["unknown"]))
    return rows.select(*keys, *dims, "total", "unknown_required", level(F.col("total"), F.col("unknown_required")).alias("level"),
                       "findings", "missing_documents")


def level(score: Column, unknown: Column) -> Column:
    return first_case([
        (unknown & (score >= lexicon.REVIEW_AT), "NEEDS_CONFIRMATION"), (score >= lexicon.READY_AT, "READY_TO_SUBMIT"),
        (score >= lexicon.REVIEW_AT, "REVIEW_BEFORE_SUBMIT"), (score >= lexicon.CORRECT_AT, "CORRECTIONS_NEEDED")], "NOT_READY")


def finding_counts(checked: DataFrame) -> DataFrame:
    """Cases per finding.

    The outer generator keeps the optimizer from adding a not-empty filter,
    which would evaluate every finding a second time.
    """
    raised = checked.select(F.inline_outer("findings")).where(F.col("id").isNotNull())
    return raised.groupBy("id", "severity").agg(F.count(F.lit(1)).alias("cases"))
