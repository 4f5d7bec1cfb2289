"""Agreement inside a case: names, dates, incomes, validity, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions.names import letters_key, name_similarity, name_tokens, with_name_match
from stipendia.functions.scalars import (first_case, half_up, is_true, kept, percent, present)
from stipendia.functions.values import (certificate_age, compare_birth_dates, compare_communities, compare_incomes,
                                        confidence_band, income_freshness, is_ifsc, iso_date, months_since, parse_date)
from stipendia.operators.frames import balanced, spread_join

MINOR = ["MINOR_DIFFERENCE", "LIKELY_MATCH", "NEEDS_REVIEW"]


# --- pairs of a case -----------------------------------------------------------------------------

def pair_verdicts(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Whether any two values under one key contradict or differ slightly.

    Equal values are merged first.  Every value is then compared with one
    anchor of its key, which is linear; a key with a contradiction is settled
    by that.  Only the remaining keys, whose values all resemble the anchor,
    need their values compared with each other, spread over many tasks.
    """
    keyed = (values.where(present(F.col(value))).withColumn("_key", F.array_join(name_tokens(F.col(value)), " "))
             .where(F.col("_key") != ""))
    groups = keyed.groupBy(*keys, "_key").agg(F.min(value).alias("_name"))
    anchors = groups.groupBy(*keys).agg(F.min_by("_name", "_key").alias("_anchor"), F.min("_key").alias("_first"),
                                        F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)

    def flags(compared: DataFrame, *more) -> DataFrame:
        return compared.groupBy(*keys).agg(F.max(F.col("pair_status") == "MISMATCH").alias("mismatch"),
                                           F.max(F.col("pair_status").isin(MINOR)).alias("minor"), *more)

    others = groups.join(anchors, keys).where(F.col("_key") != F.col("_first"))
    first = flags(with_name_match(others, "_anchor", "_name", False, "pair"), F.max("_n").alias("_n"))
    open_keys = first.where(~F.col("mismatch") & (F.col("_n") > 2)).select(*keys)
    rest = others.join(open_keys, keys, "left_semi").select(*keys, "_key", "_name")
    right = rest.select(*keys, F.col("_key").alias("_key2"), F.col("_name").alias("_name2"))
    pairs = spread_join(rest, right, keys, ["_key"]).where(F.col("_key") < F.col("_key2"))
    second = flags(with_name_match(pairs, "_name", "_name2", False, "pair"))
    return first.drop("_n").unionByName(second).groupBy(*keys).agg(
        F.max("mismatch").alias("mismatch"), F.max("minor").alias("minor"))


def _usable(col: Column) -> Column:
    return present(col) & ~F.lower(F.trim(col)).isin("null", "not_detected")


def evaluate_cases(documents: DataFrame, case: str = "case_id") -> DataFrame:
    """Status of each case over names, birth dates and parents.

    Input columns: case, doc_type, name, dob, parent_name.  Two dates
    contradict when the smallest and the largest parsed date differ, so dates
    need no pairs at all.
    """
    name, parent = _usable(F.col("name")), _usable(F.col("parent_name")) & (F.col("doc_type") != "income")
    day = F.when(_usable(F.col("dob")), iso_date(F.col("dob")))
    counts = documents.groupBy(case).agg(
        F.count_if(name | present(F.col("dob"))).alias("documents"), F.count_if(name).alias("named"),
        F.count_if(_usable(F.col("dob"))).alias("dated"), F.count_if(parent).alias("parented"),
        F.min(day).alias("_d1"), F.max(day).alias("_d2"))
    kinds = F.array(F.struct(F.lit("own").alias("_kind"), F.when(name, F.col("name")).alias("_value")),
                    F.struct(F.lit("parent").alias("_kind"), F.when(parent, F.col("parent_name")).alias("_value")))
    verdicts = pair_verdicts(documents.select(case, F.inline(kinds)), [case, "_kind"], "_value")
    own = (lambda kind, c: F.max(F.when(F.col("_kind") == kind, F.col(c))))
    flags = verdicts.groupBy(case).agg(own("own", "mismatch").alias("mismatch"), own("own", "minor").alias("minor"),
                                       own("parent", "mismatch").alias("p_mismatch"), own("parent", "minor").alias("p_minor"))
    rows = counts.join(flags, case, "left").fillna(False, ["mismatch", "minor", "p_mismatch", "p_minor"])
    rows = rows.withColumn("dob_conflict", is_true(F.col("_d1") != F.col("_d2")))
    short = (F.col("documents") < 2) | (F.col("named") < 2)
    conflict = F.col("mismatch") | F.col("p_mismatch") | F.col("dob_conflict")
    minor = F.col("minor") | F.col("p_minor")
    lacking = F.lit("INSUFFICIENT DATA")
    verdict = first_case([(conflict, "SIGNIFICANT CONFLICT"), (minor, "MINOR DIFFERENCE")], "CONSISTENT")
    return rows.select(
        case, "documents", F.when(short, lacking).otherwise(verdict).alias("status"),
        F.when(short | (F.col("dated") < 2), lacking).when(F.col("dob_conflict"), "SIGNIFICANT CONFLICT").otherwise(
            "CONSISTENT").alias("dob_status"),
        F.when(short, lacking).when(F.col("p_mismatch"), "SIGNIFICANT CONFLICT").when(F.col("p_minor"), "MINOR DIFFERENCE")
        .when(F.col("parented") < 2, lacking).otherwise("CONSISTENT").alias("parent_status"))


# --- consensus -----------------------------------------------------------------------------------

def consensus_names(documents: DataFrame, case: str = "case_id") -> DataFrame:
    """Most frequent name of a case after digit repair, with the doubt it leaves.

    Input columns: case, position, name, confidence.
    """
    rows = documents.where(present(F.col("name"))).withColumn("_key", letters_key(F.trim("name"))).where(
        F.length("_key") >= 3).withColumn("_digits", F.col("name").rlike(r"\d"))
    clean_first = F.struct(F.col("_digits"), F.col("position"))
    groups = rows.groupBy(case, "_key").agg(
        F.count(F.lit(1)).alias("agreements"), F.min("position").alias("_pos"), F.max("_digits").alias("_repaired"),
        F.min_by(F.struct("name", "_digits", "confidence"), clean_first).alias("_show"))
    best = groups.groupBy(case).agg(
        F.max_by(F.struct("_key", "agreements", "_repaired", "_show"), F.struct("agreements", -F.col("_pos"))).alias("_b"),
        F.sum("agreements").alias("documents"))
    far = groups.join(best, case).where(F.levenshtein(F.col("_key"), F.col("_b._key")) > 2).select(case).distinct()
    out = best.join(far.withColumn("conflict", F.lit(True)), case, "left").fillna(False, ["conflict"])
    shown = F.col("_b._show.name")
    digits = F.col("_b._show._digits")
    several = F.col("_b.agreements") >= 2
    doubt = F.when(several, F.col("_b._repaired")).otherwise(digits)
    status = first_case([(F.col("conflict") | doubt, "NEEDS_REVIEW")], "HIGH_CONFIDENCE")
    confidence = first_case([
        (F.col("conflict"), F.lit(60)), (several, F.least(F.lit(98), 85 + F.col("_b.agreements") * 4)),
        (digits, F.lit(68))], half_up(F.coalesce(F.col("_b._show.confidence").cast("double"), F.lit(80.0))))
    fixed = F.translate(shown, "0158", "OISB")
    return out.select(case, F.when(digits, fixed).otherwise(shown).alias("consensus_name"), status.alias("status"),
                      confidence.cast("long").alias("confidence"), F.col("_b.agreements").alias("agreements"),
                      "documents", "conflict")


def reconcile_passes(passes: DataFrame, fields: list[str]) -> DataFrame:
    """One record per document from several extraction passes.

    The name wins by confidence plus a boost for agreement, marks and school by
    confidence, every field of ``fields`` is the first one seen.
    """
    key = F.regexp_replace(F.lower("name"), "[^a-z]", "")
    agree = passes.where(present(F.col("name"))).groupBy("doc_id", key.alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("name", "name_confidence"), F.struct(
            F.coalesce("name_confidence", F.lit(0.75)), -F.col("pass_no"))).alias("_top"), F.min("pass_no").alias("_pos"))
    score = F.coalesce("_top.name_confidence", F.lit(0.75)) + F.when(F.col("_n") >= 2, 0.20).otherwise(0.0)
    names = agree.withColumn("_score", score).groupBy("doc_id").agg(
        F.max_by(F.struct(F.col("_top.name").alias("name"), "_score"), F.struct("_score", -F.col("_pos"))).alias("_w"))

    def strongest(column: str, confidence: str) -> Column:
        order = F.when(F.col(column).isNotNull(), F.struct(F.coalesce(confidence, F.lit(0.0)), -F.col("pass_no")))
        return F.max_by(column, order).alias(column)

    def first_seen(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("pass_no"))).alias(column)

    merged = passes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("passes"), strongest("marks", "marks_confidence"),
                                          strongest("school", "school_confidence"), *[first_seen(f) for f in fields])
    return merged.join(names, "doc_id", "left").select(
        "doc_id", "passes", F.col("_w.name").alias("name"),
        F.least(F.lit(0.98), F.floor(F.col("_w._score") * 100.0 + 0.5) / 100.0).alias("name_confidence"), "marks", "school",
        *fields)


def agreed_candidate(candidates: DataFrame) -> DataFrame:
    """Name over passes that is only accepted on agreement or high confidence."""
    key = F.regexp_replace(F.upper("name"), "[^A-Z0-9]", "")
    groups = candidates.groupBy("doc_id", key.alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("confidence").alias("_c"), F.min("pass_no").alias("_pos"),
        F.max_by("name", F.struct("confidence", -F.col("pass_no"))).alias("_name"))
    best = groups.groupBy("doc_id").agg(F.sum("_n").alias("_all"), F.max_by(
        F.struct("_n", "_c", "_name"), F.struct("_n", -F.col("_pos"))).alias("_b"))
    agreed, sure = F.col("_b._n") >= 2, F.col("_b._c") >= 75
    status = first_case([((F.col("_all") >= 2) & ~agreed, "NOT_DETECTED"), (sure, "HIGH_CONFIDENCE"),
                         (agreed, "NEEDS_REVIEW")], "NOT_DETECTED")
    return best.select("doc_id", status.alias("status"), F.when(status != "NOT_DETECTED", F.col("_b._name")).alias("name"),
                       F.when(status != "NOT_DETECTED", F.col("_b._c")).alias("confidence"))


def assembled(sources: list[tuple[str, Column, Column]]) -> Column:
    """struct(value, source, confidence, band) of the first source that has a value."""
    none = F.lit(None)
    picked = F.coalesce(*[F.when(present(value.cast("string")), F.struct(
        value.cast("string").alias("value"), F.lit(name).alias("source"), conf.cast("int").alias("confidence"),
        confidence_band(conf).alias("band"))) for name, value, conf in sources])
    return F.coalesce(picked, F.struct(none.cast("string").alias("value"), none.cast("string").alias("source"),
                                       none.cast("int").alias("confidence"), none.cast("string").alias("band")))


# --- consistency score ---------------------------------------------------------------------------

def name_pairs(cases: DataFrame) -> DataFrame:
    """Unordered pairs of the name sources of one case row (six sources at most)."""
    src = F.col("name_sources")
    pairs = F.flatten(F.transform(src, lambda a, i: F.transform(
        F.slice(src, i + 2, F.size(src)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    flat = cases.select("case_id", F.explode_outer(pairs).alias("p")).where(F.col("p").isNotNull()).select(
        "case_id", F.col("p.a.source").alias("source_a"), F.col("p.b.source").alias("source_b"),
        F.col("p.a.name").alias("name_a"), F.col("p.b.name").alias("name_b"),
        (F.col("p.a.strict") | F.col("p.b.strict")).alias("strict"))
    return with_name_match(flat, "name_a", "name_b", F.col("strict"), "pair")


def consistency_score(cases: DataFrame, as_of: Column) -> DataFrame:
    """Score of 100 over names, birth date, income, community and bank account.

    Input columns: case_id, aadhaar_name, aadhaar_dob, community_name, community_dob,
    income_name, income_dob, tenth_name, tenth_dob, twelfth_name, twelfth_dob,
    bank_holder, account_type, relationship, parent_reference, cert_income, entered_income,
    issue_date, valid_upto, expiry_confirmed, window_months, cert_community,
    entered_community, has_aadhaar, has_bank, has_tenth, has_twelfth,
    has_community, has_income.
    """
    c = F.col
    own_income = c("has_income") & (c("relationship") == "Self")

    def source(name: str, value: str, applies: Column, strict: bool, document: Column) -> tuple[Column, Column]:
        return applies & present(c(value)), F.struct(
            F.lit(name).alias("source"), F.trim(c(value)).alias("name"), F.lit(strict).alias("strict"),
            document.alias("document"))

    yes = F.lit(True)
    rows = balanced(cases).withColumn("name_sources", kept([
        source("aadhaar", "aadhaar_name", yes, True, c("has_aadhaar")),
        source("community", "community_name", c("has_community"), True, yes),
        source("income", "income_name", own_income, True, yes),
        source("tenth", "tenth_name", c("has_tenth"), False, yes),
        source("twelfth", "twelfth_name", c("has_twelfth"), False, yes),
        source("bank", "bank_holder", yes, True, c("has_bank"))]))
    pairs = name_pairs(rows).groupBy("case_id").agg(
        F.max(c("pair_status") == "MISMATCH").alias("name_mismatch"), F.max(c("pair_status").isin(MINOR)).alias("name_minor"))
    rows = rows.join(pairs, "case_id", "left").fillna(False, ["name_mismatch", "name_minor"])
    rows = with_name_match(rows, "income_name", "parent_reference", True, "parent")
    by_parent = c("has_income") & present(c("income_name")) & (c("relationship") != "Self")
    parent_ok = (c("relationship") == "Parent") & present(c("parent_reference")) & c("parent_status").isin(
        "EXACT_MATCH", "LIKELY_MATCH")
    rows = rows.withColumn("parent_unsure", is_true(by_parent & ~parent_ok))
    dobs = [("has_community", "community_dob"), ("has_tenth", "tenth_dob"), ("has_twelfth", "twelfth_dob")]
    checks = [F.when(c(h) & present(c(d)), compare_birth_dates(c(d), c("aadhaar_dob"))) for h, d in dobs]
    checks.append(F.when(own_income & present(c("income_dob")), compare_birth_dates(c("income_dob"), c("aadhaar_dob"))))
    rows = rows.withColumn("_dob", F.filter(F.array(*checks), lambda s: s.isNotNull()))
    has_dob = (c("has_aadhaar") & present(c("aadhaar_dob"))) | (c("has_tenth") & present(c("tenth_dob"))) | (
        c("has_twelfth") & present(c("twelfth_dob"))) | (c("has_community") & present(c("community_dob")))
    dob_state = first_case([
        (~is_true(has_dob), "NOT_CHECKED"), (~present(c("aadhaar_dob")), "PENDING"),
        (F.array_contains("_dob", "MISMATCH"), "FAIL"), (F.array_contains("_dob", "MATCH"), "PASS")], "PENDING")
    fresh = income_freshness(c("issue_date"), c("valid_upto"), c("expiry_confirmed"), c("window_months"), as_of)
    rows = rows.withColumn("dob_state", dob_state).withColumn("freshness", fresh)
    rows = rows.withColumn("income_status", compare_incomes(c("cert_income"), c("entered_income"), c("freshness"))).withColumn(
        "community_status", compare_communities(c("cert_community"), c("entered_community")))
    documents = F.size(F.filter("name_sources", lambda s: s["document"]))
    uploaded = sum((c(h).cast("int") for h in ("has_tenth", "has_twelfth", "has_community", "has_income", "has_aadhaar")),
                   c("has_bank").cast("int"))
    name_state = first_case([(documents < 2, "NOT_CHECKED"), (c("name_mismatch"), "FAIL"),
                             (c("name_minor") | c("parent_unsure"), "WARN")], "PASS")
    income_match = c("income_status") == "MATCH"
    income_state = first_case([
        (~c("has_income"), "NOT_CHECKED"), (income_match & c("freshness").isin("valid", "needs_confirmation", "unknown"), "PASS"),
        (income_match & c("freshness").isin("warning", "outside_window"), "WARN"),
        ((c("income_status") == "EXPIRED") | (c("freshness") == "expired") | (c("income_status") == "MISMATCH"), "FAIL")], "PENDING")
    community_state = first_case([(~c("has_community"), "NOT_CHECKED"), (c("community_status") == "MATCH", "PASS"),
                                  (c("community_status") == "MISMATCH", "FAIL")], "PENDING")
    bank_state = first_case([(~c("has_bank"), "NOT_CHECKED"), (c("account_type") == "Single", "PASS"),
                             (c("account_type") == "Joint", "FAIL")], "PENDING")
    rows = rows.withColumns({"uploaded": uploaded, "name_state": name_state, "income_state": income_state,
                             "community_state": community_state, "bank_state": bank_state})

    def points(state: str, full: int, warn: int = 0) -> Column:
        return F.when(c(state) == "PASS", full).when(c(state) == "WARN", warn).otherwise(0)

    rows = rows.withColumn("score", points("name_state", 30, 20) + points("dob_state", 20) + points("income_state", 20, 15)
                           + points("community_state", 15) + points("bank_state", 15))
    wrong = c("name_mismatch") | (c("dob_state") == "FAIL") | is_true(c("account_type") == "Joint") | (
        c("income_status") == "EXPIRED") | (c("community_status") == "MISMATCH")
    label = first_case([(c("uploaded") < 2, "Partial"), (wrong, "Correction required"), (c("score") >= 85, "High"),
                        (c("score") >= 60, "Moderate")], "Needs review")
    return rows.select("case_id", "uploaded", "name_state", "dob_state", "income_state", "community_state", "bank_state",
                       "income_status", "community_status", "freshness", "parent_unsure", "score", label.alias("label"))


# --- application against documents ---------------------------------------------------------------

def compared_fields(cases: DataFrame) -> DataFrame:
    """Application value against document value, one row per compared field.

    Input columns: case_id, student_name, parent_name, income_applicant, doc_name,
    dob, doc_dob, category, doc_category, income, doc_income, income_holder,
    bank_holder, state, doc_state.
    """
    c = F.col

    def by_similarity(a: Column, b: Column, match: float, minor: float | None = None) -> Column:
        sim = name_similarity(a, b)
        cases_ = [(~present(b), "MISSING"), (sim >= match, "MATCH")]
        return first_case(cases_ + ([(sim >= minor, "MINOR_DIFFERENCE")] if minor else []), "MISMATCH")

    gap = F.abs(c("income") - c("doc_income")).cast("double")
    top = F.greatest("income", "doc_income").cast("double")
    income = first_case([(c("doc_income").isNull(), "MISSING"), (c("income").isNull(), "MISSING"), (gap == 0, "MATCH"),
                         ((top > 0) & (gap / F.nullif(top, F.lit(0.0)) <= 0.10), "MINOR_DIFFERENCE")], "MISMATCH")
    same_day = iso_date(c("dob")) == iso_date(c("doc_dob"))
    by_parent = c("income_applicant") == "parent"
    provider = F.when(by_parent, first_case([(~present(c("parent_name")), "MISSING")], by_similarity(
        c("parent_name"), c("income_holder"), 0.75))).when(
        present(c("income_holder")) & present(c("student_name")), by_similarity(c("student_name"), c("income_holder"), 0.75))
    group = (lambda v: F.upper(F.trim(v)))
    fields = {
        "name": by_similarity(c("student_name"), c("doc_name"), 0.90, 0.75),
        "date_of_birth": first_case([(~present(c("doc_dob")), "MISSING"), (is_true(same_day), "MATCH")], "MISMATCH"),
        "category": first_case([(~present(c("doc_category")), "MISSING"),
                                (is_true(group(c("category")) == group(c("doc_category"))), "MATCH")], "MISMATCH"),
        "income": income, "income_provider": provider,
        "bank_holder": by_similarity(c("student_name"), c("bank_holder"), 0.75),
        "state": F.when(present(c("state")) & present(c("doc_state")), F.when(
            F.lower("state") == F.lower("doc_state"), "MATCH").otherwise("MISMATCH")),
    }
    long = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("status")) for n, v in fields.items()])
    return cases.select("case_id", F.inline(long)).where(F.col("status").isNotNull())


def document_matrix(cases: DataFrame, as_of: Column) -> DataFrame:
    """Extracted values of a case side by side, grouped by theme."""
    c = F.col
    names = F.filter(F.array("aadhaar_name", "tenth_name", "twelfth_name", "bank_holder", "bonafide_name"),
                     lambda v: present(v))
    rows = cases.withColumn("_names", names)
    differs = F.exists("_names", lambda v: name_similarity(F.get("_names", 0), v) < 0.75)
    days = present(c("tenth_dob")) & present(c("aadhaar_dob"))
    status = (lambda bad: F.when(bad, "MISMATCH").otherwise("MATCH"))
    gender = F.when(present(c("gender")) & present(c("doc_gender")), status(F.lower("gender") != F.lower("doc_gender"))
                    ).otherwise("UNCONFIRMED")
    return rows.select(
        "case_id",
        F.struct(status((F.size("_names") > 1) & differs).alias("name"), status(is_true(days & (
            iso_date(c("tenth_dob")) != iso_date(c("aadhaar_dob"))))).alias("dob"), gender.alias("gender")).alias("identity"),
        F.struct(F.coalesce("twelfth_marks", "tenth_marks").alias("marks"), F.coalesce("twelfth_board", "tenth_board").alias("board")
                 ).alias("academic"),
        F.struct(c("cert_community").alias("category"), certificate_age(c("community_issue_date"), F.lit(None).cast("string"), 60,
                                                                        as_of)["expired"].alias("expired")).alias("social"),
        F.struct(c("cert_income").alias("amount"), F.when(c("income_applicant") == "parent", F.coalesce("parent_name", F.lit("Parent"))
                                                          ).otherwise(F.coalesce("student_name", F.lit("Student"))).alias("provider"),
                 certificate_age(c("issue_date"), F.lit(None).cast("string"), 12, as_of)["expired"].alias("expired")).alias("financial"),
        F.struct(c("bank_holder").alias("holder"), F.when(present(c("ifsc")), is_ifsc(c("ifsc"))).alias("ifsc_valid")).alias("bank"),
        F.struct("state", "district").alias("residence"))


def income_name_check(cases: DataFrame) -> DataFrame:
    """Parent-income mode skips the student name and compares the parent instead."""
    rows = with_name_match(cases, "parent_name", "income_holder", False, "parent")
    parent = F.col("income_applicant") == "parent"
    return rows.select(
        "case_id", F.when(parent, "SKIPPED").otherwise("CHECKED").alias("student_name_check"), parent.alias("parent_name_used"),
        F.when(parent & (F.col("parent_status") != "MISSING"), F.col("parent_status")).alias("parent_match"),
        F.when(parent, is_true(F.col("parent_status") == "EXACT_MATCH")).alias("parent_consistent"))


# --- validity ------------------------------------------------------------------------------------

# Acceptance rules (rule, scheme, year, document type, window months, permanent).
VALIDITY_RULES = [
    ("RULE-PMS-SC-INC-2025", "pms-sc", "2025-26", "income", 12, False),
    ("RULE-PMS-ST-INC-2025", "pms-st", "2025-26", "income", 12, False),
    ("RULE-PMS-OBC-INC-2025", "pms-obc", "2025-26", "income", 12, False),
    ("RULE-CSSS-INC-2025", "csss", "2025-26", "income", 12, False),
    ("RULE-TN-BC-INC-2025", "tn-bc-mbc", "2025-26", "income", 12, False),
    ("RULE-COMMUNITY-PERMANENT", "all", "2025-26", "community", None, True),
    ("RULE-MARKSHEET-PERMANENT", "all", "2025-26", "marksheet", None, True),
]


def validity_rules(spark) -> DataFrame:
    return spark.createDataFrame(VALIDITY_RULES, "rule_id string, scheme_id string, application_year string, "
                                 "document_type string, window_months int, permanent boolean")


def with_validity_rule(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """Exact rule of scheme, type and year, else the general rule of the type."""
    kind = F.lower("doc_type")
    docs = documents.withColumn("document_type", first_case([
        (F.contains(kind, F.lit("income")), F.lit("income")), (F.contains(kind, F.lit("communit")), F.lit("community")),
        (F.contains(kind, F.lit("mark")) | F.startswith(kind, F.lit("ms")), F.lit("marksheet"))], kind))
    picked = F.struct("rule_id", "window_months", "permanent")
    exact = rules.where(F.col("scheme_id") != "all").select("scheme_id", "document_type", "application_year", picked.alias("_exact"))
    general = rules.where(F.col("scheme_id") == "all").select("document_type", picked.alias("_general"))
    rows = docs.join(exact, ["scheme_id", "document_type", "application_year"], "left").join(general, "document_type", "left")
    return rows.withColumn("rule", F.coalesce("_exact", "_general")).drop("_exact", "_general")


def document_validity(documents: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Expiry and acceptance window of a document as two separate statements, and the overall status."""
    rows = with_validity_rule(documents, rules)
    today = as_of.cast("date")
    upto, issued = parse_date(F.col("valid_upto")), parse_date(F.col("issue_date"))
    lasting = is_true(F.col("rule.permanent")) | F.col("document_type").isin("community", "marksheet")
    rows = rows.withColumn("_upto", upto).withColumn("_age", months_since(issued, as_of))
    expiry = first_case([
        (present(F.col("valid_upto")) & (F.col("_upto").isNull() | ~is_true(F.col("expiry_confirmed"))), "NEEDS_CONFIRMATION"),
        (F.col("_upto") < today, "EXPIRED"), (F.date_diff(F.col("_upto"), today) <= 30, "EXPIRING_SOON"),
        (F.col("_upto").isNotNull(), "NOT_EXPIRED"), (lasting, "PERMANENT_RECORD")], "UNKNOWN_VALIDITY")
    window = F.col("rule.window_months")
    acceptance = first_case([
        (F.col("rule").isNull(), "NEEDS_CONFIRMATION"), (lasting, "WITHIN_WINDOW"),
        ((F.col("document_type") == "income") & (F.col("_age").isNull() | (F.col("_age") < 0)), "NEEDS_CONFIRMATION"),
        ((F.col("document_type") == "income") & (F.col("_age") > window), "OUTSIDE_WINDOW"),
        ((F.col("document_type") == "income") & (F.col("_age") > window / 2), "WITHIN_WINDOW_CAUTION")], "WITHIN_WINDOW")
    rows = rows.withColumn("expiry_status", expiry).withColumn("acceptance_status", acceptance)
    status = first_case([
        (F.col("expiry_status") == "EXPIRED", "expired"), (F.col("acceptance_status") == "OUTSIDE_WINDOW", "outside_window"),
        (F.col("rule").isNull() | (F.col("acceptance_status") == "NEEDS_CONFIRMATION")
         | (F.col("expiry_status") == "NEEDS_CONFIRMATION"), "needs_confirmation")], "valid")
    return rows.withColumn("validity", status).withColumn("rule_id", F.col("rule.rule_id")).drop("rule", "_upto", "_age")


# --- preparation ---------------------------------------------------------------------------------

def preparation_audit(cases: DataFrame) -> DataFrame:
    """Ten checks, applicable or not, and the share of applicable checks completed.

    Input columns: case_id, communities array, max_income, has_* and read_* flags for
    marksheet, income and community, aadhaar_name, aadhaar_dob, has_aadhaar, bank_holder,
    account_type, name_state, dob_state, community_status, validity, confirmed_name,
    confirmed_dob, confirmed_income, confirmed_community.
    """
    c = F.col
    for_group = is_true(c("communities").isNotNull() & ~F.array_contains("communities", "GEN")
                        & ~F.array_contains("communities", "All"))
    for_income = is_true(c("max_income") < 999_999_999)
    identity = (present(c("aadhaar_name")) & present(c("aadhaar_dob"))) | is_true(c("has_aadhaar"))
    bank = is_true(c("account_type") == "Single") & present(c("bank_holder"))
    yes = F.lit(True)

    def settled(state: str, confirmed: str) -> Column:
        return (c(state) != "FAIL") & (is_true(c(confirmed)) | ((c(state) == "PASS") & identity))

    listed = [
        ("marksheet", yes, is_true(c("has_marksheet") & c("read_marksheet"))),
        ("income", for_income, is_true(c("has_income") & c("read_income"))),
        ("community", for_group, is_true(c("has_community") & c("read_community"))),
        ("identity", yes, identity), ("bank", yes, bank),
        ("name_consistency", yes, settled("name_state", "confirmed_name")),
        ("dob_consistency", yes, settled("dob_state", "confirmed_dob")),
        ("validity", for_income, is_true((c("validity") == "valid") & c("has_income"))),
        ("community_consistency", for_group, is_true((c("community_status") == "MATCH") | (
            is_true(c("confirmed_community")) & (c("community_status") != "MISMATCH")))),
        ("confirmation", yes, is_true(c("confirmed_name")) & (~for_income | is_true(c("confirmed_income")))
         & (~for_group | is_true(c("confirmed_community")))),
    ]
    checks = F.array(*[F.struct(F.lit(n).alias("check"), a.alias("applicable"), d.alias("completed")) for n, a, d in listed])
    rows = cases.withColumn("checks", checks)
    rows = rows.withColumn("applicable", F.size(F.filter("checks", lambda x: x["applicable"]))).withColumn(
        "completed", F.size(F.filter("checks", lambda x: x["applicable"] & x["completed"])))
    open_items = F.transform(F.filter("checks", lambda x: x["applicable"] & ~x["completed"]), lambda x: x["check"])
    return rows.select("case_id", "applicable", "completed", percent(c("completed"), c("applicable")).alias("score"),
                       F.array_distinct(open_items).alias("next_actions"), "checks")

