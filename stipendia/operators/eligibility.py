"""Matching students to schemes, selection lists and rule-change impact."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions import lexicon
from stipendia.functions.scalars import first_case, is_true, kept, not_equal_or_missing, percent, present
from stipendia.functions.values import accepts_community, restricted
from stipendia.operators import rule_index
from stipendia.operators.frames import count_if, top_per_key, with_each_rule

CONFIRMED, POTENTIAL = "CONFIRMED MATCH", "POTENTIAL MATCH"
NEEDS_INFO, NOT_MATCHED = "NEEDS MORE INFORMATION", "NOT MATCHED"
ORDER = {CONFIRMED: 3, POTENTIAL: 2, NEEDS_INFO: 1, NOT_MATCHED: 0}

def _criterion(name: str, applies: Column, unknown: Column, failed: Column, required: Column,
               actual: Column) -> tuple[Column, Column]:
    """One criterion as status and struct, both NULL when the scheme does not ask for it.

    An unknown answer is decided before a failed one, so that it never turns
    into a refusal.
    """
    asked = is_true(applies)
    status = first_case([(is_true(unknown), "NEEDS_INFO"), (is_true(failed), "FAILED")], "PASSED")
    shown = F.coalesce(actual.cast("string"), F.lit("Not Provided"))
    wanted = required.cast("string")
    verdict = first_case([(is_true(unknown), "is needed for"), (is_true(failed), "does not meet")], "meets")
    return F.when(asked, status), F.when(asked, F.struct(
        F.lit(name).alias("criterion"), status.alias("status"), wanted.alias("required"), shown.alias("actual"),
        F.concat_ws(" ", shown, verdict, wanted).alias("reason")))


def _either(cond: Column, one: tuple[Column, Column], other: tuple[Column, Column]) -> tuple[Column, Column]:
    return F.when(cond, one[0]).otherwise(other[0]), F.when(cond, one[1]).otherwise(other[1])


def _flag(name: str, rule: Column, answer: Column, required: str) -> tuple[Column, Column]:
    return _criterion(name, is_true(rule), answer.isNull(), ~answer, F.lit(required), answer)


def criteria(student: str = "student", scheme: str = "scheme") -> list[tuple[Column, Column]]:
    """Status and details of the twelve criteria, NULL where the scheme does not ask."""
    p, s = (lambda c: F.col(f"{student}.{c}")), (lambda c: F.col(f"{scheme}.{c}"))
    capped = s("income_limit").isNotNull() & (s("income_limit") != lexicon.NO_INCOME_CAP)
    local = restricted(s("state"), "All", "All-India", "All-India / National")
    lower_differs = (lambda c: F.lower(s(c)) != F.lower(p(c)))
    unset = (lambda c: ~present(p(c)) | (p(c) == "All"))
    quota = F.lower(F.coalesce(p("quota_type"), F.lit("unknown")))
    bc_family = is_true(F.upper(p("category")).isin(rule_index.QUOTA_COMMUNITIES))
    occupation = rule_index.occupation(p("agri_labor"), p("parent_occupation"))
    return [
        _criterion("gender", restricted(s("gender"), "All"), unset("gender"), s("gender") != p("gender"),
                   s("gender"), p("gender")),
        _either(capped, _criterion("income", F.lit(True), p("income").isNull(), p("income") > s("income_limit"),
                                   s("income_limit"), p("income")),
                _criterion("income", F.lit(True), F.lit(False), F.lit(False), F.lit("No Income Limit"), p("income"))),
        _criterion("category", restricted(s("category"), "All", "all"), ~present(p("category")),
                   ~accepts_community(s("category"), p("category")), s("category"), p("category")),
        _either(local, _criterion("state", F.lit(True), ~present(p("state")), lower_differs("state"), s("state"),
                                  p("state")),
                _criterion("state", F.lit(True), F.lit(False), F.lit(False), F.lit("Pan-India"), p("state"))),
        _criterion("district", restricted(s("district"), "All"), unset("district"), lower_differs("district"),
                   s("district"), p("district")),
        _criterion("course", restricted(s("course"), "All"), unset("course"), lower_differs("course"),
                   s("course"), p("course")),
        _flag("disability", s("requires_disability"), p("disabled"), "Minimum 40% disability"),
        _flag("government_school", s("requires_govt_school"), p("govt_school"), "Government school, class 6 to 12"),
        _criterion("parent_occupation", is_true(s("requires_agri_labor")), occupation.isNull(), ~occupation,
                   F.lit("Registered agricultural labourer"), p("agri_labor")),
        _flag("armed_forces", s("requires_armed_forces"), p("armed_forces"), "Ward of armed forces"),
        _flag("first_graduate", s("requires_first_graduate"), p("first_graduate"), "First graduate in family"),
        _criterion("admission_quota", is_true(s("requires_govt_quota")) & bc_family, quota == "unknown",
                   quota == "management", F.lit("Government quota"), quota),
    ]


def evaluate(pairs: DataFrame) -> DataFrame:
    """Criteria, match type and score for rows that hold ``student`` and ``scheme`` structs.

    The outcome is counted from the statuses; the details with their reasons are only made where they are read.
    """
    p, s = (lambda c: F.col(f"student.{c}")), (lambda c: F.col(f"scheme.{c}"))
    possible = is_true(p("disabled") & s("potential_if_disabled")) & (
        s("potential_courses").isNull() | ~present(p("course"))
        | is_true(F.array_contains(s("potential_courses"), p("course"))))
    same = (lambda c: is_true(restricted(s(c), "All") & (F.lower(s(c)) == F.lower(p(c)))))
    modest = is_true((p("income") > 0) & (s("income_limit") != lexicon.NO_INCOME_CAP)
                     & (p("income").cast("double") / F.nullif(s("income_limit"), F.lit(0)).cast("double") < 0.6))
    bonus = (F.when(same("category"), 10).otherwise(0) + F.when(same("course"), 10).otherwise(0)
             + F.when(same("district"), 5).otherwise(0) + F.when(modest, 5).otherwise(0))
    asked = criteria()
    count = (lambda st: reduce(add, [is_true(status == st).cast("int") for status, _ in asked]))
    rows = pairs.withColumns({"failed": count("FAILED"), "missing": count("NEEDS_INFO")})
    rows = rows.withColumn("match_type", first_case(
        [(F.col("failed") > 0, NOT_MATCHED), ((F.col("missing") > 0) & possible, POTENTIAL), (F.col("missing") > 0, NEEDS_INFO)],
        CONFIRMED))
    score = first_case([(F.col("match_type") == POTENTIAL, F.lit(55)),
                        (F.col("match_type") == CONFIRMED, F.least(F.lit(100), F.lit(70) + bonus))], F.lit(0))
    details = F.filter(F.array(*[d for _, d in asked]), lambda c: c.isNotNull())
    return rows.select(
        s("scheme_id").alias("scheme_id"), p("student_id").alias("student_id"), "match_type", score.alias("score"),
        (F.col("match_type") == CONFIRMED).alias("eligible"), "failed", "missing", details.alias("criteria"))


def open_matches(students: DataFrame, schemes: DataFrame) -> DataFrame:
    """The pairs of student and scheme that no criterion refuses, found through the rule index."""
    return evaluate(rule_index.open_pairs(students, schemes))


def match_all(students: DataFrame, schemes: DataFrame) -> DataFrame:
    """Every student against every scheme, refusals with their reasons included; for students or schemes asked about."""
    pairs = with_each_rule(students, schemes, "scheme")
    return evaluate(pairs.select(F.struct(*students.columns).alias("student"), "scheme"))


def ranked_schemes(matches: DataFrame, n: int, kinds: list[str]) -> DataFrame:
    """Best ``n`` schemes per student among the match types asked for."""
    weight = first_case([(F.col("match_type") == k, v) for k, v in ORDER.items()], 0)
    return top_per_key(matches.where(F.col("match_type").isin(kinds)), ["student_id"],
                       [weight.desc(), F.col("score").desc(), F.col("scheme_id")], n)


def match_groups(matches: DataFrame, students: DataFrame, schemes: DataFrame) -> DataFrame:
    """Pairs by outcome group and scheme.  The refused pairs are not formed: they are what the others leave of all."""
    group = F.when(F.col("match_type") == NEEDS_INFO, "needs_information").otherwise("confirmed_or_potential")
    found = matches.where(F.col("match_type") != NOT_MATCHED).groupBy("scheme_id", group.alias("match_group")).agg(
        F.count(F.lit(1)).alias("pairs"))
    everyone = students.agg(F.count(F.lit(1)).alias("n")).scalar()
    left = schemes.select("scheme_id").join(found.groupBy("scheme_id").agg(F.sum("pairs").alias("open")), "scheme_id", "left").select(
        "scheme_id", F.lit("not_matched").alias("match_group"), (everyone - F.coalesce("open", F.lit(0))).alias("pairs"))
    return found.unionByName(left.where("pairs > 0"))


# Communities counted as minority by the simple matcher.
MINORITY = ["MUSLIM", "CHRISTIAN", "SIKH", "BUDDHIST", "JAIN", "PARSI"]


def simple_matches(applicants: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Community in list, income within cap, course in list, special condition met."""
    rows = with_each_rule(applicants, catalogue, "scheme")
    s = (lambda c: F.col(f"scheme.{c}"))
    community = F.upper(F.trim("community"))
    member = F.array_contains(s("communities"), community) | (
        F.array_contains(s("communities"), F.lit("MIN")) & community.isin(MINORITY))
    course = F.lower(F.trim("course"))
    wanted = ~present(course) | F.array_contains(s("courses"), course)
    allowed = not_equal_or_missing(s("special_condition"), "armed_forces") | is_true(F.col("armed_forces"))
    return rows.where(is_true(member) & is_true(F.col("income") <= s("max_income")) & is_true(wanted) & allowed
                      ).select("applicant_id", s("scheme_id").alias("scheme_id"))


# --- selection -----------------------------------------------------------------------------------

def selection_candidates(apps: DataFrame, students: DataFrame, rules: DataFrame) -> DataFrame:
    """Applications open for selection with their predicates and reasons.

    Unknown income or marks is not eligible; externally tracked cases are out.
    """
    pool = apps.where(F.col("application_status").isin(lexicon.SELECTABLE)
                      & not_equal_or_missing(F.col("route"), "EXTERNAL_TRACKING"))
    rows = (pool.join(students.select("student_id", "family_income"), "student_id", "left")
            .join(rules.select("scheme_id", "max_income", "min_marks", "rule_version"), "scheme_id"))
    income_ok = is_true(F.col("family_income") <= F.col("max_income"))
    marks_ok = is_true(F.col("marks") >= F.col("min_marks"))
    documents_ok = is_true(F.col("document_status") == "VERIFIED")
    return rows.select(
        "application_id", "student_id", "scheme_id", "family_income", "marks", "rule_version",
        (income_ok & marks_ok & documents_ok).alias("eligible"),
        kept([(~income_ok, F.lit("income above ceiling or unknown")), (~marks_ok, F.lit("marks below minimum")),
              (~documents_ok, F.lit("documents not verified"))]).alias("reasons"))


def selection_preview(candidates: DataFrame, quota: int) -> DataFrame:
    """Decision and rank per candidate: the quota by merit, the rest of the eligible waits.

    Only the winners need a rank.  They are found with a per-task top-``quota``
    filter and joined back, so a scheme with most of the applications is never
    sorted in one task.
    """
    merit = [F.col("marks").desc(), F.col("family_income").asc(), F.col("application_id").asc()]
    winners = top_per_key(candidates.where("eligible"), ["scheme_id"], merit, quota).select("application_id", "rank")
    rows = candidates.join(winners, "application_id", "left")
    decision = first_case([(F.col("rank").isNotNull(), "RECOMMENDED_FOR_SELECTION"),
                           (F.col("eligible"), "QUOTA_WAITLIST")], "NOT_RECOMMENDED")
    reasons = F.when(decision == "QUOTA_WAITLIST", F.array_append("reasons", F.lit("selection quota exceeded"))
                     ).otherwise(F.col("reasons"))
    return rows.withColumn("decision", decision).withColumn("reasons", reasons)


def selection_summary(preview: DataFrame, quota: int) -> DataFrame:
    out = preview.groupBy("scheme_id").agg(
        F.count(F.lit(1)).alias("evaluated"), count_if(F.col("rank").isNotNull(), "recommended"),
        count_if(F.col("decision") == "QUOTA_WAITLIST", "waitlisted"))
    return out.withColumn("quota_remaining", F.greatest(F.lit(0).cast("long"), F.lit(quota) - F.col("recommended")))


def apply_selection(apps: DataFrame, chosen: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """New application state and the event rows for the chosen ids.

    Externally tracked and already selected applications stay as they are.
    """
    flagged = apps.join(chosen.select("application_id", F.lit(True).alias("_chosen")).distinct(), "application_id", "left")
    moves = is_true(F.col("_chosen")) & not_equal_or_missing(F.col("route"), "EXTERNAL_TRACKING") & \
        not_equal_or_missing(F.col("application_status"), "SELECTED")
    events = flagged.where(moves).select(
        "application_id", F.col("application_status").alias("previous_status"), F.lit("SELECTED").alias("new_status"),
        at.alias("changed_at"), F.lit("SELECTION_APPROVAL").alias("source"))
    state = flagged.withColumn("selected_at", F.when(moves, at).otherwise(
        F.col("selected_at") if "selected_at" in apps.columns else F.lit(None).cast("timestamp_ntz")))
    state = state.withColumn("application_status", F.when(moves, F.lit("SELECTED")).otherwise(
        F.col("application_status"))).drop("_chosen")
    return state, events


def rule_impact(apps: DataFrame, students: DataFrame, rules: DataFrame, proposed: DataFrame) -> DataFrame:
    """Eligible now and under the proposed rules, per scheme.

    Rows with unknown income or marks are excluded from both counts.
    ``proposed`` holds scheme_id, max_income, min_marks, category (NULL keeps the
    current value; a NULL category admits all).
    """
    new = proposed.select("scheme_id", F.col("max_income").alias("new_income"), F.col("min_marks").alias("new_marks"),
                          F.col("category").alias("new_category"))
    rows = (apps.join(students.select("student_id", "family_income", "category"), "student_id", "left")
            .join(rules.select("scheme_id", "max_income", "min_marks"), "scheme_id").join(new, "scheme_id", "left"))
    known = F.col("family_income").isNotNull() & F.col("marks").isNotNull()
    now = is_true((F.col("family_income") <= F.col("max_income")) & (F.col("marks") >= F.col("min_marks")))
    then = is_true((F.col("family_income") <= F.coalesce("new_income", "max_income"))
                   & (F.col("marks") >= F.coalesce("new_marks", "min_marks"))
                   & (F.col("new_category").isNull() | (F.col("new_category") == F.col("category"))))
    out = rows.select("scheme_id", known.alias("known"), (known & now).alias("now"), (known & then).alias("then")
                      ).groupBy("scheme_id").agg(
        F.count(F.lit(1)).alias("applications"), count_if(F.col("known"), "evaluated"),
        count_if(F.col("now"), "eligible_now"), count_if(F.col("then"), "eligible_then"),
        count_if(~F.col("now") & F.col("then"), "newly_eligible"),
        count_if(F.col("now") & ~F.col("then"), "newly_ineligible"))
    return out.withColumn("net_change", F.col("eligible_then") - F.col("eligible_now")).withColumn(
        "then_rate", percent(F.col("eligible_then"), F.col("evaluated")))


def change_sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that enter or leave a set of eligible ids."""
    gained = after.exceptAll(before).withColumn("change", F.lit("newly_eligible"))
    lost = before.exceptAll(after).withColumn("change", F.lit("newly_ineligible"))
    return gained.unionByName(lost)
