"""Dates, incomes, communities and profile vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stipendia.functions import lexicon
from stipendia.functions.scalars import extract, first_case, is_true, matches, present, replace_all

DMY = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$"
YMD = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"
MONTH_DAYS = 30.44


def parse_date(raw: Column, first_year: int = 1900, last_year: int = 2100) -> Column:
    """Day-first or year-first date text; impossible dates are NULL."""
    unified = F.regexp_replace(F.trim(raw), "[/.]", "-")
    day = F.coalesce(F.when(F.trim(raw).rlike(DMY), F.try_to_date(unified, "d-M-yyyy")),
                     F.when(F.trim(raw).rlike(YMD), F.try_to_date(unified, "yyyy-M-d")))
    return F.when(F.year(day).between(first_year, last_year), day)


def iso_date(raw: Column) -> Column:
    return F.date_format(parse_date(raw), "yyyy-MM-dd")


def display_date(raw: Column) -> Column:
    return F.coalesce(F.date_format(parse_date(raw), "dd-MM-yyyy"), raw)


def is_calendar_date(raw: Column) -> Column:
    return parse_date(raw, 1950, 2035).isNotNull()


def student_birth_date(raw: Column, reference_year: int) -> Column:
    """The date when it gives an age of 10 to 45 years in the reference year."""
    day = parse_date(raw, 1950, 2035)
    return F.when((F.lit(reference_year) - F.year(day)).between(10, 45), day)


def months_since(day: Column, as_of: Column) -> Column:
    return F.date_diff(as_of.cast("date"), day).cast("double") / MONTH_DAYS


def parse_income(raw: Column) -> Column:
    """Whole rupees from text such as ``Rs. 2,50,000/-``; NULL when unreadable."""
    text = F.trim(raw)
    text = replace_all(text, (r"(?i)(?:₹|Rs\.?|R\.(?=\s*\d)|Re\.?|INR|Rupees?)", " "), (r"/\s*-\s*$", ""),
                       (r"\.\d{1,2}\s*$", ""), (r"\.(?=\d{3})", ""))
    digits = replace_all(text, ("[Oo]", "0"), (r"(?<=[\d,\s]|^)[lI](?=[\d,\s]|$)", "1"))
    amount = F.regexp_replace(F.when(text.rlike(r"\d"), digits).otherwise(text), r"[^\d]", "").try_cast("long")
    return F.when(present(raw) & ~raw.rlike(r"^\s*-\s*\d") & amount.between(0, 100_000_000), amount)


def indian_grouping(amount: Column) -> Column:
    """``250000`` as ``2,50,000``."""
    digits = amount.cast("string")
    head = F.regexp_replace(F.left(digits, F.length(digits) - 3), r"(?<=\d)(?=(?:\d{2})+$)", ",")
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.right(digits, F.lit(3))))


def income_display(raw: Column) -> Column:
    amount = parse_income(raw)
    return F.when(amount.isNotNull(), F.concat(F.lit("₹"), indian_grouping(amount)))


def community_code(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    direct = first_case([(low == k, v) for k, v in lexicon.COMMUNITY_CODES.items()],
                        F.lit(None).cast("string"))
    inner = F.upper(F.trim(extract(low, r"\(([^)]+)\)")))
    bracket = F.when(inner.isin(lexicon.COMMUNITY_IN_PARENTHESES),
                     F.when(inner == "GEN", F.lit("General")).otherwise(inner))
    phrase = first_case([(F.contains(low, F.lit(p)), v) for p, v in lexicon.COMMUNITY_PHRASES],
                        F.lit(None).cast("string"))
    return F.when(present(raw), F.coalesce(direct, bracket, phrase, F.trim(raw)))


def religion_name(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(present(raw), first_case(
        [(F.contains(low, F.lit(w)), v) for w, v in lexicon.RELIGION_WORDS], F.trim(raw)))


def compare_birth_dates(a: Column, b: Column) -> Column:
    ia, ib = iso_date(a), iso_date(b)
    return first_case([(~(present(a) & present(b)), "MISSING"), (ia.isNull() | ib.isNull(), "UNREADABLE"),
                       (ia == ib, "MATCH")], "MISMATCH")


def compare_incomes(cert: Column, entered: Column, freshness: Column) -> Column:
    a, b = parse_income(cert), parse_income(entered)
    return first_case([(a.isNull() & b.isNull(), "MISSING"), (a.isNull() | b.isNull(), "WARNING"),
                       ((a == b) & (freshness == "expired"), "EXPIRED"), (a == b, "MATCH")], "MISMATCH")


def compare_communities(cert: Column, entered: Column) -> Column:
    a, b = community_code(cert), community_code(entered)
    return first_case([(a.isNull() & b.isNull(), "MISSING"), (a.isNull() | b.isNull(), "WARNING"),
                       (a == b, "MATCH")], "MISMATCH")


def income_freshness(issued: Column, valid_upto: Column, confirmed: Column, window_months: Column,
                     as_of: Column) -> Column:
    """State of an income certificate at ``as_of``."""
    upto, day = parse_date(valid_upto), parse_date(issued)
    today = as_of.cast("date")
    dated = upto.isNotNull()
    late = is_true(window_months.isNotNull() & (months_since(day, as_of) > window_months))
    return first_case([
        (~(present(issued) | present(valid_upto)), "unknown"),
        (dated & ~is_true(confirmed), "needs_confirmation"),
        (dated & (upto < today), "expired"),
        (dated & (F.date_diff(upto, today) <= 30), "warning"),
        (dated, "valid"), (late, "outside_window")], "needs_confirmation")


def certificate_age(issued: Column, expiry: Column, max_months: int, as_of: Column) -> Column:
    """struct(expired, unknown, months_old) for a certificate."""
    upto, day = parse_date(expiry), parse_date(issued)
    months = months_since(day, as_of)
    expired = F.when(upto.isNotNull(), upto < as_of.cast("date")).when(day.isNotNull(), months > max_months)
    return F.struct(is_true(expired).alias("expired"), (upto.isNull() & day.isNull()).alias("unknown"),
                    F.floor(months + 0.5).alias("months_old"))


def is_ifsc(code: Column) -> Column:
    return is_true(F.upper(F.trim(code)).rlike("^[A-Z]{4}0[A-Z0-9]{6}$"))


def is_email(value: Column) -> Column:
    return is_true(value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"))


# --- profile vocabularies -----------------------------------------------------------------------

def _word(raw: Column, table) -> Column:
    low = F.lower(F.trim(raw))
    return first_case([(low.isin(words), code) for code, words in table], F.lit(None).cast("string"))


def profile_category(raw: Column) -> Column:
    return _word(raw, lexicon.PROFILE_CATEGORIES)


def profile_community(raw: Column) -> Column:
    return F.when(present(raw), F.coalesce(_word(raw, lexicon.PROFILE_COMMUNITIES), F.lower(F.trim(raw))))


def _pattern(raw: Column, table, otherwise=None) -> Column:
    low = F.lower(raw)
    return first_case([(matches(low, p, ""), code) for code, p in table],
                      F.lit(otherwise).cast("string"))


def profile_course(raw: Column) -> Column:
    return F.coalesce(_pattern(raw, lexicon.COURSE_PATTERNS), F.lit("All"))


def profile_level(raw: Column) -> Column:
    return _pattern(raw, lexicon.LEVEL_PATTERNS)


def profile_gender(raw: Column) -> Column:
    return F.coalesce(_pattern(raw, lexicon.GENDER_PATTERNS), F.lit("All"))


def profile_state(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    named = first_case([(low == s.lower(), s) for s in lexicon.INDIAN_STATES], raw)
    return F.when(present(raw), F.coalesce(_pattern(raw, lexicon.STATE_ALIASES), named)).otherwise("Tamil Nadu")


def accepts_community(scheme: Column, applicant: Column) -> Column:
    """Whether a scheme category admits an applicant category."""
    s, a = F.upper(scheme), F.upper(applicant)
    return (~present(scheme) | (s == "ALL") | (present(applicant) & (
        (s == a) | ((s == "BC") & a.isin("MBC", "DNC")) | ((s == "OBC") & a.isin("BC", "MBC")))))


def confidence_band(conf: Column) -> Column:
    return first_case([(conf.isNull(), "review"), (conf >= 90, "high"), (conf >= 70, "review"),
                       (conf >= 50, "confirm")], "untrusted")


def restricted(rule: Column, *open_values: str) -> Column:
    """Whether a rule column names a real restriction."""
    return present(rule) & ~rule.isin(list(open_values))
