"""Row filters: parameters, date ranges, search, membership, scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stipendia.functions.scalars import any_of, as_instant

DATE_COLUMNS = {"submissionDate": "submitted_at", "decisionDate": "selected_at", "paymentDate": "paid_at",
                "verificationDate": "college_verified_at"}


def by_params(df: DataFrame, **params) -> DataFrame:
    """Conjunction over the parameters given; a list means membership."""
    for name, value in params.items():
        if value is None:
            continue
        df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df


def in_date_range(df: DataFrame, kind: str = "submissionDate", start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """Both ends included, on the date column named by ``kind``."""
    column = F.col(DATE_COLUMNS[kind])
    if start:
        df = df.where(column >= as_instant(start))
    if end:
        df = df.where(column <= as_instant(end))
    return df


def search(df: DataFrame, columns: list[str], term: str | None, pattern: bool = False) -> DataFrame:
    """Case-insensitive search over several columns; the term is literal unless asked otherwise."""
    if not term:
        return df
    if pattern:
        return df.where(any_of([F.col(c).rlike("(?i)" + term) for c in columns]))
    return df.where(any_of([F.contains(F.lower(F.col(c)), F.lit(term.lower())) for c in columns]))


def members(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in the other table."""
    keys = other.select(F.col(other_key or key).alias(key))
    return df.join(keys, key, "left_semi")


def scoped(df: DataFrame, role: str, college_id=None) -> DataFrame:
    """College roles see their own college, ministry roles see everything."""
    if role.upper().startswith("COLLEGE"):
        if college_id is None:
            raise ValueError("a college role needs its college")
        return df.where(F.col("college_id") == college_id)
    return df


def in_state(df: DataFrame, colleges: DataFrame, state: str | None) -> DataFrame:
    """Intersects with other college filters instead of replacing them."""
    return df if state is None else members(df, colleges.where(F.col("state") == state), "college_id")


def active_sorted(df: DataFrame, status: str, name: str) -> DataFrame:
    return df.where(F.col(status) == "ACTIVE").orderBy(name)


def feedback_issues(df: DataFrame) -> DataFrame:
    """Feedback rows with their rule violations."""
    from stipendia.functions.scalars import kept
    from stipendia.functions.values import is_email

    limits = {"name": 100, "email": 254, "issue_type": 100, "message": 4000, "comment": 4000}
    texts = ["name", "email", "issue_type", "message", "comment"]
    too_long = [(F.length(c) > n, F.lit(f"{c} too long")) for c, n in limits.items()]
    empty = F.concat_ws("", *[F.trim(F.col(c)) for c in texts]) == ""
    return df.withColumn("issues", kept([
        *too_long,
        (F.col("email").isNotNull() & (F.col("email") != "") & ~is_email(F.col("email")), F.lit("invalid email")),
        (F.col("rating").isNotNull() & ~F.col("rating").between(0, 5), F.lit("rating out of range")),
        (empty & (F.coalesce(F.col("rating"), F.lit(0)) == 0), F.lit("empty report")),
    ]))
