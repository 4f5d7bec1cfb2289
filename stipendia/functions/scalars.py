"""Small column builders shared by every job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from stipendia.functions.anchored import may_match

ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A plain Python expression tree would repeat ``value`` wherever ``body`` uses
    it; binding it as a lambda variable keeps long text clean-ups single.
    """
    return F.get(F.transform(F.array(value), body), 0)


def regex(pattern: str, flags: str = "") -> str:
    """A Java pattern whose ``\\b`` is the ASCII word boundary.

    ``java.util.regex`` treats accented letters as word characters for ``\\b``
    only; the rest of the rule tables assume ASCII words on both sides.
    """
    body = pattern.replace(r"\b", ASCII_BOUNDARY)
    return f"(?{flags}){body}" if flags else body


def matches(col: Column, pattern: str, flags: str = "i") -> Column:
    """Whether the pattern occurs; it is only tried on texts that hold one of its literals."""
    found = F.coalesce(col.rlike(regex(pattern, flags)), F.lit(False))
    may = may_match(col, pattern, "i" in flags)
    return found if may is None else F.coalesce(may, F.lit(False)) & found


def contains_pattern(lowered: Column, pattern: str) -> Column:
    """Match against text that is already lower case.

    Top-level alternatives are searched one by one without the
    case-insensitive flag, so those that start with a literal use the engine's
    skip search instead of trying every alternative at every position.
    """
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        depth += ch in "(["
        depth -= ch in ")]"
        if ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    parts.append(pattern[start:])
    flags = "(?s)" if parts[0].startswith("(?s)") else ""
    parts = [p if p.startswith("(?") and p.startswith(flags) else flags + p for p in parts]
    return any_of([matches(lowered, p, "") for p in parts])


def extract(col: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """Group of the first match, NULL when the pattern does not occur."""
    return F.nullif(F.regexp_extract(col, regex(pattern, flags), group), F.lit(""))


def replace_all(col: Column, *steps: tuple[str, str]) -> Column:
    for pattern, value in steps:
        col = F.regexp_replace(col, regex(pattern), value)
    return col


def half_up(value: Column) -> Column:
    """Round half towards plus infinity, as whole number."""
    return F.floor(value + F.lit(0.5))


def half_up_to(value: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.floor(value * scale + F.lit(0.5)) / F.lit(scale)


def percent(part: Column, whole: Column, empty: int | None = None) -> Column:
    """Whole-number percentage; ``empty`` (NULL by default) for a zero base."""
    rate = half_up(part.cast("double") / whole.cast("double") * 100.0)
    return F.when(whole > 0, rate).otherwise(F.lit(empty).cast("long"))


def percent1(part: Column, whole: Column, empty: float | None = None) -> Column:
    rate = half_up_to(part.cast("double") / whole.cast("double") * 100.0, 1)
    return F.when(whole > 0, rate).otherwise(F.lit(empty).cast("double"))


def filled(*cols: Column) -> Column:
    """First column that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def present(col: Column) -> Column:
    return F.coalesce(F.length(F.trim(col)) > 0, F.lit(False))


def is_true(cond: Column) -> Column:
    """Collapse an unknown condition to false."""
    return F.coalesce(cond, F.lit(False))


def not_equal_or_missing(col: Column, value) -> Column:
    return ~col.eqNullSafe(F.lit(value))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def first_case(cases: list[tuple[Column, object]], otherwise=None) -> Column:
    """Ordered ``when`` chain; the first true case wins."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    tail = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return tail if out is None else out.otherwise(tail)


def status_label(col: Column) -> Column:
    """``FOO_BAR`` to ``Foo Bar``."""
    return F.initcap(F.lower(F.replace(col, F.lit("_"), F.lit(" "))))


def kept(conditions: list[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds, in the order given."""
    return F.filter(F.array(*[F.when(is_true(c), v) for c, v in conditions]),
                    lambda x: x.isNotNull())


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between two time-zone free timestamps.

    Built from calendar parts, because a timestamp difference would go through
    the session time zone and its daylight-saving jumps.
    """
    def clock(t: Column) -> Column:
        return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)

    days = F.date_diff(end.cast("date"), start.cast("date")).cast("long")
    return days * 86_400 + clock(end) - clock(start)


def as_instant(value: str) -> Column:
    """An explicit ``as_of`` as a time-zone free timestamp."""
    return F.lit(value).cast("timestamp_ntz")


def utc_instant(clock: Column) -> Column:
    """A time-zone free timestamp read as UTC, whatever the session time zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), clock).cast("timestamp")


def utc_clock(instant: Column) -> Column:
    """The UTC wall clock of an instant as time-zone free timestamp."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def money(col: Column) -> Column:
    return col.cast("decimal(18,2)")
