"""Extracted fields against labels: rates, error distances, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions.names import evaluation_key, with_name_match
from stipendia.functions.scalars import first_case, is_true, percent, present
from stipendia.functions.text import split_words, word_distance
from stipendia.operators.frames import count_if


def unpivoted(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """(key, field, value) in one scan."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
    return df.select(key, F.inline(rows))


def aligned(truth: DataFrame, predicted: DataFrame, key: str, fields: list[str], extra: list[str] | None = None) -> DataFrame:
    """Truth and prediction per document and field.

    The two wide tables are joined once on the document and unpivoted after it,
    instead of joining two tables that are ``len(fields)`` times as long.
    """
    extra = extra or []
    p = predicted.select(key, *[F.col(f).cast("string").alias(f"_p_{f}") for f in fields])
    rows = truth.select(key, *extra, *fields).join(p, key, "left")
    long = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("truth"), F.col(f"_p_{f}").alias("prediction"))
                     for f in fields])
    return rows.select(key, *extra, F.inline(long))


def match_rates(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Exact and normalised match rates where the truth is known."""
    known = pairs.where(present(F.col("truth")))
    exact = F.lower(F.trim("prediction")) == F.lower(F.trim("truth"))
    same = (evaluation_key(F.col("prediction")) == evaluation_key(F.col("truth"))) & present(F.col("prediction"))
    out = known.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("evaluated"), count_if(is_true(exact), "exact"),
                                           count_if(is_true(same), "normalised"))
    return out.withColumn("exact_rate", percent(F.col("exact"), F.col("evaluated"))).withColumn(
        "normalised_rate", percent(F.col("normalised"), F.col("evaluated")))


def error_rates(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Character and word error rates over all pairs (sum of edits by sum of lengths)."""
    low = (lambda c: F.lower(F.coalesce(c, F.lit(""))))
    rows = pairs.select(*(keys or []), low("truth").alias("t"), low("prediction").alias("p"))
    rows = rows.withColumn("tw", split_words(F.col("t"))).withColumn("pw", split_words(F.col("p")))
    out = rows.groupBy(*(keys or [])).agg(
        F.sum(F.levenshtein("t", "p")).alias("char_edits"), F.sum(F.length("t")).alias("chars"),
        F.sum(word_distance(F.col("tw"), F.col("pw"))).alias("word_edits"), F.sum(F.size("tw")).alias("words"))
    return out.withColumn("cer", F.col("char_edits") / F.greatest(F.col("chars"), F.lit(1))).withColumn(
        "wer", F.col("word_edits") / F.greatest(F.col("words"), F.lit(1)))


def judged(pairs: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Adds ``correct`` by the comparison rule of each field."""
    t, p, f = F.col("truth"), F.col("prediction"), F.col("field")
    bare = (lambda c: F.regexp_replace(c, r"\s", ""))
    day = (lambda c: F.regexp_replace(c, "[/.]", "-"))
    number = (lambda c: F.replace(c, F.lit("%"), F.lit("")).try_cast("double"))
    key = (lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))
    held = (lambda a, b: F.contains(a, b) | F.contains(b, a))
    named = with_name_match(pairs, "prediction", "truth", False, "n")
    correct = first_case([
        (~present(p), F.lit(False)), (f == "marks", held(bare(p), bare(t))),
        (f == "percentage", F.abs(number(p) - number(t)) <= tolerance), (f.isin("date_of_birth", "issue_date"), day(p) == day(t)),
        (f.isin("student_name", "parent_name"), F.col("n_status").isin("EXACT_MATCH", "LIKELY_MATCH", "MINOR_DIFFERENCE"))],
        held(key(p), key(t)))
    return named.withColumn("correct", is_true(correct)).drop("n_status", "n_score")


def not_applicable(field: Column, doc_type: Column) -> Column:
    """Fields a layout does not print."""
    return ((field == "issue_date") & F.contains(doc_type, F.lit("marksheet"))) | (
        (field == "parent_name") & (doc_type == "10th_marksheet"))


def field_report(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates per group; ``pairs`` carries doc_type, status and confidence."""
    gap = not_applicable(F.col("field"), F.col("doc_type"))
    counted = ~gap & present(F.col("truth"))
    found = counted & present(F.col("prediction"))
    rows = judged(pairs)
    out = rows.groupBy(*keys).agg(
        count_if(gap, "not_applicable"), count_if(counted, "evaluated"), count_if(found & F.col("correct"), "correct"),
        count_if(found & ~F.col("correct"), "incorrect"), count_if(counted & ~present(F.col("prediction")), "not_detected"),
        count_if(found & is_true((F.col("status") == "NEEDS_REVIEW") | (F.col("confidence") < 70)), "needs_review"))
    return out.withColumn("accuracy", percent(F.col("correct"), F.col("evaluated"))).withColumn(
        "precision", percent(F.col("correct"), F.col("correct") + F.col("incorrect"))).withColumn("recall", F.col("accuracy"))


def overall_accuracy(report: DataFrame) -> DataFrame:
    out = report.agg(F.sum("evaluated").alias("evaluated"), F.sum("correct").alias("correct"))
    return out.withColumn("accuracy", percent(F.col("correct"), F.col("evaluated")))


def calibration(rows: DataFrame) -> DataFrame:
    """Accuracy per confidence band; the top band must hold no error."""
    c = F.col("confidence")
    band = first_case([(c >= 90, "90-100"), (c >= 70, "70-89"), (c >= 50, "50-69")], "<50")
    out = rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("total"), count_if(is_true(F.col("correct")), "correct"))
    return out.withColumn("accuracy", percent(F.col("correct"), F.col("total"))).withColumn(
        "violation", (F.col("band") == "90-100") & (F.col("correct") < F.col("total")))


def predicted_status(name: Column, confidence: Column) -> Column:
    """Status from the prediction alone, never from the label."""
    return first_case([(~present(name), "NOT_DETECTED"), (is_true(confidence >= 75), "HIGH_CONFIDENCE")], "NEEDS_REVIEW")


def status_counts(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    s = F.col("status")
    return rows.groupBy(*(keys or [])).agg(
        count_if(s == "NOT_DETECTED", "not_detected"), count_if(s == "NEEDS_REVIEW", "needs_review"),
        count_if(s == "HIGH_CONFIDENCE", "high_confidence"),
        count_if((s == "HIGH_CONFIDENCE") & ~is_true(F.col("correct")), "wrong_high_confidence"))


def breakdown(rows: DataFrame, type_column: str, other: str) -> DataFrame:
    """Accuracy by type, by the other column and overall, from grouping sets."""
    out = rows.groupingSets([[type_column], [other], []], type_column, other).agg(
        F.count(F.lit(1)).alias("rows"), count_if(is_true(F.col("correct")), "correct"))
    return out.withColumn("accuracy", percent(F.col("correct"), F.col("rows")))


def label_key(label: Column) -> Column:
    """One spelling for status labels."""
    return F.replace(F.upper(F.trim(label)), F.lit("_"), F.lit(" "))


def case_agreement(derived: DataFrame, expected: DataFrame, case: str = "case_id") -> DataFrame:
    """Derived against expected case status."""
    rows = derived.select(case, F.col("status").alias("derived")).join(expected.select(case, "expected"), case)
    same = label_key(F.col("derived")) == label_key(F.col("expected"))
    out = rows.agg(F.count(F.lit(1)).alias("cases"), count_if(is_true(same), "agree"))
    return out.withColumn("agreement", percent(F.col("agree"), F.col("cases")))
