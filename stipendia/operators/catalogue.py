"""Scheme catalogues: metadata override, checklists, generated questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stipendia.operators.frames import with_each_rule

OVERRIDES = ["rule_status", "jurisdiction", "portal", "academic_year", "source_url"]


def with_metadata(base: DataFrame, metadata: DataFrame, columns: list[str] = OVERRIDES) -> DataFrame:
    """Metadata values replace catalogue values where present."""
    meta = metadata.select("scheme_id", *[F.col(c).alias(f"_m_{c}") for c in columns])
    rows = base.join(meta, "scheme_id", "left")
    picked = {c: F.coalesce(f"_m_{c}", F.col(c) if c in base.columns else F.lit(None).cast("string")) for c in columns}
    return rows.withColumns(picked).drop(*[f"_m_{c}" for c in columns])


def checklist(schemes: DataFrame, requirements: DataFrame) -> DataFrame:
    """Document list per scheme: metadata lists, else the plain documents of the catalogue.

    ``requirements``: scheme_id, kind (required, optional, renewal), label, purpose.
    """
    listed = requirements.select("scheme_id", "kind", "label", "purpose")
    plain = schemes.join(requirements.where(F.col("kind") == "required").select("scheme_id"), "scheme_id", "left_anti")
    fallback = plain.select("scheme_id", F.lit("required").alias("kind"), F.explode("documents").alias("label"),
                            F.lit("Required for this scholarship").alias("purpose"))
    return listed.join(schemes.select("scheme_id"), "scheme_id", "left_semi").unionByName(fallback)


# Question templates of the generated corpus.
TOPICS = [
    ("eligibility", "what is the eligibility for %s %s %s scholarship"),
    ("documents", "which documents are needed for %s %s %s scholarship"),
    ("deadline", "what is the last date to apply for %s %s %s scholarship"),
    ("process", "how to apply for %s %s %s scholarship"),
    ("income", "what is the income limit for %s %s %s scholarship"),
    ("helpline", "what is the helpline for %s %s %s scholarship"),
]


def generated_questions(states: DataFrame, categories: DataFrame, courses: DataFrame) -> DataFrame:
    """One question per state, category, course and topic.

    Each input has one column ``name``; lists of any length are met chunk by chunk (``frames.with_each_rule``).
    """
    topics = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(f).alias("form")) for t, f in TOPICS])
    named = (lambda df: df.where("name is not null").select("name").distinct())
    rows = named(states).select(F.col("name").alias("state"))
    for column, names in (("category", categories), ("course", courses)):
        rows = with_each_rule(rows, named(names), "_each").withColumn(column, F.col("_each.name")).drop("_each")
    rows = rows.withColumn("t", F.explode(topics))
    low = (lambda c: F.lower(F.col(c)))
    return rows.select("state", "category", "course", F.col("t.topic").alias("topic"), F.format_string(
        "%s %s %s %s scholarship", F.regexp_replace("t.form", " %s %s %s scholarship$", ""), low("state"), low("category"),
        low("course")).alias("question"))


def concatenated(*parts: DataFrame) -> DataFrame:
    """Catalogues one after the other; columns a part lacks become NULL."""
    first, *rest = parts
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
