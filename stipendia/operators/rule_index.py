"""An inverted index of scheme rules, met by distinct student profiles.

Each criterion that can refuse a student becomes postings: the values it
accepts, each with a bit set of the schemes that accept it.  Income ceilings
are sorted, and the place of an income among them stands for the income, so
students with the same answers are one profile however many they are.  A
profile meets the index once a criterion; the schemes that refuse it are the
union of bit sets, and only the bits left are written out as rows.  Students
thus never stand next to schemes that refuse them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stipendia.functions import lexicon
from stipendia.functions.scalars import is_true, present
from stipendia.functions.values import restricted

WORD = 64  # schemes in one bit set

# Communities for which an admission quota matters.
QUOTA_COMMUNITIES = ["BC", "MBC", "DNC", "DNT"]
# Further communities that a scheme for the first one admits.
ADMITTED = {"BC": ["MBC", "DNC"], "OBC": ["BC", "MBC"]}


def occupation(parent: Column, occupation_named: Column) -> Column:
    """Whether a parent is an agricultural labourer; a named occupation stands for the missing answer."""
    return F.when(parent.isNull() & occupation_named.isNotNull(), F.lit(True)).otherwise(parent)


def answers(caps: Column) -> dict[str, Column]:
    """What each criterion reads of a student; null where the answer is unknown or never refuses."""
    named = (lambda c: F.when(present(F.col(c)) & (F.col(c) != "All"), F.lower(c)))
    flag = (lambda c: F.col(c).cast("string"))
    quota = F.lower(F.coalesce("quota_type", F.lit("unknown")))
    asked = is_true(F.upper("category").isin(QUOTA_COMMUNITIES)) & (quota != "unknown")
    return {
        "gender": F.when(present(F.col("gender")) & (F.col("gender") != "All"), F.col("gender")),
        "income": F.when(F.col("income").isNotNull(), F.size(F.filter(caps, lambda c: c < F.col("income"))).cast("string")),
        "category": F.when(present(F.col("category")), F.upper("category")),
        "state": F.when(present(F.col("state")), F.lower("state")),
        "district": named("district"), "course": named("course"),
        "disability": flag("disabled"), "government_school": flag("govt_school"),
        "parent_occupation": occupation(F.col("agri_labor"), F.col("parent_occupation")).cast("string"),
        "armed_forces": flag("armed_forces"), "first_graduate": flag("first_graduate"),
        "admission_quota": F.when(asked, F.when(quota == "management", "refused").otherwise("open")),
    }


def accepted() -> dict[str, Column]:
    """Array of the values a scheme accepts for each criterion; null where it refuses nobody who answers."""
    category = F.upper("category")
    admitted = F.when(category == "BC", F.array(*map(F.lit, ADMITTED["BC"]))).when(
        category == "OBC", F.array(*map(F.lit, ADMITTED["OBC"]))).otherwise(F.array().cast("array<string>"))
    flag = (lambda c: F.when(is_true(F.col(c)), F.array(F.lit("true"))))
    return {
        "gender": F.when(restricted(F.col("gender"), "All"), F.array("gender")),
        "category": F.when(restricted(F.col("category"), "All", "all") & (category != "ALL"),
                           F.concat(F.array(category), admitted)),
        "state": F.when(restricted(F.col("state"), "All", "All-India", "All-India / National"), F.array(F.lower("state"))),
        "district": F.when(restricted(F.col("district"), "All"), F.array(F.lower("district"))),
        "course": F.when(restricted(F.col("course"), "All"), F.array(F.lower("course"))),
        "disability": flag("requires_disability"), "government_school": flag("requires_govt_school"),
        "parent_occupation": flag("requires_agri_labor"), "armed_forces": flag("requires_armed_forces"),
        "first_graduate": flag("requires_first_graduate"),
        "admission_quota": F.when(is_true(F.col("requires_govt_quota")), F.array(F.lit("open"))),
    }


def numbered_schemes(schemes: DataFrame) -> DataFrame:
    """Schemes with their number, word and bit.  Only ids go through the one ordered task."""
    ids = schemes.select("scheme_id").distinct().withColumn("_number", F.row_number().over(W.orderBy("scheme_id")) - 1)
    number = F.col("_number")
    return schemes.join(ids, "scheme_id").withColumn("_word", F.floor(number / WORD).cast("int")).withColumn(
        "_bit", F.call_function("shiftleft", F.lit(1).cast("long"), number % WORD))


def _capped() -> Column:
    return F.col("income_limit").isNotNull() & (F.col("income_limit") != lexicon.NO_INCOME_CAP)


def postings(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(criterion, word, asked): schemes that can refuse by it; (criterion, value, word, accepts): those that do not."""
    listed = numbered.select("_word", "_bit", F.inline(F.array(*[
        F.struct(F.lit(c).alias("criterion"), v.alias("values")) for c, v in accepted().items()]))).where("values is not null")
    by_value = listed.select("criterion", F.explode("values").alias("value"), "_word", "_bit").groupBy(
        "criterion", "value", "_word").agg(F.bit_or("_bit").alias("accepts"))
    capped = numbered.where(_capped())
    caps = capped.groupBy(F.col("income_limit").alias("cap"), "_word").agg(F.bit_or("_bit").alias("accepts"))
    places = capped.select(F.col("income_limit").alias("cap")).distinct().withColumn(
        "place", F.dense_rank().over(W.orderBy("cap")) - 1)
    # An income in front of ceiling k is accepted by the schemes with that ceiling or a higher one.
    grid = places.join(capped.select("_word").distinct()).join(caps, ["cap", "_word"], "left")
    upwards = W.partitionBy("_word").orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, W.currentRow)
    by_income = grid.select(F.lit("income").alias("criterion"), F.col("place").cast("string").alias("value"), "_word",
                            F.bit_or(F.coalesce("accepts", F.lit(0).cast("long"))).over(upwards).alias("accepts"))
    asked = listed.groupBy("criterion", "_word").agg(F.bit_or("_bit").alias("asked")).unionByName(
        capped.groupBy(F.lit("income").alias("criterion"), "_word").agg(F.bit_or("_bit").alias("asked")))
    return asked, by_value.unionByName(by_income)


def open_pairs(students: DataFrame, schemes: DataFrame) -> DataFrame:
    """``student`` and ``scheme`` structs of every pair in which no criterion fails.

    Rows grow with these pairs and with profiles; what is asked of a pair beyond that (unknown answers, score) is
    evaluated afterwards.  Equal scheme ids count as one scheme only if their rows are equal.
    """
    numbered = numbered_schemes(schemes)
    asked, accepts = postings(numbered)
    caps = F.coalesce(numbered.where(_capped()).agg(F.sort_array(F.collect_set("income_limit")).alias("caps")).scalar(),
                      F.array().cast("array<bigint>"))
    told = students.withColumn("_caps", caps)
    profile = F.struct(*[v.alias(c) for c, v in answers(F.col("_caps")).items()])
    told = told.select(F.struct(*students.columns).alias("student"), profile.alias("profile"))
    profiles = told.select("profile").distinct()
    values = profiles.select("profile", F.inline(F.array(*[
        F.struct(F.lit(c).alias("criterion"), F.col(f"profile.{c}").alias("value")) for c in answers(F.lit(None))])))
    refused = (values.where("value is not null").join(asked, "criterion").join(accepts, ["criterion", "value", "_word"], "left")
               .select("profile", "_word", F.lit(0).cast("long").alias("every"), F.col("asked").bitwiseAND(
                   F.bitwise_not(F.coalesce("accepts", F.lit(0).cast("long")))).alias("refused")))
    words = numbered.groupBy("_word").agg(F.bit_or("_bit").alias("every")).agg(
        F.collect_list(F.struct("_word", "every")).alias("words")).scalar()
    every = profiles.withColumn("_words", words).select("profile", F.inline("_words")).withColumn("refused", F.lit(0).cast("long"))
    left = every.unionByName(refused).groupBy("profile", "_word").agg(F.bit_or("every").alias("every"), F.bit_or("refused").alias("refused"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(
        F.col("every").bitwiseAND(F.bitwise_not("refused")), b) == 1)
    found = left.select("profile", "_word", F.explode(bits).alias("_place")).select(
        "profile", (F.col("_word") * WORD + F.col("_place")).alias("_number"))
    named = numbered.select("_number", F.struct(*schemes.columns).alias("scheme"))
    return told.join(found, "profile").join(named, "_number").select("student", "scheme")
