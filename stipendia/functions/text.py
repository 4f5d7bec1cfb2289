"""Tokens, word-level distance, masking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stipendia.functions import lexicon
from stipendia.functions.scalars import first_case, is_true, kept, matches, regex


def word_list(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+")


def tokens(text: Column) -> Column:
    """Words longer than two characters."""
    return F.filter(word_list(text), lambda w: F.length(w) > 2)


def content_tokens(text: Column) -> Column:
    """Distinct words of two or more characters that are no stop words, in order of first use."""
    stop = F.array(*[F.lit(w) for w in lexicon.STOP_WORDS])
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"\w\w+"), F.lit(0)), stop)


def query_key(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), "[?.,!]", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over words.

    Each distinct word of the pair becomes one code point, so the built-in
    character distance counts word edits.
    """
    vocabulary = F.array_distinct(F.concat(a, b))

    def encode(words: Column) -> Column:
        def code(w: Column) -> Column:
            point = F.hex(F.array_position(vocabulary, w) + F.lit(0x10000))
            return F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32")
        return F.array_join(F.transform(words, code), "")

    return F.levenshtein(encode(a), encode(b))


def mask_identity(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits) == 12, F.concat(F.lit("XXXX-XXXX-"), F.right(digits, F.lit(4)))).otherwise(
        F.trim(value))


def mask_account(value: Column) -> Column:
    v = F.trim(value)
    hidden = F.repeat(F.lit("X"), F.greatest(F.lit(4), F.length(v) - 4))
    return F.when(F.length(v) > 4, F.concat(hidden, F.right(v, F.lit(4)))).otherwise(v)


def mask_identities_in_text(text: Column) -> Column:
    """Every 12-digit number of a text, grouped by four or not, keeps its last four digits."""
    return F.regexp_replace(text, regex(r"\b\d{4}[ -]?\d{4}[ -]?(\d{4})\b"), "XXXX-XXXX-$1")


def entities(text: Column) -> Column:
    low = F.lower(text)
    return kept([(matches(low, rf"\b{e.lower()}\b", ""), F.lit(e)) for e in lexicon.ENTITIES])


def confidence_score(engine: Column, pattern: Column, proximity: Column, validity: Column) -> Column:
    """struct(score, status, uncertain) of the weighted field confidence."""

    def part(value: Column, default: int) -> Column:
        known = F.coalesce(F.nullif(value.cast("double"), F.lit(0.0)), F.lit(float(default)))
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), known))

    raw = (part(engine, 75) * 0.35 + part(pattern, 70) * 0.25 + part(proximity, 50) * 0.20
           + part(validity, 80) * 0.20)
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(raw + 0.5).cast("int")))
    return F.struct(score.alias("score"), field_status(score).alias("status"),
                    is_true(score < 70).alias("uncertain"))


def field_status(score: Column) -> Column:
    return first_case([(score >= 90, "high"), (score >= 70, "medium"), (score >= 50, "low")], "unreliable")
