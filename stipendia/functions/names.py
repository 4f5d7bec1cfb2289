"""Personal names: clean-up, comparison ladder, plausibility and anomalies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions import lexicon
from stipendia.functions.scalars import (any_of, extract, filled, first_case, is_true, kept, let, matches,
                                         present, regex, replace_all)

_HONORIFIC = (r"^(?:(?:" + "|".join(re.escape(h) for h in lexicon.HONORIFICS)
              + r")(?:\.|\b)\s*)+")


def strip_honorifics(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(name), regex(_HONORIFIC, "i"), ""))


def clean_name(name: Column) -> Column:
    """Name without salutations and OCR punctuation, single spaces."""
    return F.trim(replace_all(strip_honorifics(name), (r"^[:\-–—.]\s*", ""),
                              (r"[^a-zA-Z0-9\s.'-]", " "), (r"\s+", " ")))


def sorted_tokens(name: Column) -> Column:
    """Word-order free key of a name."""
    words = F.filter(F.split(F.lower(clean_name(name)), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def title_name(name: Column) -> Column:
    """Title case that keeps single-letter initials upper case."""

    def word(part: Column) -> Column:
        letters = F.regexp_replace(part, "[^A-Za-z]", "")
        return (F.when(letters == "", part)
                .when(F.length(letters) == 1, F.upper(letters))
                .otherwise(F.concat(F.upper(F.substring(letters, 1, 1)),
                                    F.lower(F.substr(letters, F.lit(2))))))

    return F.array_join(F.transform(F.split(clean_name(name), r"\s+"), word), " ")


def name_tokens(name: Column) -> Column:
    """Lower-case comparison tokens, punctuation stripped at both ends."""
    edges = r"""[.,\-_/\\#;:'"]+"""
    words = F.transform(F.split(F.lower(clean_name(name)), r"\s+"),
                        lambda w: F.regexp_replace(w, f"^{edges}|{edges}$", ""))
    return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w != "")


def letters_key(name: Column) -> Column:
    """Upper-case letters only, digits first read as the letters they resemble."""
    repaired = F.translate(name, "".join(lexicon.DIGIT_LETTERS), "".join(lexicon.DIGIT_LETTERS.values()))
    return F.regexp_replace(F.upper(repaired), "[^A-Z]", "")


def evaluation_key(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9]", "")


def simple_name(name: Column) -> Column:
    """Upper case letters and single blanks (readiness checks)."""
    return replace_all(F.upper(F.trim(name)), (r"[^A-Z\s]", ""), (r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """Share of characters kept under the edit distance; 0 when one side is empty."""
    longest = F.greatest(F.length(a), F.length(b)).cast("double")
    return F.when(present(a) & present(b), (longest - F.levenshtein(a, b)) / longest).otherwise(F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    pair = F.struct(simple_name(a).alias("a"), simple_name(b).alias("b"))
    return let(pair, lambda p: similarity(p["a"], p["b"]))


# --- comparison ladder --------------------------------------------------------------------------

def _take_first(tokens: Column, start: Column, choose) -> Column:
    """Walk ``tokens`` in order; each takes at most one token still left on the other side.

    ``choose(token, left)`` gives the 1-based position taken (0 = none).  The
    result holds the tokens left, how many tokens found a partner and how many
    partners were not literally equal.
    """
    state = F.struct(start.alias("left"), F.lit(0).alias("hits"), F.lit(0).alias("loose"))

    def step(acc: Column, token: Column) -> Column:
        left = acc["left"]
        exact = F.array_position(left, token)
        pos = F.when(exact > 0, exact).otherwise(choose(token, left))
        return F.struct(
            F.filter(left, lambda _, i: (i + 1) != pos).alias("left"),
            (acc["hits"] + F.when(pos > 0, 1).otherwise(0)).alias("hits"),
            (acc["loose"] + F.when((pos > 0) & (exact == 0), 1).otherwise(0)).alias("loose"))

    return F.aggregate(tokens, state, step)


def _position(left: Column, predicate) -> Column:
    return F.array_position(F.transform(left, predicate), True)


def _initial_of(token: Column, left: Column) -> Column:
    return _position(left, lambda other: F.when(
        F.length(token) == 1, (F.length(other) > 1) & F.startswith(other, token)).otherwise(
        (F.length(other) == 1) & F.startswith(token, other)))


def _near(token: Column, left: Column) -> Column:
    initial = F.when(F.length(token) == 1, _position(
        left, lambda other: (F.length(other) > 1) & F.startswith(other, token))).otherwise(F.lit(0))
    typo = F.when(F.length(token) >= 4, _position(
        left, lambda other: (F.length(other) >= 4) & (F.levenshtein(other, token) <= 1))).otherwise(F.lit(0))
    return F.when(initial > 0, initial).otherwise(typo)


def _join(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def with_name_match(df: DataFrame, a: str, b: str, strict: Column | bool = False,
                    prefix: str = "name") -> DataFrame:
    """Add ``<prefix>_status`` and ``<prefix>_score`` for the two name columns.

    The levels run from literal equality to edit distance.  Helper columns are
    staged in separate projections so that each is computed once per row.
    """
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    before = df.columns
    staged = df.select("*", name_tokens(F.col(a)).alias("_ta"), name_tokens(F.col(b)).alias("_tb"), strict.alias("_strict"))
    a_shorter = F.size("_ta") <= F.size("_tb")
    staged = staged.select(
        "*", ((F.size("_ta") > 0) & (F.size("_tb") > 0)).alias("_known"), _join(F.col("_ta")).alias("_sa"), _join(F.col("_tb")).alias("_sb"),
        (_join(F.array_sort("_ta")) == _join(F.array_sort("_tb"))).alias("_reordered"),
        F.when(a_shorter, F.col("_ta")).otherwise(F.col("_tb")).alias("_short"),
        F.when(a_shorter, F.col("_tb")).otherwise(F.col("_ta")).alias("_long"))

    words = {s: F.filter(F.col(s), lambda t: F.length(t) > 1) for s in ("_ta", "_tb")}
    initials = {s: F.size(F.filter(F.col(s), lambda t: F.length(t) == 1)) for s in ("_ta", "_tb")}
    same_words = ((F.size(words["_ta"]) > 0) & (F.size(words["_tb"]) > 0)
                  & (_join(F.array_sort(words["_ta"])) == _join(F.array_sort(words["_tb"]))))
    one_sided = (initials["_ta"] > 0) != (initials["_tb"] > 0)
    # token walks only run for pairs the cheap levels leave open
    open_case = F.col("_known") & ~F.col("_reordered")
    staged = staged.select(
        "*", (F.col("_sa") == F.col("_sb")).alias("_equal"),
        F.when(open_case, same_words & one_sided).otherwise(False).alias("_initial_only"),
        F.when(open_case & (F.size("_ta") == F.size("_tb")), _take_first(F.col("_ta"), F.col("_tb"), _initial_of)).alias("_exp"),
        F.when(open_case, _take_first(F.col("_short"), F.col("_long"), _near)).alias("_fit"),
        F.when(F.col("_known"), 1.0 - F.levenshtein("_sa", "_sb").cast("double")
               / F.greatest(F.length("_sa"), F.length("_sb"), F.lit(1))).alias("_sim"))

    expansion = is_true((F.col("_exp.hits") == F.size("_ta")) & (F.col("_exp.loose") > 0)
                        & (F.size(F.col("_exp.left")) == 0))
    extra = is_true((F.col("_fit.hits") == F.size("_short")) & (F.size(F.col("_fit.left")) > 0))
    close = is_true(F.col("_sim") >= 0.85)
    status = first_case([
        (~F.col("_known"), "MISSING"),
        (F.col("_equal") | F.col("_reordered"), "EXACT_MATCH"),
        (F.col("_initial_only") & F.col("_strict"), "LIKELY_MATCH"),
        (F.col("_initial_only"), "EXACT_MATCH"),
        (expansion, "LIKELY_MATCH"),
        (extra, "NEEDS_REVIEW"),
        (close & F.col("_strict"), "MINOR_DIFFERENCE"),
        (close, "LIKELY_MATCH"),
    ], "MISMATCH")
    score = first_case([
        (~F.col("_known"), 0.0), (F.col("_equal"), 1.0), (F.col("_reordered"), 0.98),
        (F.col("_initial_only") & F.col("_strict"), 0.92), (F.col("_initial_only"), 0.95),
        (expansion, 0.90), (extra, 0.65),
        (close & F.col("_strict"), F.least(F.col("_sim"), F.lit(0.90))), (close, F.col("_sim")),
    ], F.greatest(F.lit(0.0), F.col("_sim")))
    return staged.select(*before, status.alias(f"{prefix}_status"), score.alias(f"{prefix}_score"))


def standard_status(status: Column) -> Column:
    """The five reader-facing words for a comparison status."""
    return first_case([
        (status.isin("EXACT_MATCH", "MATCH"), "Consistent"),
        (status.isin("LIKELY_MATCH", "MINOR_DIFFERENCE", "NEEDS_REVIEW", "WARNING", "UNREADABLE"),
         "Needs confirmation"),
        (status.isin("MISMATCH", "FAIL", "EXPIRED"), "Possible mismatch"),
        (status.isin("MISSING", "PENDING", "INCOMPLETE"), "Missing information"),
        (status.isin("NOT_APPLICABLE", "NA"), "Not applicable"),
    ], "Needs confirmation")


# --- plausibility of an extracted name ----------------------------------------------------------

# Texts that are labels, not names.
_LABEL_ONLY = (
    r"^(?:of\s+the\s+(?:candidate|candioate|candiate|student)"
    r"|name\s+of\s+(?:the\s+)?(?:candidate|candioate|candiate|student)"
    r"|candidate|candioate|candiate|student|name|the\s+candidate|secondary\s+school"
    r"|higher\s+secondary|board|certificate|statement\s+of\s+marks|member|family\s*member|pn\s*mity"
    r"|hr\s+ir\s+om|nil|null|na|date\s+of\s+birth|permanent\s+register\s+number|register\s+number"
    r"|roll\s+number|total\s+marks|total|name\s+of\s+the\s+school|issue|issue\s+date"
    r"|registration\s+number|certificate\s+number|passing\s+year)$")
LABEL_WORDS = (
    r"\b(?:total|marks|result|board|school|college|certificate|statement|examination|subject|secondary"
    r"|higher\s+secondary|government\s+of|department\s+of|vidyalaya|academy|date\s+of\s+birth"
    r"|permanent\s+register|register\s+number|roll\s+number|born\s+on|issue\s+date"
    r"|certificate\s+number|registration\s+number|passing\s+year)\b")
ROLE_WORDS = (r"\b(?:HEADMASTER|PRINCIPAL|TAHSILDAR|SECRETARY|OFFICER|DIRECTOR|MINISTER|GOVERNMENT"
              r"|BOARD|EXAMINATIONS|REVENUE|INSPECTOR|COLLECTOR|MAGISTRATE)\b")
_MONTH_ONLY = (r"^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?"
               r"|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$")
_NOISE_WORD = (r"^(?:of|the|name|class|school|college|board|exam|examination|certificate|marks|result"
               r"|member|family|hr|ir|om|table|sl|no)$")
_STOP_TAIL = (
    r"\s+\b(?:FATHER|MOTHER|PARENT|GUARDIAN|DOB|DATE\s*OF\s*BIRTH|BORN|PERMANENT|REGISTER|REGISTRATION"
    r"|REG|ROLL|SCHOOL|INSTITUTION|COLLEGE|SEX|GENDER|MALE|FEMALE|COMMUNITY|CASTE|CATEGORY|TALUK"
    r"|DISTRICT|SESSION|DATE|HSS|SEC|MATRIC|EXAMINATION|MARK|MARKS|CERTIFICATE|STATEMENT"
    r"|OF\s+ISSUE)\b.*$")
_NAME_LABEL = (
    r"^\s*(?:name\s*of\s*(?:the\s*)?(?:candidate|student|applicant)|candidate'?s?\s*name"
    r"|student'?s?\s*name|applicant'?s?\s*name|beneficiary'?s?\s*name|name)\s*[:\-–—]?\s*")
_TRAILING_NOISE = (r"^(?:EXTRA|EXT|EXAM|EXAMINATION|COPY|PAGE|NO|SL|STD|CLASS|PASS|FAIL|STATE|BOARD"
                   r"|GOVT|TEST|DEMO|SAMPLE|SCHOOL|INSTITUTE|COLLEGE)$")
_GARBLED = r"\b(?:Gub|psiu|eGau|sgew|Quip)\w*"
_CONSONANTS = "bcdfghjklmnpqrstvwxz"


def candidate_text(value: Column) -> Column:
    """Text after a name label, cut where the next label starts."""
    v = F.regexp_replace(value, r"^[|()\[\]{};=»_–—\s]+|[|()\[\]{};=»_–—\s]+$", "")
    for pattern, flags in [
        (r"^[^A-Za-z0-9]+", ""),
        (r"^(?:Pe\s+|Nm\s+|De\s+|La\s+|No\.?\s+|Sl\.?\s+)", "i"),
        (r"[^\x20-\x7E\s]", ""),
        (r"(?:^|\s+)(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\w*(?:\s+\d{2,4})?.*$", "i"),
        (_STOP_TAIL, "i"),
        (r"\s+(?:son\s+of|daughter\s+of|residing\s+at|r/o|d/o|s/o|w/o)\b.*$", "i"),
        (r"\s+\d{4,}.*$", ""),
        (r"[^A-Za-z0-9.'-]+$", ""),
        (_NAME_LABEL, "i"),
        (r"^\s*(?:mr|mrs|ms|miss|kumari|selvan|selvi|thiru|tmt|sri|smt|thirumathi|thirumati|km)\.?\s+", "i"),
        (r"(?<=\S\s\S{1,30})(?:\s+(?:TO|T0|NO|SL|SLNO))+$", "i"),
    ]:
        v = F.regexp_replace(v, regex(pattern, flags), "")
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def _letters(word: Column) -> Column:
    return F.regexp_replace(word, "[^A-Za-z]", "")


def is_plausible_name(clean: Column) -> Column:
    """Whether cleaned text reads as a personal name."""
    def word_ok(word: Column) -> Column:
        return let(_letters(word), lambda letters: shape_ok(letters)) & word.rlike(r"^[A-Za-z.'-]+$")

    def shape_ok(letters: Column) -> Column:
        single = F.length(letters) <= 1
        run4 = letters.rlike(f"(?i)[{_CONSONANTS}]{{4,}}") & ~letters.rlike("(?i)kshm|rshn|kshr|ndrs|rthm|rshm")
        good = (letters.rlike("(?i)[aeiouy]") & ~letters.rlike(f"(?i)[{_CONSONANTS}]{{5,}}")
                & ~run4 & ~letters.rlike(r"([A-Za-z])\1\1"))
        return F.when(single, F.length(letters) == 1).otherwise(good)

    def words_ok(words: Column) -> Column:
        return (F.size(words).between(1, 6) & ~F.forall(words, lambda w: w.rlike("(?i)" + _NOISE_WORD))
                & F.exists(words, lambda w: F.length(w) >= 3) & F.forall(words, word_ok))

    return let(clean, lambda c: is_true(
        F.length(c).between(3, 70) & ~c.rlike(r"\d") & ~matches(c, _LABEL_ONLY) & ~matches(c, LABEL_WORDS)
        & ~matches(c, _MONTH_ONLY) & let(F.filter(F.split(c, r"\s+"), lambda w: w != ""), words_ok)))


def surplus_token(clean: Column) -> Column:
    """The token that does not belong to a name, NULL when none stands out."""

    def find(words: Column) -> Column:
        def after_initial(word: Column, i: Column) -> Column:
            earlier = F.exists(F.slice(words, 1, i), lambda w: F.length(_letters(w)) >= 2)
            following = F.get(words, i + 1)
            return F.when((i > 0) & (F.length(_letters(word)) == 1) & earlier
                          & (F.length(_letters(following)) > 1), F.regexp_replace(following, "[^A-Za-z0-9]", ""))

        last = _letters(F.get(words, F.size(words) - 1))
        inner = F.get(F.filter(F.transform(words, after_initial), lambda w: w.isNotNull()), 0)
        return F.when(F.size(words) > 1, F.coalesce(inner, let(last, lambda end: F.coalesce(
            F.when(end.rlike("(?i)" + _TRAILING_NOISE), F.upper(end)),
            F.when((F.size(words) >= 3) & matches(end, ROLE_WORDS), end)))))

    return let(F.filter(F.split(F.trim(clean), r"\s+"), lambda w: w != ""), find)


def candidate_score(raw: Column, clean: Column, near_label: bool = True,
                    ocr_confidence: Column | None = None) -> Column:
    """Additive score of a plausible name, -1 otherwise."""
    engine = F.lit(0)
    if ocr_confidence is not None:
        engine = F.coalesce(first_case([(ocr_confidence >= 85, 15), (ocr_confidence < 60, -25)], 0), F.lit(0))
    outside = engine + F.when(raw.rlike(r"[-–—_~`|/\\]"), -20).otherwise(0)

    def score(c: Column) -> Column:
        caps = first_case([(c.rlike(r"^[A-Z\s.]+$"), 35), (c.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"), 10)], -30)
        shape = first_case([
            (c.rlike(r"(?i)^[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+[A-Z]\.?$"), 20),
            (c.rlike(r"(?i)^[A-Z]\.?\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*$"), 20),
            (c.rlike(r"(?i)^[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,3}$"), 15),
            (c.rlike(r"(?i)^[A-Z][A-Za-z]{2,}$"), 10)], 0)
        total = (F.lit(50 + (15 if near_label else 0)) + caps + shape + outside
                 + F.when(matches(c, _GARBLED), -60).otherwise(0))
        capped = F.when(surplus_token(c).isNotNull(), F.least(total, F.lit(65))).otherwise(total)
        return F.when(is_plausible_name(c), capped).otherwise(F.lit(-1))

    return let(clean, score)


def resolve_candidate(raw: Column, ocr_confidence: Column) -> Column:
    """struct(value, suggested, confidence, status) for one extracted name."""
    conf = ocr_confidence.cast("double")
    weak = is_true((conf < 70) & ((conf > 1) | (conf < 0.70)))
    whole = F.floor(conf + 0.5).cast("int")

    def facts(clean: Column) -> Column:
        repaired = F.translate(clean, "".join(lexicon.DIGIT_LETTERS_WIDE), "".join(lexicon.DIGIT_LETTERS_WIDE.values()))
        return F.struct(clean.alias("clean"), repaired.alias("repaired"), is_plausible_name(clean).alias("good"),
                        (clean.rlike(r"\d") & is_plausible_name(repaired)).alias("digits"),
                        surplus_token(clean).isNotNull().alias("odd"))

    def verdict(f: Column) -> Column:
        clean, good, odd, digits = f["clean"], f["good"], f["odd"], f["digits"]
        status = first_case([
            (~present(clean), "NOT_DETECTED"), (odd, "NEEDS_REVIEW"), (good & weak, "NEEDS_REVIEW"),
            (good, "HIGH_CONFIDENCE"), (digits, "NEEDS_REVIEW")], "NOT_DETECTED")
        confidence = first_case([
            (~present(clean), F.lit(0)), (odd, F.lit(65)), (good & weak, whole),
            (good & whole.isNull(), F.lit(90)), (good, F.least(F.lit(98), F.greatest(F.lit(75), whole))),
            (digits, F.lit(68))], F.lit(35))
        suggested = first_case([(odd | good, title_name(clean)), (digits, title_name(f["repaired"]))],
                               F.lit(None).cast("string"))
        return F.struct(clean.alias("value"), suggested.alias("suggested"),
                        confidence.alias("confidence"), status.alias("status"))

    return let(let(candidate_text(raw), facts), verdict)


# --- reading suggestions ------------------------------------------------------------------------

def name_suggestions(raw: Column) -> Column:
    """Alternative readings of an OCR name: digits, ``rn`` for m, ``cl`` for d."""
    v = F.trim(raw)
    digits = F.translate(v, "".join(lexicon.DIGIT_LETTERS_WIDE), "".join(lexicon.DIGIT_LETTERS_WIDE.values()))
    rn = replace_all(v, ("r[nN]", "m"), ("R[nN]", "M"))
    cl = replace_all(v, ("c[lL]", "d"), ("C[lL]", "D"))
    return F.array_distinct(kept([(v.rlike(r"\d") & (digits != v), digits), (rn != v, rn), (cl != v, cl)]))


def id_suggestion(raw: Column) -> Column:
    v = F.trim(raw)
    fixed = replace_all(v, (r"^([A-Z]{2,4})O(\d+)", "$1" + "0$2"), (r"([0-9])O([0-9])", "$1" + "0$2"),
                        (r"([0-9])I([0-9])", "$1" + "1$2"), (r"([0-9])l([0-9])", "$1" + "1$2"),
                        (r"^([A-Z]+-)l(\d+)", "$1" + "1$2"))
    doubtful = any_of([v.rlike(p) for p in (r"[0-9][OI][0-9]", r"^[A-Z]{2,4}O\d{3,}", r"[0-9]l[0-9]",
                                            r"^[A-Z]{2,4}-l\d+")])
    return F.when(doubtful & (fixed != v), fixed)


def date_suggestion(raw: Column) -> Column:
    v = F.trim(raw)
    fixed = F.translate(v, "OoBIS", "00815")
    return F.when(v.rlike("(?i)[OBIS]") & v.rlike(r"\d") & (fixed != v)
                  & fixed.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$"), fixed)


# --- institutions -------------------------------------------------------------------------------

# Abbreviations of institution names, applied in this order.
_INSTITUTION_STEPS = [
    (r"\bH\.?\s*S\.?\s*S\.?\b", "HSS"), (r"\bGOVT\.?\b", "GOVT"), (r"\bENGG?\.?\b", "ENG"),
    (r"\bTECH\.?\b", "TECH"), (r"\bCOLL?\.?\b", "COLL"), (r"[.,/#!$%^&*;:{}=\-_`~()]", " "),
    (r"\bHIGHER\s+SECONDARY\s+SCHOOL\b", "HSS"), (r"\bHR\s*SEC\s*SCHOOL\b", "HSS"),
    (r"\bHR\s*SEC\b", "HSS"), (r"\bMATRICULATION\s+SCHOOL\b", "MATRIC SCHOOL"),
    (r"\bMATRICULATION\b", "MATRIC"), (r"\bGOVERNMENT\b", "GOVT"), (r"\bENGINEERING\b", "ENG"),
    (r"\bTECHNOLOGY\b", "TECH"), (r"\bCOLLEGE\b", "COLL"), (r"\bCORPORATION\b", "CORP"),
    (r"\bMUNICIPAL\b", "MUN"), (r"\s+", " "),
]


def institution_key(name: Column) -> Column:
    return F.trim(replace_all(F.upper(name), *_INSTITUTION_STEPS))


def institution_match(a: Column, b: Column) -> Column:
    """struct(score, status) from the share of common words."""
    keys = F.struct(institution_key(a).alias("a"), institution_key(b).alias("b"),
                    (~(present(a) & present(b))).alias("missing"))
    return let(keys, _institution_verdict)


def _institution_verdict(k: Column) -> Column:
    ka, kb, missing = k["a"], k["b"], k["missing"]
    wa, wb = (F.filter(F.split(v, " "), lambda w: F.length(w) > 2) for v in (ka, kb))
    common = F.size(F.filter(wa, lambda w: F.array_contains(wb, w))).cast("double")
    overlap = common / F.greatest(F.size(wa), F.size(wb), F.lit(1))
    usable = (F.size(wa) > 0) & (F.size(wb) > 0)
    status = first_case([(missing, "MISSING"), (ka == kb, "MATCH"), (~usable, "DIFFERENT"),
                         (overlap >= 0.70, "MATCH"), (overlap >= 0.45, "LIKELY")], "DIFFERENT")
    score = first_case([(missing, 0.0), (ka == kb, 1.0), (~usable, 0.0)],
                       F.floor(overlap * 100.0 + 0.5) / 100.0)
    return F.struct(score.alias("score"), status.alias("status"))


def label_value(text: Column, labels: str) -> Column:
    """Text to the right of a label on the same line."""
    return F.trim(filled(extract(text, rf"(?:{labels})\s*[:\-–—]?\s*([A-Z][A-Za-z .'-]{{2,60}})")))
