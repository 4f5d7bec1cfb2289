"""Document tables: type, title, state, authority, duplicates, quality gate.

Whole texts are scanned.  One scan finds the literal anchors of all patterns of
a job (``functions.anchored``), and a pattern is tried on texts with one of its
anchors only.  A title says where it stands, so that a caller who wants titles
at the top of a page alone can filter on that.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions import doc_rules
from stipendia.functions.anchored import Anchored
from stipendia.functions.scalars import contains_pattern, first_case, is_true, kept, let, matches, regex, replace_all
from stipendia.operators.frames import balanced, with_key_count


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


_PLACES = [p for _, ps in doc_rules.STATES for p in ps]
_OFFICES = [p for _, p in doc_rules.AUTHORITIES]
_TYPES = [p for rules in doc_rules.TYPE_RULES.values() for p, _, _ in rules]
STATE_ANCHORS, AUTHORITY_ANCHORS, TYPE_ANCHORS = Anchored(_PLACES), Anchored(_OFFICES), Anchored(_TYPES + _PLACES + _OFFICES)


def state_of(text: Column) -> Column:
    """struct(state, state_confidence): the first state with any of its words."""
    return let(F.lower(text), lambda low: let(STATE_ANCHORS.scan(low), lambda found: _state_in(low, found, STATE_ANCHORS)))


def _state_in(low: Column, found: Column, known: Anchored) -> Column:
    def has(pattern: str) -> Column:
        return known.possible(found, pattern) & contains_pattern(low, pattern)

    def named(name: str, patterns: list[str]) -> tuple[Column, Column]:
        n = reduce(add, [has(p).cast("int") for p in patterns])
        return (known.possible(found, *patterns) & reduce(or_, [has(p) for p in patterns]),
                F.struct(F.lit(name).alias("state"), F.least(F.lit(98), F.lit(70) + n * 14).alias("state_confidence")))

    return first_case([named(name, ps) for name, ps in doc_rules.STATES],
                      F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("state_confidence")))


def authority_of(text: Column) -> Column:
    return let(F.lower(text), lambda low: let(AUTHORITY_ANCHORS.scan(low), lambda found: _authority_in(low, found, AUTHORITY_ANCHORS)))


def _authority_in(low: Column, found: Column, known: Anchored) -> Column:
    return first_case([(known.possible(found, p) & contains_pattern(low, p), n) for n, p in doc_rules.AUTHORITIES],
                      F.lit(None).cast("string"))


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add type, confidence, reasons, per-type scores, state and authority."""
    rows = balanced(docs).withColumn("_clean", F.lower(squeezed(F.col(text)))).withColumn("_anchors", TYPE_ANCHORS.scan(F.col("_clean")))
    found = F.col("_anchors")
    signals = {t: F.array(*[F.when(TYPE_ANCHORS.possible(found, p) & contains_pattern(F.col("_clean"), p),
                                   F.struct(F.lit(w).alias("w"), F.lit(r).alias("r")))
                            for p, w, r in rules]) for t, rules in doc_rules.TYPE_RULES.items()}
    for kind, signal in signals.items():
        rows = rows.withColumn(f"_s_{kind}", F.filter(signal, lambda x: x.isNotNull()))
    kinds = list(doc_rules.TYPE_RULES)
    scored = F.array(*[F.struct(
        F.aggregate(f"_s_{k}", F.lit(0), lambda acc, x: acc + x["w"]).alias("score"), F.lit(-i).alias("place"),
        F.lit(k).alias("type"), F.transform(f"_s_{k}", lambda x: x["r"]).alias("reasons")) for i, k in enumerate(kinds)])
    rows = rows.withColumn("_ranked", F.sort_array(scored, asc=False))
    top, second = F.get("_ranked", 0), F.get("_ranked", 1)
    long_enough = F.length("_clean") >= 15
    enough = long_enough & (top["score"] >= doc_rules.TYPE_THRESHOLD)
    margin = top["score"] - second["score"]
    sure = F.least(F.lit(98), F.greatest(F.lit(30), top["score"] * 8))
    mixed = (margin < 3) & (second["score"] >= doc_rules.TYPE_THRESHOLD)
    confidence = first_case([
        (~long_enough, F.lit(0)), (~enough, top["score"] * 10),
        (mixed, F.greatest(F.lit(30), sure - 25))], sure)
    empty = F.array().cast("array<string>")
    rows = (rows.withColumn("doc_type", F.when(enough, top["type"]).otherwise("unknown"))
            .withColumn("confidence", confidence)
            .withColumn("is_confident", is_true(enough & (F.col("confidence") >= 60) & (margin >= 3)))
            .withColumn("mixed_signals", is_true(enough & mixed))
            .withColumn("reasons", F.when(enough, F.slice(top["reasons"], 1, 4)).otherwise(empty))
            .withColumn("scores", F.map_from_entries(F.transform("_ranked", lambda x: F.struct(x["type"], x["score"]))))
            .withColumn("_state", _state_in(F.col("_clean"), found, TYPE_ANCHORS))
            .withColumn("authority", _authority_in(F.col("_clean"), found, TYPE_ANCHORS)))
    return rows.select(*docs.columns, "doc_type", "confidence", "is_confident", "mixed_signals", "reasons", "scores",
                       "_state.state", "_state.state_confidence", "authority")


def slot_check(slot: Column, doc_type: Column, confidence: Column) -> Column:
    """valid, mismatch or unconfident for the slot a document was put in."""
    return first_case([(slot.isNull() | doc_type.isNull() | (doc_type == "unknown") | (confidence < 50), "unconfident"),
                       (doc_type == slot, "valid")], "mismatch")


def suggestion(doc_type: Column, confidence: Column) -> Column:
    """struct(category, suggested, uncertain) for the user to confirm."""
    category = first_case([(doc_type == k, v) for k, v in doc_rules.STANDARD_CATEGORY.items()], "unknown")
    uncertain = (F.coalesce(confidence, F.lit(0)) < 60) | (doc_type == "unknown")
    return F.struct(category.alias("category"), F.when(uncertain, "Other / Unknown").otherwise(category).alias("suggested"),
                    uncertain.alias("uncertain"))


_TITLE_PATTERNS = [p for _, _, _, patterns in doc_rules.TITLES for p in patterns] + [p for p, _ in doc_rules.PARTIAL_TITLES]
TITLE_ANCHORS = Anchored(_TITLE_PATTERNS)


def titles(docs: DataFrame, text: str = "text") -> DataFrame:
    """Document title, a second reading with repaired digits, then weak anchors.

    The whole text is searched.  ``title_at`` is the place of the evidence in the trimmed text, or in its repaired
    reading, counted from 1; null without evidence.
    """
    rows = balanced(docs).withColumn("_text", F.trim(F.coalesce(F.col(text), F.lit(""))))

    def title(kind: str, name: str, confidence: int, evidence: Column, at: Column, sure: bool = True) -> Column:
        return F.struct(F.lit(kind).alias("title_type"), F.lit(name).alias("title"),
                        F.lit(confidence).alias("title_confidence"), F.lit(sure).alias("identified"),
                        evidence.alias("evidence"), at.alias("title_at"))

    def place(source: Column, pattern: str) -> Column:
        return F.regexp_instr(source, F.lit(regex(pattern, "i")))

    def scan(source: Column, found: Column, penalty: int) -> list[tuple[Column, Column]]:
        out = []
        for kind, name, weight, patterns in doc_rules.TITLES:
            for p in patterns:
                sure = weight if penalty == 0 else max(60, weight - penalty)
                out.append((TITLE_ANCHORS.possible(found, p) & matches(source, p), title(
                    kind, name, sure, F.regexp_extract(source, regex(p, "i"), 0), place(source, p))))
        return out

    nothing, nowhere = F.lit(None).cast("string"), F.lit(None).cast("int")
    source, found = F.col("_text"), F.col("_anchors")
    rows = rows.withColumn("_anchors", TITLE_ANCHORS.scan(F.lower("_text"))).withColumn("_first", first_case(scan(source, found, 0), None))
    # the repaired reading is only made and searched where the text itself gave nothing
    fixed = F.when(F.col("_first").isNull(), F.trim(replace_all(source, *doc_rules.TITLE_REPAIRS)))
    rows = rows.withColumn("_fixed", fixed).withColumn("_again", TITLE_ANCHORS.scan(F.lower("_fixed")))
    repaired = first_case(scan(F.col("_fixed"), F.col("_again"), 10), None)
    weak = first_case([(TITLE_ANCHORS.possible(found, p) & matches(source, p), title("unknown", n, 61, F.lit(n), place(source, p), False))
                       for p, n in doc_rules.PARTIAL_TITLES], title("unknown", "Unknown Document", 15, nothing, nowhere, False))
    short = title("unknown", "Unknown Document", 0, nothing, nowhere, False)
    rows = rows.withColumn("_t", F.when(F.length("_text") >= 10, F.coalesce("_first", repaired, weak)).otherwise(short))
    return rows.select(*docs.columns, "_t.*")


def template_of(text: Column) -> Column:
    """struct(template, board, state, template_confidence) of a marksheet text."""
    def row(template: str, board: Column, state: Column, confidence: float) -> Column:
        return F.struct(F.lit(template).alias("template"), board.alias("board"), state.alias("state"),
                        F.lit(confidence).alias("template_confidence"))

    none = F.lit(None).cast("string")
    cases = [(matches(text, p), row(t, F.lit(b), F.lit(s).cast("string"), c)) for t, b, s, c, p in doc_rules.TEMPLATES]
    # the states are only searched in texts that speak of a board or examination
    other = let(state_of(text)["state"], lambda state: F.when(state.isNotNull(), row(
        "state_board", F.concat(state, F.lit(" State Board of School Examinations")), state, 0.85)))
    generic = row("generic", none, none, 0.50)
    cases.append((matches(text, r"board\s+of|examination"), F.coalesce(other, generic)))
    return first_case(cases, generic)


# --- duplicates ----------------------------------------------------------------------------------

def hashed(docs: DataFrame, content: str = "content") -> DataFrame:
    """Documents with the hash of their bytes in place of the bytes."""
    return docs.withColumn("fingerprint", F.sha2(F.col(content).cast("binary"), 256)).drop(content)


def fingerprints(docs: DataFrame, content: str | None = "content") -> DataFrame:
    """Documents with the hash of their bytes and the number of documents sharing it.

    Without ``content`` the documents are ``hashed`` already, as those of several batches are.
    """
    return with_key_count(hashed(docs, content) if content else docs, ["fingerprint"], "copies")


def duplicate_documents(docs: DataFrame, owner: str, slot: str, content: str = "content") -> DataFrame:
    """Documents whose bytes occur again for the same owner, and whether in the same slot.

    Copies are counted per (fingerprint, owner) and per slot; pairs of copies
    are never formed, so a heavily copied document stays cheap.
    """
    per_owner = with_key_count(hashed(docs, content), ["fingerprint", owner], "owner_copies")
    per_slot = with_key_count(per_owner, ["fingerprint", owner, slot], "slot_copies")
    return per_slot.where(F.col("owner_copies") > 1).withColumn(
        "only_same_slot", F.col("owner_copies") == F.col("slot_copies"))


def duplicate_groups(docs: DataFrame, doc_id: str, content: str = "content") -> DataFrame:
    """One row per repeated content with its first document and the number of copies."""
    return (docs.select(doc_id, F.sha2(F.col(content).cast("binary"), 256).alias("fingerprint"))
            .groupBy("fingerprint").agg(F.min(doc_id).alias("first_doc"), F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


# --- quality -------------------------------------------------------------------------------------

# Quality reasons.
LOW_RESOLUTION, BLURRY, DARK, BRIGHT, BLANK = ("low resolution", "blurry", "too dark", "washed out / overexposed",
                                              "low contrast / blank page")
UNREADABLE, LOW_ENGINE = "text not readable", "low OCR confidence"


def quality_gate(scores: DataFrame) -> DataFrame:
    """REJECT, WARN or PASS from measured image scores and the OCR outcome."""
    c = F.col
    text_length = F.length(F.trim(F.coalesce("ocr_text", F.lit(""))))
    reasons = kept([
        ((c("resolution_score") < 35) | ((c("width") > 0) & (c("width") < 350)), F.lit(LOW_RESOLUTION)),
        ((c("sharpness_score") < 30) | is_true(c("laplacian_variance") < 30), F.lit(BLURRY)),
        (c("brightness") < 40, F.lit(DARK)), (c("brightness") > 252, F.lit(BRIGHT)),
        ((c("contrast_score") < 20) | is_true(c("contrast_stddev") < 12), F.lit(BLANK)),
        (c("ocr_text").isNotNull() & (text_length < 15)
         & ~is_true((c("ocr_confidence") != 0) & (c("ocr_confidence") >= 30)), F.lit(UNREADABLE)),
        (c("ocr_confidence") < 25, F.lit(LOW_ENGINE))])
    rows = scores.withColumn("rejection_reasons", reasons)
    has = (lambda r: F.array_contains("rejection_reasons", r))
    severe = (F.size("rejection_reasons") >= 2) | has(UNREADABLE) | has(BLANK)
    gate = first_case([(severe, "REJECT"), ((F.size("rejection_reasons") > 0)
                                            | is_true(c("quality_level") == "fair"), "WARN")], "PASS")
    return rows.withColumn("gate", gate)
