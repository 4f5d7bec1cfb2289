"""Positioned OCR lines: where a value stands, and which line holds the name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.functions.names import candidate_score, candidate_text, title_name
from stipendia.functions.scalars import first_case, half_up, is_true, matches, present, regex
from stipendia.operators.frames import latest_by, top_per_key

PAGE = (2400.0, 3200.0)


def line_table(pages: DataFrame) -> DataFrame:
    """Nested pages -> one row per line, numbered over the document."""
    lines = pages.select("doc_id", "page", "page_width", "page_height", F.posexplode_outer("lines").alias("pos", "line")).where(
        F.col("line").isNotNull())
    return lines.select("doc_id", "page", (F.col("page").cast("long") * 1_000_000_000 + F.col("pos")).alias("line_no"), "page_width",
                        "page_height", "line.text", "line.confidence", "line.bbox", "line.words")


def value_tokens(value: Column) -> Column:
    upper = F.upper(F.trim(value))
    words = F.filter(F.split(F.regexp_replace(upper, r"""[₹$,.:;/\\|()\[\]{}"'`~]""", " "), r"\s+"), lambda w: w != "")
    whole = F.regexp_replace(upper, "[^A-Z0-9]", "")
    return F.when((whole != "") & ~F.array_contains(words, whole), F.array_append(words, whole)).otherwise(words)


def _union(boxes: Column) -> Column:
    side = (lambda name, pick: pick(F.transform(boxes, lambda b: b[name])))
    return F.when(F.size(boxes) > 0, F.struct(
        side("x0", F.array_min).alias("x0"), side("y0", F.array_min).alias("y0"),
        side("x1", F.array_max).alias("x1"), side("y1", F.array_max).alias("y1")))


def locate(values: DataFrame, lines: DataFrame) -> DataFrame:
    """Best line of the same document for every (doc_id, field, value).

    The best line is an aggregate (`max_by`), so a document with very many
    lines is reduced on the map side; words and boxes are read from the
    winning line only.
    """
    asked = values.withColumn("tokens", value_tokens(F.col("value"))).where(F.size("tokens") > 0)
    pairs = asked.join(lines.where(present(F.col("text"))), "doc_id")
    upper = F.upper("text")
    hits = F.size(F.filter("tokens", lambda t: F.contains(upper, t)))
    scored = pairs.withColumn("ratio", hits / F.size("tokens")).where(F.col("ratio") >= 0.5)
    keep = ["value", "tokens", "ratio", "line_no", "page", "page_width", "page_height", "text", "confidence", "bbox", "words"]
    best = latest_by(scored.withColumn("_early", -F.col("line_no")), ["doc_id", "field"], ["ratio", "_early"], keep)

    def is_hit(w: Column) -> Column:
        mine = F.regexp_replace(F.upper(w["text"]), "[^A-Z0-9]", "")
        clean = F.transform("tokens", lambda t: F.regexp_replace(t, "[^A-Z0-9]", ""))
        return F.exists(clean, lambda t: (F.length(t) > 0) & ((mine == t) | (
            (F.length(t) >= 2) & (F.contains(mine, t) | F.contains(t, mine)))))

    hit_words = F.filter(F.coalesce("words", F.array().cast(best.schema["words"].dataType)), is_hit)
    out = best.withColumn("_words", F.when(F.size(hit_words) > 0, hit_words).otherwise(F.col("words")))
    confs = F.filter(F.transform("_words", lambda w: w["confidence"]), lambda c: is_true(c > 0))
    mean = F.aggregate(confs, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(confs), F.lit(0))
    boxes = F.filter(F.transform("_words", lambda w: w["bbox"]), lambda b: b.isNotNull())
    out = out.withColumn("box", F.coalesce(_union(boxes), F.col("bbox"))).withColumn(
        "ocr_confidence", F.coalesce(half_up(mean), half_up(F.when(F.col("confidence") > 0, F.col("confidence")))))
    width, height = F.coalesce("page_width", F.lit(PAGE[0])), F.coalesce("page_height", F.lit(PAGE[1]))
    clamp = (lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    norm = F.struct(clamp(F.col("box.x0") / width).alias("x0"), clamp(F.col("box.y0") / height).alias("y0"),
                    clamp(F.col("box.x1") / width).alias("x1"), clamp(F.col("box.y1") / height).alias("y1"))
    found = out.where(F.col("box").isNotNull()).select(
        "doc_id", "field", "line_no", "page", "ratio", "ocr_confidence", "box", norm.alias("norm_box"))
    return values.join(found, ["doc_id", "field"], "left").withColumn("available", F.col("line_no").isNotNull())


def rotated(box: Column, degrees: Column) -> Column:
    """Normalised box after a page rotation by a multiple of 90 degrees."""
    turn = F.pmod(degrees, F.lit(360))
    clamp = (lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))

    def make(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(clamp(x0).alias("x0"), clamp(y0).alias("y0"), clamp(x1).alias("x1"), clamp(y1).alias("y1"))

    b = box
    return first_case([
        (turn == 90, make(1 - b["y1"], b["x0"], 1 - b["y0"], b["x1"])),
        (turn == 180, make(1 - b["x1"], 1 - b["y1"], 1 - b["x0"], 1 - b["y0"])),
        (turn == 270, make(b["y0"], 1 - b["x1"], b["y1"], 1 - b["x0"]))],
        make(b["x0"] + 0, b["y0"] + 0, b["x1"] + 0, b["y1"] + 0))


# --- the candidate's name by position ------------------------------------------------------------

_LABEL = (r"(?:NAME\s*OF\s*(?:THE\s*)?(?:CANDIDATE|STUDENT)|CANDIDATE'?S?\s*NAME|STUDENT\s*NAME|தேர்வரின்\s*பெயர்"
          r"|(?:AME|ME)\s*OF\s*(?:THE\s*)?CANDI)")
_HEADER = (r"(?:GOVERNMENT\s+OF|DEPARTMENT\s+OF|HIGHER\s+SECONDARY|SECONDARY\s+SCHOOL|STATEMENT\s+OF\s+MARKS|STATE\s+BOARD"
           r"|BOARD\s+OF\s+SECONDARY|EXAMINATION)")
_LOWER = (r"(?:PERMANENT\s*REGISTER|REGISTER\s*NUMBER|ROLL\s*NO|REG(?:ISTRATION)?\s*NO|DATE\s*OF\s*BIRTH|DOB|BORN\s*ON|SESSION"
          r"|\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b)")
_SUBJECT = r"(?:SUBJECT|THEORY|PRACTICAL|MARKS\s*OBTAINED)"
_NOT_NAME = (r"(?:GOVERNMENT\s+OF|DEPARTMENT\s+OF|HIGHER\s+SECONDARY|SECONDARY\s+SCHOOL|STATEMENT\s+OF\s+MARKS|PERMANENT\s*REGISTER"
             r"|REGISTER\s*NUMBER|ROLL\s*NO|DATE\s*OF\s*BIRTH|DOB|SESSION|SUBJECT|MARKS)")


def names_by_position(lines: DataFrame) -> DataFrame:
    """Name per document from its positioned lines.

    First the text on the label's line, then the best line just below it, then
    the best line of the band between the heading and the registration block;
    two near-equal different names in the band give no name.
    """
    size = lines.groupBy("doc_id").agg(
        F.greatest(F.lit(100.0), F.max(F.greatest("page_width", "bbox.x1"))).alias("_w"),
        F.greatest(F.lit(100.0), F.max(F.greatest("page_height", "bbox.y1"))).alias("_h"))
    rows = lines.where(F.col("bbox").isNotNull()).join(size, "doc_id").select(
        "doc_id", "line_no", "text", "confidence", (F.col("bbox.x0") / F.col("_w")).alias("x0"),
        (F.col("bbox.x1") / F.col("_w")).alias("x1"), (F.col("bbox.y0") / F.col("_h")).alias("y0"),
        (F.col("bbox.y1") / F.col("_h")).alias("y1"))
    rows = rows.withColumn("mid", (F.col("y0") + F.col("y1")) / 2)

    head = matches(F.col("text"), _HEADER) & (F.col("mid") < 0.28)
    label = matches(F.col("text"), _LABEL)
    marks = rows.groupBy("doc_id").agg(
        F.max(F.when(head, F.col("y1"))).alias("head_bottom"),
        F.min_by(F.when(label, F.struct("line_no", "text", "confidence", "x0", "x1", "y1", "y0")),
                 F.when(label, F.col("line_no"))).alias("label"))
    marks = marks.withColumn("limit", F.coalesce(F.col("head_bottom") * 0.9, F.lit(0.15))).withColumn(
        "subject_limit", F.coalesce(F.col("head_bottom") * 0.9, F.lit(0.20)))
    placed = rows.join(marks, "doc_id")

    own_text = F.regexp_replace(F.col("label.text"), regex(rf"^.*?{_LABEL}[A-Z]*\s*[:\-–—]?\s*", "i"), "")
    own = marks.where(F.col("label").isNotNull()).withColumn("_own", own_text).withColumn("_clean", candidate_text(F.col("_own")))
    own = own.withColumn("score", candidate_score(F.col("_own"), F.col("_clean"), True, F.col("label.confidence")))
    own = own.where(F.col("score") >= 65).select("doc_id", F.lit(1).alias("way"), F.col("_clean").alias("name"),
                                                 F.lit(0.95).alias("confidence"))

    drop = F.col("y0") - F.col("label.y1")
    tall = F.greatest(F.lit(0.005), F.col("label.y1") - F.col("label.y0"))
    below = placed.where((F.col("line_no") != F.col("label.line_no")) & drop.between(-0.01, tall * 4.0)
                         & (F.col("x0") <= F.col("label.x1") + 0.50) & (F.col("x1") >= F.col("label.x0") - 0.20))
    # only lines in the right place are cleaned
    below = below.withColumn("clean", candidate_text(F.col("text")))
    below = below.withColumn("score", candidate_score(F.col("clean"), F.col("clean"), True, F.col("confidence")))
    below = latest_by(below.where(F.col("score") >= 65).withColumn("_early", -F.col("line_no")), ["doc_id"],
                      ["score", "_early"], ["clean", "score"])
    below = below.select("doc_id", F.lit(2).alias("way"), F.col("clean").alias("name"),
                         F.least(F.lit(0.98), F.col("score") / 100.0).alias("confidence"))

    band = placed.groupBy("doc_id").agg(
        F.max("head_bottom").alias("head_bottom"),
        F.min(F.when(matches(F.col("text"), _LOWER) & (F.col("mid") > F.col("limit")), F.col("y0"))).alias("lower"),
        F.min(F.when(matches(F.col("text"), _SUBJECT) & (F.col("mid") > F.col("subject_limit")), F.col("y0"))).alias("subject"))
    top = F.coalesce(F.greatest(F.lit(0.08), F.col("head_bottom") - 0.02), F.lit(0.10))
    bottom = F.coalesce(F.least(F.lit(0.95), F.coalesce("lower", "subject") + 0.02), F.lit(0.50))
    inside = rows.join(band.select("doc_id", top.alias("top"), bottom.alias("bottom")), "doc_id").where(
        F.col("mid").between(F.col("top"), F.col("bottom")) & (F.col("x0") <= 0.95) & (F.col("x1") >= 0.05)
        & ~matches(F.col("text"), _NOT_NAME)).withColumn("clean", candidate_text(F.col("text"))).where(present(F.col("clean")))
    centred = F.abs(F.col("mid") - (F.col("top") + F.col("bottom")) / 2) <= F.greatest(
        F.lit(0.01), (F.col("bottom") - F.col("top")) / 2) * 0.6
    base = candidate_score(F.col("clean"), F.col("clean"), False, F.col("confidence"))
    inside = inside.withColumn("score", F.when(base >= 0, base + 15 + F.when(centred, 10).otherwise(0)).otherwise(-1)
                               ).where(F.col("score") >= 65)
    two = top_per_key(inside, ["doc_id"], [F.col("score").desc(), F.col("line_no")], 2, "place")
    pick = two.groupBy("doc_id").agg(
        F.max(F.when(F.col("place") == 1, F.struct("score", "clean"))).alias("a"),
        F.max(F.when(F.col("place") == 2, F.struct("score", "clean"))).alias("b"))
    clear = F.col("b").isNull() | (F.col("a.score") - F.col("b.score") >= 10) | (F.col("a.clean") == F.col("b.clean"))
    banded = pick.where(clear).select("doc_id", F.lit(3).alias("way"), F.col("a.clean").alias("name"), F.least(
        F.lit(0.96), F.greatest(F.lit(0.70), F.col("a.score") / 100.0)).alias("confidence"))

    every = own.unionByName(below).unionByName(banded)
    best = latest_by(every, ["doc_id"], ["way"], ["way", "name", "confidence"], latest=False)
    method = first_case([(F.col("way") == 1, "anchor_same_line"), (F.col("way") == 2, "anchor_line_below")],
                        "geometry_layout_fallback")
    return best.select("doc_id", title_name(F.col("name")).alias("name"), "confidence", method.alias("method"))
