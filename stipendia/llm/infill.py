"""Fill-in-the-middle transformation by counted quantifiers.

A text is cut into n units (white space with the word behind it; white space
at the end is a unit of its own).  ``regexp_count`` gives n, a hash of the id
gives two places a <= b in 0..n, and a pattern of the row's own,

    ((?:unit){a}+)((?:unit){b-a}+)(everything else)

captures prefix, middle and suffix in one match.  The counted groups are
possessive: they run as a loop without a stack, so texts of any length pass.
All of it is column functions in one pass over the rows, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
UNIT = f"(?:{SPACE}*+{WORD}++|{SPACE}++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80  # per cent of the texts that change, and of those in suffix-first order


def draws(identifier: Column, seed: int = SEED, number: int = 4) -> list[Column]:
    """Whole numbers of 32 bits from the hash of ``seed:identifier``; a null identifier is the empty string."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))
    digest = F.sha2(named, 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(number)]


def _marked(text: Column) -> Column:
    return text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
             spm_rate: int = SPM_RATE) -> DataFrame:
    """(id, n, form, output, prefix, middle, suffix) of every row.

    ``form`` is plain (output is the text, the parts are null), psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle).  Plain are the texts the draw leaves out, null and empty texts (output empty) and texts that hold a mark
    already.  A part may be empty.  Rows with the same id draw the same numbers; rows without an id draw those of the
    empty id.  Other columns are not read; an empty table gives an empty table.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"),
                       *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("id"), seed), 1)])
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    plain = (F.col("text") == "") | _marked(F.col("text")) | (F.col("h3") % 100 >= rate)
    rows = rows.select("id", "text", "n", F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
                       F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    pattern = F.concat(F.lit(rf"\A((?:{UNIT}){{"), F.col("a").cast("string"), F.lit(rf"}}+)((?:{UNIT}){{"),
                       (F.col("b") - F.col("a")).cast("string"), F.lit("}+)((?s:.*))"))
    # The text holds no mark and no mark overlaps itself, so the marks put in here are the only ones to split at.
    cut = F.split(F.regexp_replace("text", pattern, F.lit(f"$1{MIDDLE}$2{MIDDLE}$3")), MIDDLE, -1)
    rows = rows.select("id", "text", "n", "form", F.when(F.col("form") != "plain", cut).alias("cut"))
    p, m, s = (F.col("cut")[k] for k in range(3))
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
              .otherwise(F.col("text")))
    return rows.select(F.col("id").alias(id_col), "n", "form", output.alias("output"), p.alias("prefix"), m.alias("middle"),
                       s.alias("suffix"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``infilled`` started from, rebuilt from its output and form alone."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hashes of the output and of the text rebuilt from it."""
    return made.select(
        F.col(f"`{id_col}`"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


# The same for DuckDB, over whole texts, from the list of units.
SQL = r"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
                  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM b),
     c AS (SELECT doc_id, t, us, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a,
                  greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS z,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
     p AS (SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:z], '') AS mid,
                  array_to_string(us[z + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
