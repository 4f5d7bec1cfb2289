"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, digits as 0, runs of blanks as one) and
hashed.  Per host, the distinct documents of a line are counted, whatever
stands around it and however often it stands in one document; a document is
known by the hash of its whole text, so exact copies count once.  Lines above
the host's limit are removed; a document that loses more than half of its
words is rejected as depleted.

The limit is a share of the host's documents, so a host has at most
(mean lines a document / ``share``) such lines whatever its size.  They are
written to the shared folder as one array a host; the optimizer sees the size
of that table and broadcasts it only below its own threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SHARE = 0.02
MIN_COUNT = 10


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normalised(line: Column) -> Column:
    return F.regexp_replace(
        F.trim(F.translate(F.lower(line), "0123456789" + BLANKS[1:], "0" * 10 + " " * 5)), " {2,}", " ")


def _line_keys(text: Column) -> Column:
    """One hash per line; null for a line without a word."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.when(line.rlike(WORD), F.xxhash64(normalised(line))))


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", share: float = SHARE,
                   min_count: int = MIN_COUNT) -> DataFrame:
    """(host, frequent array<long>): hashes of the lines above each host's limit.

    A line is above it if it stands in more than ``max(min_count, share * different texts of the host)`` different
    texts.  Null hosts are one host of their own; null texts are empty ones.
    """
    rows = docs.select(F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = (rows.groupBy("host", F.xxhash64("text").alias("doc")).agg(F.lit(1).alias("one"))
             .groupBy("host").agg(F.count(F.lit(1)).alias("n_docs")))
    lines = rows.select("host", F.xxhash64("text").alias("doc"), F.explode(F.array_distinct(_line_keys(F.col("text")))).alias("line"))
    counted = (lines.where("line is not null").groupBy("host", "line", "doc").agg(F.lit(1).alias("one"))
               .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_count))
    above = (counted.join(sizes, counted["host"].eqNullSafe(sizes["host"])).where(F.col("n") > F.col("n_docs") * share)
             .select(counted["host"], "line"))
    return above.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("frequent"))


def _repeat_words(words: str) -> list[tuple[str, Column]]:
    """Steps that end in ``n_repeat_words``: words inside three-word windows found twice or more in the text."""
    empty = F.array().cast("array<struct<gram:bigint,at:int>>")
    return [
        ("_grams", F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
                               lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))),
        ("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"),
                           F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("gram"), i.alias("at")))))
         .otherwise(empty)),
        ("_again", F.filter("_sorted", lambda x, i: F.coalesce(x["gram"] == F.get("_sorted", i - 1)["gram"], F.lit(False))
                            | F.coalesce(x["gram"] == F.get("_sorted", i + 1)["gram"], F.lit(False)))),
        ("n_repeat_words", F.size(F.array_distinct(F.flatten(F.transform(
            "_again", lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))).cast("long")),
    ]


def apply_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", share: float = SHARE,
                min_count: int = MIN_COUNT, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with ``cleaned`` (the text without frequent lines), the counts and the verdict.

    Output: struct ``doc`` (the row as it came, so no name can clash), ``cleaned``, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_removed_words``, ``base_failed``, ``kept``.
    Null texts count as empty and fail the base rules; repeated rows are judged each alike, and count once for line
    frequency; a host without frequent lines keeps all lines; an empty table gives an empty table.
    """
    frequent = saved(frequent_lines(docs, host_col, text_col, share, min_count))
    rows = docs.select(F.struct("*").alias("doc"), F.col(host_col).alias("host"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(frequent.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host", "host")
    rows = (rows.withColumn("_words", words_of(F.col("text")))
            .withColumn("_lines", F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))))
    for name, column in _repeat_words("_words"):
        rows = rows.withColumn(name, column)
    rows = (rows.withColumn("n_words", F.size("_words").cast("long"))
            # One hashed intersection a document; only its few hits are searched line by line.
            .withColumn("_hits", F.when(F.col("frequent").isNotNull(), F.array_intersect("frequent", _line_keys(F.col("text")))))
            .withColumn("_kept_lines", F.when(F.size("_hits") > 0, F.filter(
                F.split("text", "\n", -1),
                lambda line: ~(line.rlike(WORD) & F.array_contains("_hits", F.xxhash64(normalised(line))))))))
    rows = (rows.withColumn("cleaned", F.coalesce(F.array_join("_kept_lines", "\n"), F.col("text")))
            .withColumn("n_removed_words", F.when(F.length("cleaned") < F.length("text"), F.col("n_words")
                                                  - F.size(words_of(F.col("cleaned")))).otherwise(F.lit(0)).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = rows.select(
        "doc", "cleaned", "n_words",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "n_removed_words", failed.alias("base_failed"),
        (~failed & (2 * F.col("n_removed_words") <= F.col("n_words"))).alias("kept"))
    # A filter of the caller must not be pushed below the arrays, where they would be built anew for every element.
    return judged.select(F.inline(F.array(F.struct(*judged.columns))))


# The same rules for DuckDB, over whole texts.
SQL = r"""
WITH base AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
     w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM base),
     wp AS (SELECT k, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
            FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
     again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS times FROM wp) WHERE times > 1),
     rep AS (SELECT k, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY k),
     ln AS (SELECT k, source, t, unnest(string_split(t, chr(10))) AS l FROM base),
     dup AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
     nl AS (SELECT k, source, t, l, CASE WHEN regexp_matches(l, '[^\x20\x09-\x0D]') THEN regexp_replace(trim(translate(lower(l),
              '0123456789' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '0000000000     '), ' '), ' {2,}', ' ', 'g') END AS line FROM ln),
     cnt AS (SELECT source, line, count(DISTINCT t) AS n FROM nl WHERE line IS NOT NULL GROUP BY ALL),
     hosts AS (SELECT source, count(DISTINCT t) AS n_docs FROM base GROUP BY source),
     freq AS (SELECT cnt.source, line FROM cnt JOIN hosts ON cnt.source IS NOT DISTINCT FROM hosts.source
              WHERE n > 10 AND n > n_docs * 0.02),
     gone AS (SELECT k, sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS n FROM nl JOIN freq
              ON nl.source IS NOT DISTINCT FROM freq.source AND nl.line = freq.line GROUP BY k),
     r AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                  coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed
           FROM base JOIN w USING (k) LEFT JOIN dup USING (k) LEFT JOIN rep USING (k) LEFT JOIN gone USING (k))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed <= n_words AS kept
FROM r"""
