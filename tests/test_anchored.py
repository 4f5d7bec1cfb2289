"""Anchors of patterns: never a lost match, and titles wherever they stand."""

import random
import re

from pyspark.sql import functions as F

from stipendia.functions import doc_rules
from stipendia.functions.anchored import Anchored, anchors, trie
from stipendia.functions.scalars import contains_pattern
from stipendia.operators import documents


def test_anchors_of_patterns():
    assert anchors(r"income\s+certificate|caste\s*cert") == {"certificate", "caste"}
    assert anchors(r"\b(?:hsc|hr\.?\s*sec)\b") == {"sc", "sec"} and anchors(r"[ab]c") == {"ac", "bc"}
    assert anchors(r"\d{4}\s\d") is None and anchors(r"(?:abc)?x*") is None and anchors(r"(abc|\d)z+") == {"z"}
    words = ["ss", "sslc", "s", "tax", "+2", "taxi"]
    for word in words:
        assert re.fullmatch(trie(words), word)
    assert re.match(trie(words), "sslcx")[0] == "sslc" and re.match(trie(words), "sslx")[0] == "ss"


def test_no_match_is_lost(spark):
    """Every pattern on texts put together from pieces of the patterns, with and without the scan."""
    rnd = random.Random(2)
    patterns = documents._TYPES + documents._PLACES + documents._OFFICES
    pieces = [w for p in patterns for w in re.split(r"\\[a-z]|[^a-z0-9஀-௿ ]+", p) if w] + list("x 1.+,/") + ["1234 5678 9012", "rs. 50"]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 25))) for _ in range(250)] + [t.replace(" ", "") for t in pieces[:50]] + ["", "std x"]
    known = Anchored(patterns)
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).withColumn("a", known.scan(F.col("t")))
    plain = F.array(*[contains_pattern(F.col("t"), p) for p in patterns])
    gated = F.array(*[known.possible(F.col("a"), p) & contains_pattern(F.col("t"), p) for p in patterns])
    rows = df.select("t", plain.alias("p"), gated.alias("g")).collect()
    assert all(r.p == r.g for r in rows) and sum(map(sum, (r.p for r in rows))) > 500


def test_titles_stand_anywhere(spark):
    fill = "plain words of no interest. " * 80
    rows = [("deep", fill + "INCOME CERTIFICATE of the district", "income", 95, len(fill) + 1), ("top", "Community Certificate\n" + fill, "community", 95, 1),
            ("fixed", fill + "1NC0ME CERT1F1CATE", "income", 85, len(fill) + 1), ("weak", "about caste " + fill, "unknown", 61, 7),
            ("none", fill, "unknown", 15, None), ("short", "sslc", "unknown", 0, None), ("null", None, "unknown", 0, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "id string, text string")
    got = {r.id: (r.title_type, r.title_confidence, r.title_at) for r in documents.titles(df).collect()}
    assert got == {r[0]: r[2:] for r in rows}
