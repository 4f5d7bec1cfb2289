"""Licence scans of paragraphs, in DataFrame functions and Spark's own logistic regression.

A paragraph is a stretch of lines with a letter or digit; lines without one,
blank or of comment marks only, end it.  Its parts are its lines and, over all
its words without marks and line ends, windows of ``WINDOW`` words every
``STEP`` words, so that every notice is whole in one of them however it is
wrapped.  The one- to three-word sequences of a part feed a sparse multinomial logistic regression (L1 penalty) whose classes are the
licence families and ``unknown``.  The model is fitted on ``TRAINING_ROWS``
rows that Spark generates from the notices below and from unrelated sentences,
a fixed number whatever the corpus.  On every fourth row, kept out of the fit,
a temperature calibrates the probabilities, and each family gets the least
probability against the unknown class that no unknown row reaches there; a part
may thus hold several families, as in a choice of licences, and is unknown if
it reaches none.  A prediction counts once a notice of its family is found in
the part: at least ``CONTAINED`` of the notice's three-word sequences, and one
of the sequences that only this family has, so that a notice is not taken for
a shorter one of another family.

The penalty leaves a few hundred sequences with a weight.  A part without a
word of any of them scores the intercepts alone, which is the same for all such
parts, so its sequences are not built and one of them stands for a paragraph.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TRAINING_ROWS = 4_000
PENALTY = 2e-3
CONTAINED = 0.6
NOTABLE = 1e-3  # a family is looked at next to the likeliest one from this share of its probability on
WINDOW = 32
STEP = 8  # a notice of up to WINDOW - STEP + 1 words is whole in a window
UNKNOWN = "unknown"
GAP, WHOLE = " ... ", "= "
_TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)

# Customary notices of each family, their titles, short names and paragraphs of their bodies.  A notice in
# several parts, divided by "...", is found if all its parts are; one that begins with "=" has to be a whole line.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": ("licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "licensed under the AGPLv3",
             "This program is distributed under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only",
             "AGPL-3.0-or-later", "AGPL-3.0 license"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License",
               "Licensed to the Apache Software Foundation under one or more contributor license agreements", "SPDX-License-Identifier: Apache-2.0",
               "Apache License Version 2.0, January 2004", "Apache License, Version 2.0", "Apache 2.0 license", "Released under the Apache-2.0 license", "Apache License 2.0",
               "MIT OR Apache-2.0", "SPDX-License-Identifier: MIT OR Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0", "SPDX-License-Identifier: BSL-1.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD 2-Clause License", "BSD 3-Clause License",
            "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "BSD-2-Clause license",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC BY 3.0",
              "Creative Commons Attribution 3.0 Unported License", "SPDX-License-Identifier: CC-BY-4.0", "Creative Commons Attribution License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0", "CC BY-NC 3.0"),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
                    "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "CC BY-NC-ND 3.0"),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
                    "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC BY-NC-SA 3.0"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "Creative Commons Attribution-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "available under the Creative Commons Attribution-ShareAlike License", "CC BY-SA 3.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright",
            "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal", "licensed under CC0"),
    "epl": ("made available under the terms of the Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0", "Eclipse Public License Version 1.0"),
    "eupl": ("Licensed under the EUPL, Version 1.2 or later", "European Union Public Licence", "SPDX-License-Identifier: EUPL-1.2"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "it under the terms of the GNU General Public License as published by",
            "Released under the GNU GPL v2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3",
            "GNU GENERAL PUBLIC LICENSE Version 2", "Licensed under GPLv3.", "licensed under GPLv2", "SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0 license",
            "GPL-3.0 license", "You should have received a copy of the GNU General Public License along with this program"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Released under the ISC License.", "SPDX-License-Identifier: ISC", "ISC License"),
    "lgpl": ("licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by",
             "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 3", "licensed under LGPLv3", "LGPL-3.0-only"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "This project is MIT licensed.", "The MIT License (MIT)", "under the MIT license", "or MIT license", "MIT OR Apache-2.0", "SPDX-License-Identifier: MIT OR Apache-2.0",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
            "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
            "Mozilla Public License Version 2.0", "MPL 2.0 license"),
    "proprietary": ("copyright ... All rights reserved.", "= All rights reserved.", "No part of this publication may be reproduced without written permission",
                    "This document is confidential and proprietary.", "confidential and proprietary information ... All rights reserved"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "released under the Unlicense"),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable",
             "zlib License", "SPDX-License-Identifier: Zlib"),
}
FAMILIES = (UNKNOWN, *NOTICES)

# Sentences that share words with notices and are none, and words around a notice.
OTHER = (
    "The driver showed a license and went on.", "She released the report under pressure from the public.", "The general public was not permitted inside.",
    "Terms of the agreement were published by the committee.", "He reserved a table for all of them.", "The rights of the author were discussed at length.",
    "A licensed doctor works under the supervision of the state.", "The software was updated to version 2.0 last week.", "They keep a copy of the source in the archive.",
    "Permission was granted by the school.", "The Apache people lived in the region.", "MIT students won the contest.", "The public domain is a common topic.",
    "The license fee rose by 4.0 percent.", "It is free of charge for any person under ten.", "Creative work needs common sense.", "The affero river is short.",
    "All members were present.", "All rights were reserved for the king.",
    "The driving license was issued in March.", "A fishing license version for children is planned.", "Attribution of the painting is uncertain.",
    "The warranty covers parts of any kind.", "Copies of the notice hang in the hall.", "The general license of the bank expired in 2.0 days.",
    "The boost was distributed to the team.", "The software is provided by the school.", "The union of European states has a public seat.",
    "No part of the house was dry.", "This program runs at noon.", "The file is in the other folder.", "Mozilla and Eclipse were mentioned.",
)
AROUND = ("the", "and", "of", "years", "2019", "2023", "by", "authors", "file", "project", "text", "this", "see", "for", "with", "details", "note", "in", "is",
          "work", "on", "under", "to", "a", "it", "was", "as", "are", "from", "that")


# A word at the start of a line that only marks a comment; other marks are no part of any word.
COMMENT = r"(?im)^[ \t]*(?:rem|dnl)(?=[ \t])"
PARAGRAPH_END = r"\n[^\p{L}\p{N}]*\n"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and the marks inside licence names; a copyright sign is the word."""
    spelled = F.regexp_replace(F.lower(text), r"©|\(c\)", " copyright ")
    return F.filter(F.split(spelled, r"[^\p{L}\p{N}.+-]+"), lambda w: F.rtrim(F.ltrim(w, F.lit(".-+")), F.lit(".-+")) != "")


def trimmed(words: Column) -> Column:
    return F.transform(words, lambda w: F.rtrim(F.ltrim(w, F.lit(".-+")), F.lit(".-+")))


def _runs(words: str, width: int) -> Column:
    """Sequences of ``width`` words of an array column."""
    whole = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(whole, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, width)]))


def with_sequences(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_words``, ``_threes`` and ``_grams``: the one- to three-word sequences with a word of five or more characters."""
    df = df.withColumn("_raw", tokens(text)).withColumn("_words", trimmed(F.col("_raw"))).drop("_raw")
    df = df.withColumn("_threes", _runs("_words", 3))
    return df.withColumn("_grams", F.filter(F.concat("_words", _runs("_words", 2), "_threes"), lambda g: g.rlike("[^ ]{5}")))


def _pick(values: tuple[str, ...], salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def training(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """(id, label, paragraph): two of five rows are no notice; the others hold one, with words around it or cut."""
    flat = [(FAMILIES.index(family), notice.removeprefix(WHOLE).replace(GAP, " 2021 the authors ")) for family, notices in NOTICES.items() for notice in notices]
    chosen = F.element_at(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(n).alias("text")) for k, n in flat]),
                          (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(len(flat))) + 1).cast("int"))
    around = lambda salt: F.concat_ws(" ", *[F.when(F.pmod(F.xxhash64("id", F.lit(salt + 50)), F.lit(9)) > k, _pick(AROUND, salt + k)) for k in range(8)])
    other = F.when(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) == 0, around(100)).otherwise(_pick(OTHER, 3))
    df = spark.range(0, rows, 1, 1).withColumn("_notice", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(5)) >= 2).withColumn("_chosen", chosen)
    return df.select("id", F.when(F.col("_notice"), F.col("_chosen.label")).otherwise(0).cast("double").alias("label"),
                     F.concat_ws(" ", around(200), F.when(F.col("_notice"), F.col("_chosen.text")).otherwise(other), around(300)).alias("paragraph"))


@dataclass(frozen=True)
class Classifier:
    sequences: CountVectorizerModel
    model: LogisticRegressionModel
    temperature: float
    least: list[float]

    def scored(self, df: DataFrame) -> DataFrame:
        """Adds ``_scores`` (one a class) to rows with ``_grams``."""
        return self.model.transform(self.sequences.transform(df)).withColumn("_scores", vector_to_array("_raw")).drop(
            "_features", "_raw", "_probability", "_prediction")

    def weighted(self) -> list[str]:
        """The sequences with a weight for any class."""
        weights = self.model.coefficientMatrix.toArray()
        return [gram for gram, column in zip(self.sequences.vocabulary, weights.T) if column.any()]

    def anchors(self) -> list[str]:
        """Words of which one is in every paragraph that holds a weighted sequence; none contains another."""
        longest = sorted({max(gram.split(" "), key=len) for gram in self.weighted()}, key=len)
        return [w for i, w in enumerate(longest) if not any(v in w for v in longest[:i])]


def fit(spark: SparkSession, rows: int = TRAINING_ROWS) -> Classifier:
    made = with_sequences(training(spark, rows), F.col("paragraph"))
    held = F.pmod(F.col("id"), F.lit(4)) == 3
    sequences = CountVectorizer(inputCol="_grams", outputCol="_features", binary=True, minDF=2.0).fit(made.where(~held))
    model = LogisticRegression(featuresCol="_features", labelCol="label", family="multinomial", regParam=PENALTY, elasticNetParam=1.0, maxIter=30,
                               rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction").fit(sequences.transform(made.where(~held)))
    scored = Classifier(sequences, model, 1.0, []).scored(made.where(held)).select("label", "_scores")
    losses = scored.agg(*[F.avg(-F.log(F.greatest(_chance(F.get("_scores", F.col("label").cast("int")), t), F.lit(1e-12)))).alias(str(i))
                          for i, t in enumerate(_TEMPERATURES)]).first()
    temperature = _TEMPERATURES[min(range(len(_TEMPERATURES)), key=lambda i: losses[i])]
    highest = scored.where("label = 0").agg(*[F.max(_against_unknown(F.get("_scores", F.lit(k)), temperature)).alias(f)
                                              for k, f in enumerate(FAMILIES)]).first()
    return Classifier(sequences, model, temperature, [max(0.5, (h or 0.0) + 1e-6) for h in highest])


def any_of(words: list[str]) -> str:
    """A pattern that finds any of the words where no letter or digit stands before it; common beginnings are read once."""
    def branch(rest: list[str]) -> str:
        if "" in rest:
            return ""
        heads: dict[str, list[str]] = {}
        for word in rest:
            heads.setdefault(word[0], []).append(word[1:])
        parts = [re.escape(head) + branch(tails) for head, tails in sorted(heads.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?<![a-z0-9]){branch(words)}" if words else "(?!)"


def _chance(score: Column, temperature: float) -> Column:
    """Calibrated probability of one class from its score and all ``_scores``."""
    return F.lit(1.0) / F.aggregate("_scores", F.lit(0.0), lambda total, x: total + F.exp((x - score) / F.lit(temperature)))


def _against_unknown(score: Column, temperature: float) -> Column:
    """Calibrated probability of a class where it and the unknown class are the choice.

    A part may hold notices of several families, and each of them has to stand against the unknown class only.
    """
    return F.lit(1.0) / (F.lit(1.0) + F.exp((F.get("_scores", F.lit(0)) - score) / F.lit(temperature)))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, paragraph number from 0, part, line, family, probability, contained, confirmed) of parts of paragraphs.

    ``row`` tells rows with one id apart.  Part 0 of each paragraph is given always, others where a weighted sequence
    can be.  A null or empty text gives one row with a null ``line``, so no document is lost; other columns are not read.
    """
    spark = docs.sparkSession
    classifier = fit(spark)
    anchored = any_of(classifier.anchors())
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.posexplode_outer(F.split(F.regexp_replace(text_col, COMMENT, ""), PARAGRAPH_END, -1)).alias("paragraph", "_text"))
    rows = rows.withColumn("_text", F.when(F.col("_text").rlike(r"[\p{L}\p{N}]"), F.lower("_text")))
    rows = rows.withColumn("_all", F.when(F.col("_text").rlike(anchored), trimmed(tokens(F.col("_text")))))
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_all") - (WINDOW - STEP + 1), F.lit(0)), F.lit(STEP)),
                          lambda at: F.array_join(F.slice("_all", at + 1, F.lit(WINDOW)), " "))
    parts = F.when(F.col("_all").isNotNull(), F.concat(F.split("_text", "\n", -1), windows)).otherwise(F.array("_text"))
    rows = rows.select("id", "row", "paragraph", F.posexplode(parts).alias("part", "line"))
    rows = rows.withColumn("_low", F.coalesce("line", F.lit(""))).withColumn("_anchored", F.col("_low").rlike(anchored))
    rows = rows.where((F.col("part") == 0) | F.col("_anchored"))
    # Without an anchor there is no weighted sequence, so an empty text scores alike.
    scored = classifier.scored(with_sequences(rows, F.when(F.col("_anchored"), F.col("_low")).otherwise("")))
    top = F.array_max("_scores")
    near = F.filter(F.transform("_scores", lambda x, k: F.struct(k.alias("k"), x.alias("score"))), lambda c: (c["k"] > 0) & (
        F.exp((c["score"] - top) / F.lit(classifier.temperature)) >= NOTABLE))
    chances = F.transform(near, lambda c: F.struct(c["k"].alias("k"), _against_unknown(c["score"], classifier.temperature).alias("probability")))
    least = F.array(*map(F.lit, classifier.least))
    sure = F.filter(chances, lambda c: c["probability"] >= F.get(least, c["k"]))
    scored = scored.withColumn("_sure", F.when(F.size(sure) > 0, sure).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("probability")))))
    # The outer form keeps the optimizer from adding a filter, which would build the arrays anew for every element.
    scored = scored.select("id", "row", "paragraph", "part", "line", "_words", "_threes", F.concat("_words", _runs("_words", 2), "_threes").alias("_every"), F.inline_outer("_sure"))
    scored = scored.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("k") + 1))
    scored = scored.withColumn("contained", F.when(F.col("k") > 0, _contained()))
    return scored.select("id", "row", "paragraph", "part", "line", "family", "probability", "contained",
                         F.coalesce(F.col("contained") >= CONTAINED, F.lit(False)).alias("confirmed"))


def words_in(text: str) -> list[str]:
    """``trimmed(tokens(text))`` of one of the notices."""
    found = (w.strip(".-+") for w in re.split(r"[^\w.+-]+|_", re.sub(r"©|\(c\)", " copyright ", text.lower())))
    return [w for w in found if w]


def _sequences(words: list[str], width: int) -> set[str]:
    return {" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


def own_sequences() -> dict[str, set[str]]:
    """The one- to three-word sequences that only notices of one family have.

    What a notice shares with those of other families cannot tell them apart, so one of these has to be in a part.
    """
    of = {f: set().union(*(_sequences(words_in(n.replace(GAP, " ")), k) for n in notices for k in (1, 2, 3))) for f, notices in NOTICES.items()}
    return {f: {g for g in found if not any(g in other for o, other in of.items() if o != f)} for f, found in of.items()}


_TEMPLATE = "array<struct<family:string,line:array<string>,own:array<string>,pieces:array<struct<grams:array<string>,long:boolean>>>>"


def _templates() -> Column:
    """All notices as one constant: a whole line, or pieces with the sequences they are known by."""
    own, rows = own_sequences(), []
    for family, notices in NOTICES.items():
        for notice in notices:
            every = set().union(*(_sequences(words_in(notice.replace(GAP, " ")), k) for k in (1, 2, 3)))
            pieces = [words_in(piece) for piece in notice.split(GAP)]
            rows.append({"family": family, "line": words_in(notice) if notice.startswith(WHOLE) else None, "own": sorted(own[family] & every),
                         "pieces": [{"grams": sorted(_sequences(p, 3) if len(p) > 2 else set(p)), "long": len(p) > 2} for p in pieces]})
    return F.from_json(F.lit(json.dumps(rows)), _TEMPLATE)


def _contained() -> Column:
    """The largest share of a notice of the family that a part contains; 0 without a sequence of the family's own."""
    def piece(p: Column) -> Column:
        met = F.size(F.array_intersect(F.when(p["long"], F.col("_threes")).otherwise(F.col("_words")), p["grams"])) / F.size(p["grams"])
        return F.when(p["long"] | (met == 1.0), met).otherwise(0.0)

    def share(n: Column) -> Column:
        named = (F.size(n["own"]) == 0) | F.arrays_overlap("_every", n["own"])
        return F.when(n["line"].isNotNull(), F.when(F.col("_words") == n["line"], 1.0).otherwise(0.0)).when(
            named, F.array_min(F.transform(n["pieces"], piece))).otherwise(0.0)

    return F.array_max(F.transform(F.filter(_templates(), lambda n: n["family"] == F.col("family")), share))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, n_license_paragraphs, n_unconfirmed, families): one row per id.

    ``families`` are the confirmed ones in order, joined by commas, empty without any; ``n_unconfirmed`` counts
    paragraphs with predictions of which no notice bears out any.  Texts are read whole; a paragraph's result does not depend on
    others.  Null and empty texts have no paragraphs; rows with the same id are one document; an empty table gives none.
    """
    found = paragraphs(docs, id_col, text_col)
    place = F.struct("row", "paragraph")
    known = F.collect_set(F.when(F.col("confirmed"), place))
    named = F.collect_set(F.when(F.col("family") != UNKNOWN, place))
    return found.groupBy("id").agg(
        F.size(F.collect_set(F.when((F.col("part") == 0) & F.col("line").isNotNull(), place))).cast("long").alias("n_paragraphs"), F.size(known).cast("long").alias("n_license_paragraphs"),
        F.size(F.array_except(named, known)).cast("long").alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
    ).withColumnRenamed("id", id_col)
