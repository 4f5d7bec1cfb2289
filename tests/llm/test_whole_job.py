"""Cases that a part of the job would get wrong: blocks of lines, hot keys, wrapped notices, long values."""

import random

import pytest
from pyarrow import parquet

from stipendia.llm import induced_sort, licenses, pii, quality_rules, suffix_dedup
from stipendia.llm.queries import QUERIES, SQL
from tests.compare import connect, difference
from tests.llm.brute import repeated


def _letters(i: int) -> str:
    return "".join(chr(97 + i // 26 ** k % 26) for k in range(3))


def test_quality_counts_documents(spark):
    own = lambda i: " ".join(_letters(i) + _letters(k) for k in range(60))
    header = "Home of all\nAbout the site\nContact and help"  # the middle line always has the same neighbours
    inside = "\n".join(f"{own(600 + k)}\nCHORUS" for k in range(15))  # many surroundings in one document
    rows = [(i, f"{header}\n{own(i)}") for i in range(20)] + [(100, inside)] + [(200 + i, f"Copied line\n{own(700)}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    got = {r.doc.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert all(got[i].cleaned == own(i) and got[i].n_removed_words == 9 for i in range(20))
    assert got[100].cleaned == inside and got[100].n_removed_words == 0
    assert all(got[200 + i].n_removed_words == 0 and got[200 + i].kept for i in range(30))


def test_quality_statement_counts_texts(spark, tmp_path):
    """The checking SQL and the operator on tables that tell counting texts, rows and surroundings apart."""
    own = lambda i: " ".join(_letters(i) + _letters(k) for k in range(60))
    long_header = "\n".join(" ".join(f"{_letters(900 + k)}{w}" for w in range(30)) for k in range(3))
    rows = [(i, f"{long_header}\n{own(i)}", "blocks") for i in range(40)]                          # depleted: 90 of 150 words
    rows += [(100 + i, f"{own(100 + i % 12)}\n{own(800)}\n{own(801)}", "copies") for i in range(900)]  # 12 texts, 900 rows
    rows += [(2000 + i, f"{own(200 + i)}\n{own(300)}\n{own(311 + i)}\n{own(302)}", "few") for i in range(10)]
    rows += [(3000, "\n".join(f"{own(400 + k)}\n{own(500)}" for k in range(30)), "one"), (3001, None, None), (3002, None, "one"), (None, own(1), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parquet.write_table(docs.toArrow(), f"{tmp_path}/documents.parquet")
    df = QUERIES["op3_quality_rules"](spark, str(tmp_path))
    assert difference(df, connect(str(tmp_path)), SQL["op3_quality_rules"]) is None
    kept = {r.doc_id: r.kept for r in df.collect()}
    assert not any(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(900)) and all(kept[2000 + i] for i in range(10)) and kept[3000]


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    rng, sort = random.Random(5), induced_sort.repeats
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, wide = noise(70), noise(45)
    texts = [f"{noise(150)}{line}{noise(150)}" for _ in range(120)]
    texts += [f"{noise(90)}{wide if i % 2 else ''}{line}{noise(20) if i % 3 else wide}{noise(90)}" for i in range(60)]
    texts += texts[:5] + [texts[7][60:260] + noise(30) + texts[7][60:260]]
    rows = list(enumerate(texts))

    def bounded(text, length):
        assert len(text) <= 3 * 4096, len(text)
        return sort(text, length)

    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4096)
    monkeypatch.setattr(suffix_dedup, "repeats", bounded)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == repeated(rows) and sum(r[1] for r in got.values()) > 3000


@pytest.mark.parametrize("lead,value,tag", [
    ("", "token=" + "3f9ac07b5d" * 30, "[SECRET]"), ("", "secret: eyJ" + "hbGciOi.JIUzI1-NiIs_" * 40, "[SECRET]"),
    ("key ", "AKIA" + "MD62HKU6VBLCCCCE" * 4, "[SECRET]"), ("host ", "fead:abcd:beef:cafe:fade:dead:aced:babe", "[IP]")])
def test_personal_data_whole_values(lead, value, tag):
    text = f"as said in the line of {lead}{value} and so on"
    _, spans = pii.find(text, pii.train())
    assert pii.redact(text, spans) == f"as said in the line of {lead}{tag} and so on"


def test_licenses_of_wrapped_paragraphs(spark):
    fill = " ".join(_letters(i) for i in range(90))
    texts = {"# Licensed under the\n# Apache License, Version 2.0.\n#\n# more": ("apache", 2, 1),
             "This work is licensed under a Creative\nCommons Attribution 4.0 International License.": ("cc-by", 1, 1),
             " * Permission is hereby\n * granted, free of\n * charge, to any\n * person obtaining\n * a copy of this\n * software": ("mit", 1, 1),
             f"{fill}\n{fill} Licensed\nunder the MIT\nlicense. {fill}\n\n{fill}": ("mit", 2, 1),
             f"REM Licensed under the Apache\nREM License, Version 2.0.\n{fill}\nReleased under the\nMIT License.": ("apache,mit", 1, 1),
             "The driver showed a\nlicense and went on.\n\n \n***\n\nlast": ("", 2, 0)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_paragraphs, r.n_license_paragraphs) for r in licenses.scan(docs).collect()}
    assert got == dict(enumerate(texts.values()))
    assert max(len(n.split()) for notices in licenses.NOTICES.values() for n in notices) <= licenses.WINDOW - licenses.STEP + 1


# Everyday notices, none of them written by the generator of training rows, and sentences that are none.
EVERYDAY = {
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa", "Licensed under GPLv3.": "gpl",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "gpl", "Apache 2.0 license": "apache", "SPDX-License-Identifier: GPL-2.0-only": "gpl",
    "CC BY-SA 3.0": "cc-by-sa", "This project is MIT licensed.": "mit", "Distributed under the Boost Software License, Version 1.0. (See file)": "boost",
    "Licensed under the EUPL, Version 1.2": "eupl", "MIT OR Apache-2.0": "apache,mit", "SPDX-License-Identifier: MIT OR Apache-2.0": "apache,mit",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS": "mit",
    "Copyright (c) 2020 Example Corp. All rights reserved.": "proprietary", "© 2021 Foo. All rights reserved.": "proprietary", "One.\nAll rights reserved.\nTwo": "proprietary",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by", "Licensed under CC BY-NC-ND 4.0.": "cc-by-nc-nd",
    "This library is licensed under the GNU Lesser General Public License, version 2.1.": "lgpl", "Licensed under the GNU Affero General Public License, version 3.": "agpl",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "apache,mit", "Mozilla Public License Version 2.0": "mpl",
    "CC0 1.0 Universal": "cc0", "zlib License": "zlib", "ISC License": "isc", "This is free and unencumbered software released into the public domain.": "unlicense",
    "She fought for women's rights and wanted all rights reserved to men opened.": "", "You may obtain a copy of the License at the school office.": "",
    "The MIT students won the apache contest with a license to drive.": "", "The software is provided to schools without any kind of warranty by the vendor.": "",
    "General public access to the library is licensed by the city.": "", "The Apache helicopter landed.": "", "The public domain": "",
    "He was given a copy of the software free of charge by a friend.": "", "In the lesser known version of the story, the general wins.": "",
    "Redistribution of wealth was permitted in some form by the source.": "", "An eclipse of the moon is public and free.": "",
}


def test_licenses_of_everyday_texts(spark):
    rows = list(enumerate(EVERYDAY)) + [(900, "word " * 30_000 + "Licensed under the MIT license."), (901, None), (902, "")] + [(903, "CC BY-SA 3.0")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS part", "'x' AS family", "'x' AS _scores", "'x' AS k", "'x' AS row")
    got = {r.doc_id: r.families for r in licenses.scan(docs).collect()}
    wrong = {t: got[i] for i, t in enumerate(EVERYDAY) if got[i] != EVERYDAY[t]}
    assert not wrong and (got[900], got[901], got[902], got[903]) == ("mit", "", "", "cc-by-sa") and len(got) == len(EVERYDAY) + 4


def test_license_query_equals_plain_confirmation(spark, sf_dir, rows_of_docs):
    """The registered query: every confirmed family has a notice with its own words in the text, and no planted notice is lost."""
    planted = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary",
               "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache"}
    want = {i: {planted[line] for line in (t or "").split("\n") if line in planted} for i, t in rows_of_docs}
    got = {r.doc_id: set(filter(None, r.families.split(","))) for r in QUERIES["op1_license_scan"](spark, sf_dir).collect()}
    assert got == want and sum(map(bool, want.values())) > 2
