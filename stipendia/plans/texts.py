"""Document-text queries over derived certificates and the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipendia.functions import doc_rules, names, text, values
from stipendia.functions.scalars import as_instant
from stipendia.operators import documents, evidence, fields
from stipendia.operators.frames import balanced
from stipendia.plans.certificates import all_texts, cases, certificates
from stipendia.plans.mapping import AS_OF
from stipendia.plans.registry import query

def q(pattern: str) -> str:
    """A pattern as SQL literal of the checking engine, case-insensitive, dot not matching newlines."""
    return "'(?i)" + pattern.replace("'", "''") + "'"


def hit(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


_CLEAN = "squeezed AS (SELECT doc_key, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM all_texts)"
_SCORES = ", ".join(
    "{" + f"'score': " + " + ".join(f"CASE WHEN {hit('c', p)} THEN {w} ELSE 0 END" for p, w, _ in rules)
    + f", 'place': {-i}, 'type': '{t}', 'hits': list_filter(["
    + ", ".join(f"CASE WHEN {hit('c', p)} THEN '{r}' END" for p, _, r in rules) + "], lambda z: z IS NOT NULL)}"
    for i, (t, rules) in enumerate(doc_rules.TYPE_RULES.items()))
_TYPES = f"""{_CLEAN}, scored AS (SELECT doc_key, c, list_reverse_sort([{_SCORES}]) AS r FROM squeezed),
typed AS (SELECT doc_key, r[1].score AS s1, r[2].score AS s2, r[1].type AS t1, r[1].hits AS h, length(c) >= 15 AS long FROM scored),
kinds AS (SELECT doc_key, CASE WHEN long AND s1 >= 6 THEN t1 ELSE 'unknown' END AS doc_type,
 CAST(CASE WHEN NOT long THEN 0 WHEN s1 < 6 THEN s1 * 10 WHEN s1 - s2 < 3 AND s2 >= 6
  THEN greatest(30, least(98, greatest(30, s1 * 8)) - 25) ELSE least(98, greatest(30, s1 * 8)) END AS INT) AS confidence,
 CASE WHEN long AND s1 >= 6 THEN list_aggregate(h[1:4], 'string_agg', '; ') ELSE '' END AS reasons,
 s1 - s2 AS margin, long AND s1 >= 6 AS enough FROM typed)"""


@query("text_types", "TXT-01 SRT-06 SRC-07", f"""
WITH {_TYPES} SELECT doc_key, doc_type, confidence, coalesce(reasons, '') AS reasons,
 enough AND confidence >= 60 AND margin >= 3 AS is_confident FROM kinds""")
def _(t):
    return documents.classify(all_texts(t)).select(
        "doc_key", "doc_type", "confidence", F.array_join("reasons", "; ").alias("reasons"), "is_confident")


@query("text_slots", "TXT-05 TXT-06", f"""
WITH {_TYPES}, s AS (SELECT *, split_part(doc_key, '-', 1) AS slot, CASE doc_type WHEN 'ms10' THEN 'marksheet'
 WHEN 'ms12' THEN 'marksheet' WHEN 'unknown' THEN 'unknown' ELSE doc_type END AS category FROM kinds)
SELECT doc_key, CASE WHEN doc_type = 'unknown' OR confidence < 50 THEN 'unconfident' WHEN doc_type = slot THEN 'valid'
 ELSE 'mismatch' END AS slot_status, category,
 CASE WHEN confidence < 60 OR doc_type = 'unknown' THEN 'Other / Unknown' ELSE category END AS suggested,
 confidence < 60 OR doc_type = 'unknown' AS uncertain FROM s""")
def _(t):
    rows = documents.classify(all_texts(t)).withColumn("slot", F.split_part("doc_key", F.lit("-"), F.lit(1)))
    pick = documents.suggestion(F.col("doc_type"), F.col("confidence"))
    return rows.select("doc_key", documents.slot_check(F.col("slot"), F.col("doc_type"), F.col("confidence")
                                                       ).alias("slot_status"), pick.alias("p")
                       ).select("doc_key", "slot_status", "p.*")


_STATE_HITS = ", ".join(
    "{" + f"'state': '{s}', 'n': " + " + ".join(f"CAST({hit('c', p)} AS INT)" for p in ps) + "}"
    for s, ps in doc_rules.STATES)
_AUTHORITY = "CASE " + " ".join(f"WHEN {hit('c', p)} THEN '{n}'" for n, p in doc_rules.AUTHORITIES) + " END"


@query("text_places", "TXT-03 TXT-04", f"""
WITH {_CLEAN}, h AS (SELECT doc_key, c, list_filter([{_STATE_HITS}], lambda z: z.n > 0)[1] AS s FROM squeezed)
SELECT doc_key, s.state AS state, CASE WHEN s IS NULL THEN 0 ELSE CAST(least(98, 70 + s.n * 14) AS INT) END AS state_confidence,
 {_AUTHORITY} AS authority FROM h""")
def _(t):
    rows = balanced(all_texts(t)).withColumn("c", documents.squeezed(F.col("text")))
    return rows.select("doc_key", documents.state_of(F.col("c")).alias("s"),
                       documents.authority_of(F.col("c")).alias("authority")).select("doc_key", "s.*", "authority")


def _title_cases(col: str, penalty: int) -> str:
    out = []
    for kind, title, weight, patterns in doc_rules.TITLES:
        sure = weight if not penalty else max(60, weight - penalty)
        for p in patterns:
            out.append(f"WHEN {hit(col, p)} THEN ['{kind}', '{title}', '{sure}', regexp_extract({col}, {q(p)}, 0), "
                       f"CAST(strpos({col}, regexp_extract({col}, {q(p)}, 0)) AS VARCHAR)]")
    return " ".join(out)


_FIXED = "h"
for _p, _v in doc_rules.TITLE_REPAIRS:
    _FIXED = f"regexp_replace({_FIXED}, '{_p}', '{_v.replace('$1', chr(92) + '1')}', 'g')"
_WEAK = " ".join(f"WHEN {hit('h', p)} THEN ['unknown', '{n}', '61', '{n}', CAST(length(regexp_extract(h, {q('(?s)^(.*?)(?:' + p + ')')}, 1)) + 1 AS VARCHAR)]"
                 for p, n in doc_rules.PARTIAL_TITLES)


@query("text_titles", "TXT-02", f"""
WITH b AS (SELECT doc_key, trim(text) AS h FROM all_texts), f AS (SELECT *, trim({_FIXED}) AS x FROM b),
r AS (SELECT doc_key, CASE WHEN length(h) < 10 THEN ['unknown', 'Unknown Document', '0', NULL, NULL] ELSE
 CASE {_title_cases("h", 0)} {_title_cases("x", 10)} {_WEAK} ELSE ['unknown', 'Unknown Document', '15', NULL, NULL] END END AS v FROM f)
SELECT doc_key, v[1] AS title_type, v[2] AS title, CAST(v[3] AS INT) AS title_confidence, v[4] AS evidence, CAST(v[5] AS INT) AS title_at FROM r""")
def _(t):
    return documents.titles(all_texts(t)).select("doc_key", "title_type", "title", "title_confidence", "evidence", "title_at")


_TEMPLATE = " ".join(f"WHEN {hit('text', p)} THEN '{n}'" for n, _, _, _, p in doc_rules.TEMPLATES)
_ANY_STATE = " OR ".join(hit("text", p) for _, ps in doc_rules.STATES for p in ps)


@query("text_templates", "TXT-07", f"""
SELECT doc_key, CASE {_TEMPLATE} WHEN ({_ANY_STATE}) AND {hit("text", "board[ ]+of|examination")} THEN 'state_board'
 ELSE 'generic' END AS template FROM all_texts""")
def _(t):
    return balanced(all_texts(t)).select("doc_key", documents.template_of(F.col("text"))["template"].alias("template"))


# --- extraction ----------------------------------------------------------------------------------

def _title_sql(col: str) -> str:
    words = f"list_transform(string_split({col}, ' '), lambda w: upper(w[1]) || lower(w[2:]))"
    return f"array_to_string({words}, ' ')"


@query("marksheet10_fields", "TXT-08 TXT-14 TXT-15 TXT-16", f"""
SELECT student_id, {_title_sql("full_name")} AS name, dob, register_number, '2020' AS year, 'March' AS month,
 'Tamil Nadu State Board (SSLC)' AS board, 'GOVT HIGH SCHOOL, SALEM' AS school, {_title_sql("parent_name")} AS father_name,
 marks10 AS scored, 500 AS maximum, CAST(percent10 AS DOUBLE) AS percentage, 'explicit' AS percentage_source, 'Pass' AS grade,
 CASE WHEN abs(percent10 - floor(marks10 / 500.0 * 10000 + 0.5) / 100) > 1 THEN 'percentage' END AS conflict FROM cases""")
def _(t):
    rows = certificates(t, "ms10").withColumnRenamed("slot", "doc_type")
    return fields.marksheet_fields(rows).select(
        "student_id", "name", "dob", "register_number", "year", "month", "board", "school", "father_name", "scored", "maximum",
        "percentage", "percentage_source", "grade", "conflict")


@query("marksheet12_fields", "TXT-08 TXT-14", f"""
SELECT student_id, {_title_sql("name12")} AS name, dob12 AS dob, register_number, '2022' AS year, 'May' AS month,
 'Tamil Nadu Higher Secondary (HSC)' AS board, marks12 AS scored, 600 AS maximum,
 floor(marks12 / CAST(600 AS DOUBLE) * 100.0 * 100.0 + 0.5) / 100.0 AS percentage, 'derived' AS percentage_source,
 CASE WHEN floor(marks12 / CAST(600 AS DOUBLE) * 100.0 * 100.0 + 0.5) / 100.0 >= 35 THEN 'Pass' ELSE 'Fail' END AS grade FROM cases""")
def _(t):
    rows = certificates(t, "ms12").withColumnRenamed("slot", "doc_type")
    return fields.marksheet_fields(rows).select("student_id", "name", "dob", "register_number", "year", "month", "board", "scored",
                                                "maximum", "percentage", "percentage_source", "grade")


@query("subject_marks", "TXT-13", """
SELECT student_id, unnest(['TAMIL', 'ENGLISH', 'MATHEMATICS', 'SCIENCE', 'SOCIAL SCIENCE']) AS subject,
 unnest([per_subject, per_subject, per_subject, per_subject, marks10 - 4 * per_subject]) AS marks FROM cases""")
def _(t):
    rows = certificates(t, "ms10").select("student_id", F.inline_outer(fields.subject_rows(F.col("text"))))
    return rows.where(F.col("subject").isNotNull()).select("student_id", "subject", "marks")


@query("community_fields", "TXT-09", f"""
SELECT student_id, {_title_sql("full_name")} AS name, {_title_sql("parent_name")} AS father_name, 'Hindu Vanniyar' AS community,
 community AS community_category, 'Hindu' AS religion, 'TN-COM-' || k AS certificate_number, issue_date, 'Salem' AS district,
 'Tamil Nadu' AS state, 'Tahsildar' AS authority, 'management' AS quota_type FROM cases""")
def _(t):
    return fields.community_fields(certificates(t, "community")).select(
        "student_id", "name", "father_name", "community", "community_category", "religion", "certificate_number", "issue_date",
        "district", "state", "authority", "quota_type")


@query("income_fields", "TXT-10", f"""
SELECT student_id, {_title_sql("income_holder")} AS name, income, 'INC/2001/' || substr(k, 4, 6) AS certificate_number, issue_date,
 valid_upto, 'Omalur' AS taluk, 'Salem' AS district, 'Zonal Deputy Tahsildar' AS authority FROM cases""")
def _(t):
    return fields.income_fields(certificates(t, "income")).select(
        "student_id", "name", "income", "certificate_number", "issue_date", "valid_upto", "taluk", "district", "authority")


@query("identity_fields", "TXT-11 TXT-18", """
SELECT student_id, full_name AS name, dob, CASE WHEN bal < 4000 THEN 'Female' ELSE 'Male' END AS gender,
 'XXXX-XXXX-9' || substr(k, 7, 3) AS masked_number FROM cases""")
def _(t):
    return fields.identity_fields(certificates(t, "aadhaar")).select("student_id", "name", "dob", "gender", "masked_number")


@query("bank_fields", "TXT-12 TXT-18", """
SELECT student_id, bank_holder AS holder, 'XXXXXXXX' || right(k, 4) AS masked_account, 'SBIN0' || substr(k, 4, 6) AS ifsc,
 'State Bank of India' AS bank, account_type FROM cases""")
def _(t):
    return fields.bank_fields(certificates(t, "bankpass")).select("student_id", "holder", "masked_account", "ifsc", "bank",
                                                                  "account_type")


@query("school_names", "TXT-16 TXT-27", """
SELECT student_id, 'GOVT HIGH SCHOOL, SALEM' AS school, CASE WHEN nat < 8 THEN 'MATCH' WHEN nat < 16 THEN 'LIKELY' ELSE 'DIFFERENT' END
 AS status, CASE WHEN nat < 8 THEN 1.0 WHEN nat < 16 THEN 0.5 ELSE 0.25 END AS score FROM cases""".replace("1.0", "CAST(1.0 AS DOUBLE)"
 ).replace("0.5 ELSE 0.25", "CAST(0.5 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE)"))
def _(t):
    rows = fields.with_school(certificates(t, "ms10")).join(cases(t).select("student_id", "nat"), "student_id")
    other = F.when(F.col("nat") < 8, "Government High School Salem").when(
        F.col("nat") < 16, "Govt. High Academy, Erode").otherwise("Municipal School of Erode North")
    return rows.withColumn("m", names.institution_match(F.col("school"), other)).select("student_id", "school", "m.*")


@query("name_candidates", "TXT-17 TXT-19", """
SELECT student_id, CASE seg WHEN 'BUILDING' THEN 'NEEDS_REVIEW' WHEN 'AUTOMOBILE' THEN 'NOT_DETECTED' WHEN 'MACHINERY' THEN 'NEEDS_REVIEW'
 WHEN 'HOUSEHOLD' THEN CASE WHEN bal < 3000 THEN 'NEEDS_REVIEW' ELSE 'HIGH_CONFIDENCE' END ELSE 'HIGH_CONFIDENCE' END AS status,
 CASE seg WHEN 'BUILDING' THEN 65 WHEN 'AUTOMOBILE' THEN 35 WHEN 'MACHINERY' THEN 68 WHEN 'HOUSEHOLD' THEN CASE WHEN bal < 3000
 THEN 60 ELSE 80 END ELSE 90 END AS confidence FROM cases""")
def _(t):
    raw = (F.when(F.col("seg") == "BUILDING", F.concat("full_name", F.lit(" EXAM")))
           .when(F.col("seg") == "AUTOMOBILE", F.lit("TOTAL MARKS")).when(F.col("seg") == "MACHINERY", F.concat(
               F.lit("N1TH1SH "), "full_name")).otherwise(F.col("full_name")))
    conf = F.when(F.col("seg") == "HOUSEHOLD", F.when(F.col("bal") < 3000, 60).otherwise(80))
    return cases(t).select("student_id", names.resolve_candidate(raw, conf).alias("r")).select(
        "student_id", "r.status", "r.confidence")


@query("reading_suggestions", "TXT-19", """
SELECT student_id, 'CLARA 0' || n1 AS raw, 'CLARA O' || n1 || '; DARA 0' || n1 AS names, 'TN0' || substr(k, 4, 6) AS number,
 CASE WHEN contains(dob, '0') THEN dob END AS day FROM cases""")
def _(t):
    raw = F.concat(F.lit("CLARA 0"), "n1")
    number = F.concat(F.lit("TNO"), F.substring("k", 4, 6))
    day = F.replace("dob", F.lit("0"), F.lit("O"))
    return cases(t).select("student_id", raw.alias("raw"), F.array_join(names.name_suggestions(raw), "; ").alias("names"),
                           names.id_suggestion(number).alias("number"), names.date_suggestion(day).alias("day"))


@query("masked_texts", "TXT-18", r"""
SELECT doc_key, sha256(regexp_replace(text, '\b\d{4}[ -]?\d{4}[ -]?(\d{4})\b', 'XXXX-XXXX-\1', 'g')) AS masked FROM all_texts""")
def _(t):
    return balanced(all_texts(t)).select("doc_key", F.sha2(text.mask_identities_in_text(F.col("text")), 256).alias("masked"))


@query("field_confidence", "TXT-20", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS e, l_discount * 1000 AS p, l_tax * 1000 AS x,
 CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE 100.0 END AS v FROM lineitem),
c AS (SELECT *, CAST(least(100, greatest(0, floor((CASE WHEN e = 0 THEN 75.0 ELSE greatest(0.0, least(100.0, e)) END) * CAST(0.35 AS DOUBLE)
 + (CASE WHEN p = 0 THEN 70.0 ELSE greatest(0.0, least(100.0, p)) END) * CAST(0.25 AS DOUBLE)
 + (CASE WHEN x = 0 THEN 50.0 ELSE greatest(0.0, least(100.0, x)) END) * CAST(0.20 AS DOUBLE)
 + (CASE WHEN v = 0 THEN 80.0 ELSE v END) * CAST(0.20 AS DOUBLE) + 0.5))) AS INT) AS score FROM s)
SELECT score, CASE WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' WHEN score >= 50 THEN 'low' ELSE 'unreliable' END
 AS status, score < 70 AS uncertain, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def _(t):
    rows = t.raw("lineitem").select(text.confidence_score(
        F.col("l_quantity") * 2, F.col("l_discount") * 1000, F.col("l_tax") * 1000,
        F.when(F.col("l_returnflag") == "A", 0.0).otherwise(100.0)).alias("c"))
    return rows.select("c.*").groupBy("score", "status", "uncertain").agg(F.count(F.lit(1)).alias("n"))


@query("structured_fields", "TXT-20 TXT-08", f"""
WITH m AS (SELECT student_id, {_title_sql("full_name")} AS name, 'GOVT HIGH SCHOOL, SALEM' AS school FROM cases)
SELECT student_id, 'name' AS field, name AS value, 98 AS confidence, 'high' AS status, false AS uncertain FROM m
UNION ALL SELECT student_id, 'school', school, 92, 'high', false FROM m""")
def _(t):
    rows = fields.with_school(fields.with_label_name(certificates(t, "ms10"))).select(
        "student_id", "name", "name_confidence", "school", "school_confidence")
    return fields.structured(rows, {"name": "name_confidence", "school": "school_confidence"})


@query("record_issues", "RUL-27", """
SELECT student_id, slot, issues, warnings FROM (SELECT student_id, 'ms10' AS slot,
 CASE WHEN percent10 < 35 THEN 'percentage below pass mark' ELSE '' END AS issues, '' AS warnings FROM cases
UNION ALL SELECT student_id, 'income', '', CASE WHEN date_diff('day', strptime(issue_date, '%d-%m-%Y')::DATE, DATE '2001-08-02') / 30.0 > 12
 THEN 'certificate older than 12 months' WHEN date_diff('day', strptime(issue_date, '%d-%m-%Y')::DATE, DATE '2001-08-02') / 30.0 > 6
 THEN 'certificate 6 to 12 months old' ELSE '' END FROM cases)""")
def _(t):
    ms = fields.marksheet_fields(certificates(t, "ms10").withColumnRenamed("slot", "doc_type"))
    inc = fields.income_fields(certificates(t, "income").withColumnRenamed("slot", "doc_type"))
    rows = ms.unionByName(inc, allowMissingColumns=True).withColumn("community", F.lit(None).cast("string"))
    out = fields.record_issues(rows, as_instant(AS_OF))
    return out.select("student_id", F.col("doc_type").alias("slot"), F.array_join("issues", "; ").alias("issues"),
                      F.array_join("warnings", "; ").alias("warnings"))


# --- positioned lines ----------------------------------------------------------------------------

def _pages(t, slot: str):
    """The text of a certificate as one page of evenly spaced lines with one box per word."""
    box = (lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))

    def line(value, i):
        y0 = (i + 1) * 100.0
        word = (lambda w, j: F.struct(w.alias("text"), (F.lit(80.0) + j).alias("confidence"), box(
            F.lit(200.0) + j * 100.0, y0, F.lit(280.0) + j * 100.0, y0 + 40.0).alias("bbox")))
        return F.struct(value.alias("text"), F.lit(88.0).alias("confidence"), box(
            F.lit(200.0), y0, F.lit(1800.0), y0 + 40.0).alias("bbox"), F.transform(F.split(value, " "), word).alias("words"))

    return certificates(t, slot).select(
        F.col("student_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(2000.0).alias("page_width"),
        F.lit(3000.0).alias("page_height"), F.transform(F.split("text", "\n"), line).alias("lines"))


@query("names_by_position", "TXT-21 SRC-06", f"""
SELECT student_id AS doc_id, {_title_sql("full_name")} AS name, 'anchor_same_line' AS method FROM cases""")
def _(t):
    return evidence.names_by_position(evidence.line_table(_pages(t, "ms10"))).select("doc_id", "name", "method")


@query("names_below_label", "TXT-21", f"""
SELECT student_id AS doc_id, {_title_sql("name12")} AS name, 'anchor_line_below' AS method FROM cases""")
def _(t):
    return evidence.names_by_position(evidence.line_table(_pages(t, "ms12"))).select("doc_id", "name", "method")


@query("field_evidence", "JOI-17 TXT-22", """
SELECT student_id AS doc_id, field, line_no, ocr_confidence, y0 FROM (SELECT student_id, unnest(['name', 'register', 'absent']) AS field,
 unnest([1000000003, 1000000005, NULL]) AS line_no, unnest([86, 84, NULL]) AS ocr_confidence,
 unnest([floor(400.0 / 3000 * 1000000), floor(600.0 / 3000 * 1000000), NULL]) AS y0 FROM cases)""".replace(
    "unnest([86, 84, NULL])", "CAST(unnest([86, 84, NULL]) AS BIGINT)").replace(
    "unnest([floor(", "CAST(unnest([floor(").replace("1000000), NULL]) AS y0", "1000000), NULL]) AS BIGINT) AS y0").replace(
    "unnest([1000000003, 1000000005, NULL])", "CAST(unnest([1000000003, 1000000005, NULL]) AS BIGINT)"))
def _(t):
    values_ = cases(t).select(F.col("student_id").alias("doc_id"), F.inline(F.array(
        F.struct(F.lit("name").alias("field"), F.col("full_name").alias("value")),
        F.struct(F.lit("register").alias("field"), F.col("register_number").alias("value")),
        F.struct(F.lit("absent").alias("field"), F.lit("ZZQX WWVV").alias("value")))))
    found = evidence.locate(values_, evidence.line_table(_pages(t, "ms10")))
    return found.select("doc_id", "field", "line_no", "ocr_confidence",
                        F.floor(F.col("norm_box.y0") * 1000000).alias("y0"))


# --- duplicates ----------------------------------------------------------------------------------

@query("duplicate_groups", "TXT-23 SRC-09", """
SELECT sha256(text) AS fingerprint, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return documents.duplicate_groups(t.raw("documents"), "doc_id", "text")


@query("duplicate_documents", "TXT-23 WIN-04", """
WITH h AS (SELECT doc_id, source, lang, sha256(text) AS fingerprint FROM documents), c AS (SELECT *, count(*) OVER
 (PARTITION BY fingerprint, source) AS owner_copies, count(*) OVER (PARTITION BY fingerprint, source, lang) AS slot_copies FROM h)
SELECT doc_id, fingerprint, owner_copies, owner_copies = slot_copies AS only_same_slot FROM c WHERE owner_copies > 1""")
def _(t):
    rows = t.raw("documents").select("doc_id", "source", "lang", "text")
    return documents.duplicate_documents(rows, "source", "lang", "text").select(
        "doc_id", "fingerprint", "owner_copies", "only_same_slot")


_QUALITY = ["doc_id", "text AS ocr_text", "CAST(n_chars AS DOUBLE) / 10 AS resolution_score", "1000 AS width",
            "CAST(length(source) * 8 AS DOUBLE) AS sharpness_score", "CAST(n_chars AS DOUBLE) AS laplacian_variance",
            "CAST(n_chars AS DOUBLE) / 20 AS brightness", "CAST(n_chars AS DOUBLE) / 4 AS contrast_score",
            "CAST(NULL AS DOUBLE) AS contrast_stddev", "CASE WHEN lang = 'en' THEN NULL ELSE CAST(n_chars AS DOUBLE) / 8 END AS ocr_confidence",
            "CASE WHEN lang = 'de' THEN 'fair' ELSE 'good' END AS quality_level"]


@query("quality_gate", "RUL-28", f"""
WITH s AS (SELECT {', '.join(_QUALITY)} FROM documents), r AS (SELECT *, list_filter([
 CASE WHEN resolution_score < 35 OR width < 350 THEN 'low resolution' END,
 CASE WHEN sharpness_score < 30 OR laplacian_variance < 30 THEN 'blurry' END,
 CASE WHEN brightness < 40 THEN 'too dark' END, CASE WHEN brightness > 252 THEN 'washed out / overexposed' END,
 CASE WHEN contrast_score < 20 OR contrast_stddev < 12 THEN 'low contrast / blank page' END,
 CASE WHEN length(trim(ocr_text)) < 15 AND (ocr_confidence IS NULL OR ocr_confidence < 30) THEN 'text not readable' END,
 CASE WHEN ocr_confidence < 25 THEN 'low OCR confidence' END], lambda z: z IS NOT NULL) AS x FROM s)
SELECT doc_id, CASE WHEN len(x) >= 2 OR list_contains(x, 'text not readable') OR list_contains(x, 'low contrast / blank page') THEN 'REJECT'
 WHEN len(x) > 0 OR quality_level = 'fair' THEN 'WARN' ELSE 'PASS' END AS gate, coalesce(array_to_string(x, ', '), '') AS reasons FROM r""")
def _(t):
    return documents.quality_gate(t.raw("documents").selectExpr(*_QUALITY)).select(
        "doc_id", "gate", F.array_join("rejection_reasons", ", ").alias("reasons"))


# --- normalisers ---------------------------------------------------------------------------------

@query("value_normalisers", "TXT-28", """
SELECT student_id, full_name AS name, array_to_string(list_sort(string_split(lower(full_name), ' ')), ' ') AS sorted_name,
 strftime(strptime(dob, '%d-%m-%Y'), '%Y-%m-%d') AS iso, dob AS shown, income AS amount, community,
 CASE WHEN nat < 10 THEN 'Hindu' WHEN nat < 20 THEN 'Muslim' ELSE 'Bahai' END AS religion FROM cases""")
def _(t):
    c = F.col
    faith = F.when(c("nat") < 10, "Hindu - Saivite").when(c("nat") < 20, "islam").otherwise("Bahai")
    return cases(t).select(
        "student_id", names.clean_name(F.concat(F.lit("Thiru. "), "full_name", F.lit("  "))).alias("name"),
        names.sorted_tokens(F.concat(F.lit("Dr "), "full_name")).alias("sorted_name"),
        values.iso_date(F.replace("dob", F.lit("-"), F.lit("/"))).alias("iso"),
        values.display_date(F.replace("dob", F.lit("-"), F.lit("."))).alias("shown"),
        values.parse_income(F.concat(F.lit("Rs. "), values.indian_grouping(c("income")), F.lit("/-"))).alias("amount"),
        values.community_code(F.concat(F.lit("Community ("), F.lower("community"), F.lit(")"))).alias("community"),
        values.religion_name(faith).alias("religion"))


@query("profile_normalisers", "TXT-29 RUL-04", """
SELECT student_id, CASE seg WHEN 'BUILDING' THEN 'BC' WHEN 'AUTOMOBILE' THEN 'SC' WHEN 'MACHINERY' THEN 'MBC' WHEN 'HOUSEHOLD' THEN 'Minority'
 ELSE 'General' END AS category, CASE seg WHEN 'BUILDING' THEN 'bc' WHEN 'AUTOMOBILE' THEN 'sc' WHEN 'MACHINERY' THEN 'mbc'
 WHEN 'HOUSEHOLD' THEN 'christian' ELSE 'general' END AS community,
 CASE WHEN nat < 8 THEN 'Engineering' WHEN nat < 16 THEN 'Arts' ELSE 'All' END AS course,
 CASE WHEN nat < 8 THEN 'ug' WHEN nat < 16 THEN 'pg' END AS level, CASE WHEN bal < 4000 THEN 'Girls' WHEN bal < 8000 THEN 'Boys' ELSE 'All' END
 AS gender, CASE WHEN nat < 8 THEN 'Tamil Nadu' WHEN nat < 16 THEN 'Odisha' ELSE 'All-India' END AS state,
 seg IN ('BUILDING', 'MACHINERY') AS admitted FROM cases""")
def _(t):
    c = F.col
    group = F.element_at(F.create_map(*[F.lit(v) for v in (
        "BUILDING", "OBC", "AUTOMOBILE", " sc ", "MACHINERY", "DNC", "HOUSEHOLD", "Christian", "FURNITURE", "ews")]), c("seg"))
    study = F.when(c("nat") < 8, "B.Tech degree").when(c("nat") < 16, "English masters").otherwise("phd")
    sex = F.when(c("bal") < 4000, "young woman").when(c("bal") < 8000, "he").otherwise("unknown")
    home = F.when(c("nat") < 8, "TN").when(c("nat") < 16, "odisha").otherwise("national scheme")
    return cases(t).select(
        "student_id", values.profile_category(group).alias("category"), values.profile_community(group).alias("community"),
        values.profile_course(study).alias("course"), values.profile_level(study).alias("level"),
        values.profile_gender(sex).alias("gender"), values.profile_state(home).alias("state"),
        values.accepts_community(F.lit("BC"), values.profile_category(group)).alias("admitted"))
