"""Question queries and evaluation of extracted fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipendia.functions import lexicon, text as text_fn
from stipendia.operators import catalogue, evaluate, fields, retrieval
from stipendia.operators.frames import balanced
from stipendia.plans.certificates import cases, certificates
from stipendia.plans.mapping import VIEWS
from stipendia.plans.registry import query

_ASK = """concat('I am a ', lower(community), CASE WHEN bal < 4000 THEN ' girl' WHEN bal < 8000 THEN ' boy' ELSE ' student' END, ' from ',
 CASE WHEN nat < 8 THEN 'Salem' WHEN nat < 14 THEN 'Kerala' WHEN nat < 20 THEN 'TN' ELSE 'here' END, ' doing ',
 CASE seg WHEN 'BUILDING' THEN 'B.E' WHEN 'AUTOMOBILE' THEN 'nursing' WHEN 'MACHINERY' THEN 'polytechnic' WHEN 'HOUSEHOLD' THEN 'msc'
 ELSE '7.5% quota' END, CASE WHEN nat < 5 THEN ', first graduate' WHEN nat < 10 THEN ', 45% disability' WHEN nat < 15 THEN ', farmer family'
 ELSE '' END, ', family income ', CASE WHEN bal < 3000 THEN concat('is Rs. ', CAST(income AS STRING_)) WHEN bal < 6000 THEN '1.5 lakh'
 ELSE 'about 2,50,000' END, ', am i eligible for NSP scholarship')"""
VIEWS["asked"] = f"SELECT student_id AS query_id, {_ASK.replace('STRING_', 'VARCHAR')} AS text, community, bal, nat, seg, income FROM cases"
VIEWS["turns"] = "SELECT conv_id || '/' || turn AS query_id, text FROM conversations WHERE role = 'user'"
VIEWS["all_questions"] = ("SELECT 'a' || query_id AS query_id, text FROM asked UNION ALL SELECT 't' || query_id, text FROM turns")


def asked(t):
    return cases(t).select(F.col("student_id").alias("query_id"), F.expr(_ASK.replace("STRING_", "STRING")).alias("text"))


def turns(t):
    return t.raw("conversations").where("role = 'user'").select(
        F.concat_ws("/", "conv_id", "turn").alias("query_id"), "text")


def all_questions(t):
    key = (lambda df, mark: df.select(F.concat(F.lit(mark), F.col("query_id").cast("string")).alias("query_id"), "text"))
    return key(asked(t), "a").unionByName(key(balanced(turns(t)), "t"))


def sql_match(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '" + pattern.replace("'", "''") + "')"


@query("question_slots", "TXT-30 TXT-31", """
SELECT query_id, CASE community WHEN 'DNC' THEN 'MBC' ELSE community END AS category, CASE WHEN nat < 8 THEN 'Salem' END AS district,
 CASE WHEN nat < 8 THEN 'Tamil Nadu' WHEN nat < 14 THEN 'Kerala' WHEN nat < 20 THEN 'Tamil Nadu' WHEN seg = 'FURNITURE' THEN 'Tamil Nadu' END AS state,
 CASE seg WHEN 'BUILDING' THEN 'Engineering' WHEN 'AUTOMOBILE' THEN 'Medical' WHEN 'MACHINERY' THEN 'Diploma' WHEN 'HOUSEHOLD' THEN 'Science' END AS course,
 CASE seg WHEN 'BUILDING' THEN 'ug' WHEN 'AUTOMOBILE' THEN 'ug' WHEN 'MACHINERY' THEN 'diploma' WHEN 'HOUSEHOLD' THEN 'pg' END AS level,
 CASE WHEN bal < 4000 THEN 'Girls' WHEN bal < 8000 THEN 'Boys' END AS gender, CASE WHEN nat >= 5 AND nat < 10 THEN true END AS disabled,
 CASE WHEN seg = 'FURNITURE' THEN true END AS govt_school, CASE WHEN nat >= 10 AND nat < 15 THEN true END AS agri_labor,
 CASE WHEN nat < 5 THEN true END AS first_graduate, CASE WHEN bal < 3000 THEN income WHEN bal < 6000 THEN 150000 ELSE 250000 END AS income FROM asked""")
def _(t):
    return retrieval.slots(asked(t)).select("query_id", "category", "district", "state", "course", "level", "gender", "disabled",
                                            "govt_school", "agri_labor", "first_graduate", "income")


_CAT = " ".join(f"WHEN {sql_match('x', p)}" + (f" AND NOT {sql_match('x', b)}" if b else "") + f" THEN '{c}'"
                for c, p, b in retrieval.CATEGORY_SLOTS)
_GEN = " ".join(f"WHEN {sql_match('x', p)} THEN '{g}'" for g, p in retrieval.GENDER_SLOTS)
_TN = r"\btamil\s*nadu\b|\btamilnadu\b"
_CRS = " ".join(
    f"WHEN {sql_match('x', p)}"
    + (" OR (" + sql_match("x", r"\bschool\b") + " AND NOT " + sql_match("x", r"\b(?:govt|government)\s*school\b") + ")" if c == "School" else "")
    + (f" AND NOT {sql_match('x', _TN)}" if c == "Arts" else "") + f" THEN '{c}'" for c, p in retrieval.COURSE_SLOTS)
_DIS = " ".join(f"WHEN {sql_match('x', chr(92) + 'b' + d.lower() + chr(92) + 'b')} THEN '{d}'" for d in lexicon.TN_DISTRICTS)


@query("turn_slots", "TXT-30", f"""
WITH t AS (SELECT query_id, lower(text) AS x FROM turns)
SELECT query_id, CASE {_CAT} END AS category, CASE {_DIS} END AS district,
 CASE WHEN {sql_match('x', retrieval.SCHOOL_QUOTA)} THEN NULL ELSE CASE {_CRS} END END AS course, CASE {_GEN} END AS gender FROM t""")
def _(t):
    return retrieval.slots(turns(t)).select("query_id", "category", "district", "course", "gender")


@query("question_entities", "TXT-33", f"""
SELECT query_id, array_to_string(list_filter([{', '.join("CASE WHEN " + sql_match('lower(text)', chr(92) + 'b' + e.lower() + chr(92) + 'b')
 + f" THEN '{e}' END" for e in lexicon.ENTITIES)}], lambda z: z IS NOT NULL), ',') AS entities FROM all_questions""")
def _(t):
    return all_questions(t).select("query_id", F.array_join(text_fn.entities(F.col("text")), ",").alias("entities"))


_WORDS = "string_split_regex(regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g'), '\\s+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS) + "]"


def sql_tokens(col: str) -> str:
    return (f"list_distinct(list_filter({_WORDS.format(c=col)}, lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w)))")


@query("question_tokens", "TXT-32 SET-04", f"""
SELECT query_id, CAST(len(list_filter({_WORDS.format(c='text')}, lambda w: length(w) > 2)) AS INT) AS words,
 array_to_string(list_sort({sql_tokens('text')}), ' ') AS content FROM all_questions""")
def _(t):
    return all_questions(t).select(
        "query_id", F.size(text_fn.tokens(F.col("text"))).alias("words"),
        F.array_join(F.array_sort(text_fn.content_tokens(F.col("text"))), " ").alias("content"))


def _rx(options: list[str]) -> str:
    return retrieval.whole_phrase(options)


_FIRST = " ".join(f"WHEN {sql_match('x', _rx(b))} THEN '{n}'" for n, b in retrieval.PRIORITY_INTENTS.items())
_SCORED = ", ".join(
    "{'s': " + " + ".join(f"CASE WHEN {sql_match('x', _rx([p]))} THEN {2 * len(p.split(' '))} ELSE 0 END" for p in b)
    + f", 'p': {-i}, 'n': '{n}'" + "}" for i, (n, b) in enumerate(retrieval.SCORED_INTENTS.items()))


@query("question_intents", "TXT-35", f"""
WITH q AS (SELECT query_id, lower(text) AS x FROM all_questions), s AS (SELECT *, CASE {_CAT} END AS category,
 list_reverse_sort([{_SCORED}])[1] AS best FROM q)
SELECT query_id, CASE {_FIRST} WHEN category IS NOT NULL AND (contains(x, 'eligible') OR contains(x, 'scholarship') OR contains(x, 'scheme')
 OR contains(x, 'apply') OR contains(x, 'for me')) THEN 'eligibility' WHEN best.s > 0 THEN best.n ELSE 'unknown' END AS intent FROM s""")
def _(t):
    return retrieval.intents(all_questions(t)).select("query_id", "intent")


_CORPUS = """c AS (SELECT item_id AS qa_id, lower(text) AS lq, trim(regexp_replace(trim(lower(text)), '[?.,!]', '', 'g')) AS norm, {tc} AS tok FROM benchmark),
q AS (SELECT query_id, trim(regexp_replace(trim(lower(text)), '[?.,!]', '', 'g')) AS norm FROM (SELECT query_id, text FROM turns
 UNION ALL SELECT 'd' || doc_id, text FROM documents)), u AS (SELECT norm, {tq} AS tok FROM (SELECT DISTINCT norm FROM q WHERE norm <> ''))"""
_PAIRS = _CORPUS.format(tc=sql_tokens("text"), tq=sql_tokens("norm")).replace("trim(regexp_replace(trim(lower(text)), '[?.,!]', '', 'g'))",
                                                                            "regexp_replace(trim(lower(text)), '[?.,!]', '', 'g')")


@query("best_answers", "TXT-34 JOI-12 SET-04", f"""
WITH {_PAIRS}, p AS (SELECT u.norm, c.qa_id, len(list_intersect(u.tok, c.tok)) AS m, len(u.tok) + len(c.tok) - len(list_intersect(u.tok, c.tok)) AS n,
 contains(u.norm, c.lq) OR contains(c.lq, u.norm) AS inside, u.norm = c.norm AS same FROM u CROSS JOIN c),
s AS (SELECT norm, qa_id, CASE WHEN same THEN CAST(1.0 AS DOUBLE) ELSE m / CAST(n AS DOUBLE) + CASE WHEN inside THEN CAST(0.35 AS DOUBLE) ELSE 0 END END AS score,
 same, m FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY same DESC, score DESC, qa_id) AS rn FROM s
 WHERE same OR (m > 0 AND score >= 0.20))
SELECT q.query_id, b.qa_id, floor(b.score * 1000000) AS score FROM q JOIN b USING (norm) WHERE rn = 1""".replace(
    "floor(b.score * 1000000) AS score", "CAST(floor(b.score * 1000000) AS BIGINT) AS score"))
def _(t):
    corpus = t.raw("benchmark").select(F.col("item_id").alias("qa_id"), F.col("text").alias("question"), F.lit(False).alias("generated"),
                                       F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("category"))
    docs = t.raw("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("query_id"), "text")
    found = retrieval.best_answers(turns(t).unionByName(docs), corpus)
    return found.withColumn("score", F.floor(F.col("score") * 1000000))


@query("recommended_schemes", "TXT-36 WIN-03", """
WITH p AS (SELECT query_id, CASE community WHEN 'DNC' THEN 'MBC' ELSE community END AS cat, nat, bal, seg,
 CASE WHEN bal < 3000 THEN income WHEN bal < 6000 THEN 150000 ELSE 250000 END AS inc,
 CASE WHEN nat < 8 THEN 'Tamil Nadu' WHEN nat < 14 THEN 'Kerala' WHEN nat < 20 OR seg = 'FURNITURE' THEN 'Tamil Nadu' END AS st FROM asked),
m AS (SELECT query_id, 'obc-post' AS scheme_id, CASE WHEN inc / CAST(300000 AS DOUBLE) < 0.6 THEN 75 ELSE 70 END AS score FROM p WHERE cat IN ('BC', 'MBC') AND inc <= 300000
 UNION ALL SELECT query_id, 'boys-degree', 70 FROM p WHERE bal >= 4000 AND bal < 8000 AND st = 'Tamil Nadu'
 UNION ALL SELECT query_id, 'first-graduate', 70 FROM p WHERE nat < 5 AND st = 'Tamil Nadu')
SELECT query_id, scheme_id, score FROM m""")
def _(t):
    best = retrieval.recommended(asked(t), t.schemes, 10)
    return best.where(F.col("scheme_id").isin("obc-post", "boys-degree", "first-graduate")).select("query_id", "scheme_id", "score")


@query("generated_questions", "SRC-08 SET-03", """
WITH s AS (SELECT DISTINCT n_name AS state FROM nation), c AS (SELECT DISTINCT c_mktsegment AS category FROM customer),
k AS (SELECT DISTINCT p_type AS course FROM part), t AS (SELECT unnest(['what is the eligibility for', 'which documents are needed for',
 'what is the last date to apply for', 'how to apply for', 'what is the income limit for', 'what is the helpline for']) AS f)
SELECT state, category, course, f || ' ' || lower(state) || ' ' || lower(category) || ' ' || lower(course) || ' scholarship' AS question
FROM s CROSS JOIN c CROSS JOIN k CROSS JOIN t""")
def _(t):
    name = (lambda table, col: t.raw(table).select(F.col(col).alias("name")).distinct())
    return catalogue.generated_questions(name("nation", "n_name"), name("customer", "c_mktsegment"), name("part", "p_type")).select(
        "state", "category", "course", "question")


_META = [("bc-fee", "VERIFIED", "STATE"), ("central-merit", "VERIFIED", None), ("salem-farmers", "PARTIALLY_VERIFIED", "STATE")]
_META_ROWS = "(VALUES ('bc-fee', 'VERIFIED', 'STATE'), ('central-merit', 'VERIFIED', NULL), ('salem-farmers', 'PARTIALLY_VERIFIED', 'STATE')) AS m(scheme_id, rs, j)"
_CHOSEN = "CASE WHEN c_acctbal < 2000 THEN 'bc-fee' WHEN c_acctbal < 4000 THEN 'central-merit' WHEN c_acctbal < 6000 THEN 'salem-farmers' ELSE 'obc-post' END"


def _with_meta(t):
    meta = t.spark.createDataFrame(_META, "scheme_id string, rule_status string, jurisdiction string")
    base = t.schemes.select("scheme_id", F.lit("UNVERIFIED").alias("rule_status"), F.lit("CENTRAL").alias("jurisdiction"))
    return catalogue.with_metadata(base, meta, ["rule_status", "jurisdiction"])


@query("catalogue_status", "JOI-15 AGG-25", f"""
WITH s AS (SELECT scheme_id, coalesce(rs, 'UNVERIFIED') AS rule_status, coalesce(j, 'CENTRAL') AS jurisdiction FROM schemes LEFT JOIN {_META_ROWS} USING (scheme_id))
SELECT rule_status, jurisdiction, count(*) AS students FROM (SELECT {_CHOSEN} AS scheme_id FROM customer) JOIN s USING (scheme_id) GROUP BY 1, 2""")
def _(t):
    chosen = t.raw("customer").select(F.expr(_CHOSEN).alias("scheme_id"))
    return chosen.join(_with_meta(t), "scheme_id").groupBy("rule_status", "jurisdiction").agg(F.count(F.lit(1)).alias("students"))


@query("scheme_checklists", "RUL-31 JOI-15", f"""
WITH l AS (SELECT * FROM (VALUES ('bc-fee', 'required', 'Community Certificate'), ('bc-fee', 'renewal', 'Marksheet'), ('central-merit', 'required',
 'Income Certificate'), ('obc-post', 'required', 'Aadhaar Card'), ('obc-post', 'required', 'Bank Passbook'), ('salem-farmers', 'required', 'Aadhaar Card'),
 ('salem-farmers', 'required', 'Bank Passbook')) AS l(scheme_id, kind, label))
SELECT label, kind, count(*) AS students FROM (SELECT {_CHOSEN} AS scheme_id FROM customer) JOIN l USING (scheme_id) GROUP BY 1, 2""")
def _(t):
    schemes = t.schemes.select("scheme_id", F.array(F.lit("Aadhaar Card"), F.lit("Bank Passbook")).alias("documents"))
    wanted = t.spark.createDataFrame([("bc-fee", "required", "Community Certificate", ""), ("bc-fee", "renewal", "Marksheet", ""),
                                      ("central-merit", "required", "Income Certificate", "")],
                                     "scheme_id string, kind string, label string, purpose string")
    chosen = t.raw("customer").select(F.expr(_CHOSEN).alias("scheme_id"))
    return chosen.join(catalogue.checklist(schemes, wanted), "scheme_id").groupBy("label", "kind").agg(F.count(F.lit(1)).alias("students"))


# --- evaluation ----------------------------------------------------------------------------------

_FIELDS = ["student_name", "parent_name", "date_of_birth", "marks", "percentage", "community"]


def truth(t):
    c = F.col
    return cases(t).select(
        c("student_id").alias("doc_id"), F.when(c("nat") < 12, "10th_marksheet").otherwise("income_certificate").alias("doc_type"),
        F.when(c("bal") < 5000, "clean_scan").otherwise("blur").alias("degradation"), c("full_name").alias("student_name"),
        c("parent_name"), c("dob").alias("date_of_birth"), F.concat_ws("/", "marks10", F.lit("500")).alias("marks"),
        c("percent10").cast("string").alias("percentage"), F.when(c("seg") != "FURNITURE", c("community")).alias("community"))


def predicted(t):
    """What extraction reads from the second marksheet, next to planted readings."""
    c = F.col
    return cases(t).select(
        c("student_id").alias("doc_id"), F.when(c("bal") >= 0, c("name12")).alias("student_name"),
        F.when(c("nat") < 20, c("parent_name")).alias("parent_name"), F.replace("dob12", F.lit("-"), F.lit("/")).alias("date_of_birth"),
        F.concat_ws(" / ", "marks10", F.when(c("nat") < 5, F.lit("600")).otherwise(F.lit("500"))).alias("marks"),
        F.concat((c("percent10") + F.when(c("nat") < 10, 1).otherwise(2)).cast("string"), F.lit("%")).alias("percentage"),
        F.lower("community").alias("community"),
        F.least(F.lit(99), F.floor(c("bal") / 100).cast("int")).alias("confidence"))


_EVAL = """x AS (SELECT *, CASE WHEN nat < 12 THEN '10th_marksheet' ELSE 'income_certificate' END AS doc_type, CASE WHEN bal < 5000 THEN 'clean_scan' ELSE 'blur' END
 AS degradation, CASE WHEN bal >= 0 THEN name12 END AS pname, least(99, CAST(floor(bal / 100) AS INT)) AS conf FROM cases),
s AS (SELECT *, CASE WHEN pname IS NULL THEN 'NOT_DETECTED' WHEN conf >= 75 THEN 'HIGH_CONFIDENCE' ELSE 'NEEDS_REVIEW' END AS status,
 pname IS NOT NULL AND replace(pname, ' ', '') = replace(full_name, ' ', '') AS same FROM x)"""


def names_only(t):
    pairs = evaluate.aligned(truth(t), predicted(t), "doc_id", ["student_name"], ["doc_type", "degradation"])
    return pairs.join(predicted(t).select("doc_id", "confidence"), "doc_id").withColumn(
        "status", evaluate.predicted_status(F.col("prediction"), F.col("confidence")))


@query("match_rates", "EVL-01 EVL-10", """
WITH e AS (SELECT doc_type, count(*) AS evaluated, count_if(lower(pname) = lower(full_name)) AS exact, count_if(same) AS normalised FROM s GROUP BY 1)
SELECT *, CAST(floor(exact / CAST(evaluated AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS exact_rate,
 CAST(floor(normalised / CAST(evaluated AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS normalised_rate FROM e""".replace("WITH e", f"WITH {_EVAL}, e"))
def _(t):
    return evaluate.match_rates(names_only(t), ["doc_type"])


@query("error_rates", "EVL-02", f"""
WITH {_EVAL} SELECT CAST(sum(levenshtein(lower(full_name), lower(coalesce(pname, '')))) AS BIGINT) AS char_edits, CAST(sum(length(full_name)) AS BIGINT) AS chars,
 CAST(sum(CASE WHEN pname IS NULL THEN 3 WHEN seg = 'BUILDING' THEN 1 WHEN pname = full_name THEN 0 WHEN seg = 'AUTOMOBILE' THEN 1
  WHEN seg = 'MACHINERY' THEN 2 ELSE 3 END) AS BIGINT) AS word_edits, CAST(count(*) * 3 AS BIGINT) AS words,
 char_edits / CAST(chars AS DOUBLE) AS cer, word_edits / CAST(words AS DOUBLE) AS wer FROM s""")
def _(t):
    return evaluate.error_rates(names_only(t))


_FIELD_COUNTS = f"""{_EVAL}, n AS (SELECT *, levenshtein(lower(full_name), lower(name12)) / CAST(greatest(length(full_name), length(name12)) AS DOUBLE) AS d FROM s),
f AS (SELECT nat, doc_type, seg, status, conf, unnest(['student_name', 'parent_name', 'date_of_birth', 'marks', 'percentage', 'community']) AS field,
 unnest([true, true, true, true, true, seg <> 'FURNITURE']) AS known,
 unnest([pname IS NOT NULL, nat < 20, true, true, true, true]) AS found,
 unnest([pname IS NOT NULL AND (seg IN ('BUILDING', 'MACHINERY') OR d <= 0.15), nat < 20, dob = dob12, nat >= 5, nat < 10, true]) AS good FROM n),
g AS (SELECT *, field = 'parent_name' AND doc_type = '10th_marksheet' AS gap FROM f),
r AS (SELECT field, count_if(gap) AS not_applicable, count_if(known AND NOT gap) AS evaluated, count_if(known AND found AND good AND NOT gap) AS correct,
 count_if(known AND found AND NOT good AND NOT gap) AS incorrect, count_if(known AND NOT found AND NOT gap) AS not_detected,
 count_if(known AND found AND NOT gap AND (status = 'NEEDS_REVIEW' OR conf < 70)) AS needs_review FROM g GROUP BY field)"""


@query("field_report", "EVL-03 EVL-04 EVL-05 EVL-06 JOI-16", f"""
WITH {_FIELD_COUNTS}
SELECT field, not_applicable, evaluated, correct, incorrect, not_detected, needs_review,
 CAST(floor(correct / CAST(evaluated AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS accuracy,
 CASE WHEN correct + incorrect > 0 THEN CAST(floor(correct / CAST(correct + incorrect AS DOUBLE) * 100.0 + 0.5) AS BIGINT) END AS "precision", accuracy AS recall FROM r""")
def _(t):
    return _report(t)


def _report(t):
    pairs = evaluate.aligned(truth(t), predicted(t), "doc_id", _FIELDS, ["doc_type"])
    status = predicted(t).select("doc_id", "confidence", evaluate.predicted_status(F.col("student_name"), F.col("confidence")).alias("status"))
    return evaluate.field_report(pairs.join(status, "doc_id"), ["field"])


@query("calibration", "EVL-07", f"""
WITH {_EVAL}, b AS (SELECT CASE WHEN conf >= 90 THEN '90-100' WHEN conf >= 70 THEN '70-89' WHEN conf >= 50 THEN '50-69' ELSE '<50' END AS band, same FROM s)
SELECT band, count(*) AS total, count_if(same) AS correct, CAST(floor(count_if(same) / CAST(count(*) AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS accuracy,
 band = '90-100' AND count_if(same) < count(*) AS violation FROM b GROUP BY band""")
def _(t):
    return evaluate.calibration(_judged_names(t))


def _judged_names(t):
    from stipendia.functions.names import evaluation_key
    same = evaluation_key(F.col("prediction")) == evaluation_key(F.col("truth"))
    return names_only(t).withColumn("correct", same & F.col("prediction").isNotNull())


@query("status_counts", "EVL-08", f"""
WITH {_EVAL} SELECT degradation, count_if(status = 'NOT_DETECTED') AS not_detected, count_if(status = 'NEEDS_REVIEW') AS needs_review,
 count_if(status = 'HIGH_CONFIDENCE') AS high_confidence, count_if(status = 'HIGH_CONFIDENCE' AND NOT same) AS wrong_high_confidence FROM s GROUP BY 1""")
def _(t):
    return evaluate.status_counts(_judged_names(t), ["degradation"])


@query("accuracy_breakdown", "EVL-10", f"""
WITH {_EVAL} SELECT doc_type, degradation, count(*) AS rows, count_if(same) AS correct,
 CAST(floor(count_if(same) / CAST(count(*) AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS accuracy FROM s
GROUP BY GROUPING SETS ((doc_type), (degradation), ())""".replace("AS rows", 'AS "rows"'))
def _(t):
    return evaluate.breakdown(_judged_names(t), "doc_type", "degradation")


@query("overall_accuracy", "EVL-03", f"""
WITH {_FIELD_COUNTS} SELECT CAST(sum(evaluated) AS BIGINT) AS evaluated, CAST(sum(correct) AS BIGINT) AS correct,
 CAST(floor(sum(correct) / CAST(sum(evaluated) AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS accuracy FROM r""")
def _(t):
    return evaluate.overall_accuracy(_report(t))


@query("case_agreement", "EVL-09", """
SELECT count(*) AS cases, count_if((dob <> dob12) = (bal > 9000)) AS agree,
 CAST(floor(count_if((dob <> dob12) = (bal > 9000)) / CAST(count(*) AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS agreement FROM cases""")
def _(t):
    from stipendia.operators.consistency import evaluate_cases
    c = F.col
    docs = cases(t).select(c("student_id").alias("case_id"), F.inline(F.array(
        F.struct(F.lit("ms10").alias("doc_type"), c("full_name").alias("name"), c("dob").alias("dob"), F.lit("").alias("parent_name")),
        F.struct(F.lit("ms12").alias("doc_type"), c("full_name").alias("name"), c("dob12").alias("dob"), F.lit("").alias("parent_name")))))
    expected = cases(t).select(c("student_id").alias("case_id"), F.when(c("bal") > 9000, "significant_conflict").otherwise(
        "Consistent").alias("expected"))
    return evaluate.case_agreement(evaluate_cases(docs), expected)


@query("extraction_quality", "EVL-01 EVL-03 TXT-08 SNK-03", """
SELECT 'student_name' AS field, count(*) AS evaluated, count(*) AS exact FROM cases
UNION ALL SELECT 'register_number', count(*), count(*) FROM cases""")
def _(t):
    read = fields.marksheet_fields(certificates(t, "ms10").withColumnRenamed("slot", "doc_type")).select(
        F.col("student_id").alias("doc_id"), F.upper("name").alias("student_name"), "register_number")
    labels = cases(t).select(F.col("student_id").alias("doc_id"), F.col("full_name").alias("student_name"), "register_number")
    pairs = evaluate.aligned(labels, read, "doc_id", ["student_name", "register_number"])
    return evaluate.match_rates(pairs, ["field"]).select("field", "evaluated", "exact")
