"""Certificate texts that Spark derives from the customer table.

Every customer becomes one case with six documents.  The planted values are the
columns of ``cases``; the extraction queries must find them again in the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stipendia.operators.frames import balanced
from stipendia.plans.mapping import VIEWS, Tables

# A syllable per digit, so that keys become pronounceable names.
SYLLABLES = ["ka", "ri", "mu", "ve", "sa", "ro", "ti", "la", "de", "pu"]


def _spell(expr: str) -> str:
    for digit, syllable in enumerate(SYLLABLES):
        expr = f"replace({expr}, '{digit}', '{syllable.upper()}')"
    return expr


KEYED = ["c_custkey AS student_id", "lpad(CAST(c_custkey AS STRING_), 9, '0') AS k", "c_mktsegment AS seg",
         "c_acctbal AS bal", "c_nationkey AS nat"]
NAMED = ["student_id", "k", "seg", "bal", "nat", f"{_spell('substr(k, 7, 3)')} AS n3", f"{_spell('substr(k, 4, 3)')} AS n2",
         f"{_spell('substr(k, 1, 3)')} AS n1", "translate(substr(k, 8, 1), '0', '1') AS d8",
         "translate(substr(k, 9, 1), '0', '1') AS d9", "CAST(floor(175 + (bal + 1000) * 0.0295) AS INT) AS marks10",
         "CAST(floor((bal + 1000) * 20) AS BIGINT) + 5000 AS income"]
CASES = [
    "student_id", "k", "seg", "bal", "nat", "n1", "n2", "n3", "marks10", "income",
    "concat(n3, ' ', n2, ' ', n1) AS full_name",
    "CASE WHEN seg = 'BUILDING' THEN concat(n3, ' ', n2, ' ', n1, ' K')"
    " WHEN seg = 'AUTOMOBILE' THEN concat(n3, ' ', n2, ' ', substr(n1, 1, 5))"
    " WHEN seg = 'MACHINERY' THEN concat(n2, ' ', n3, ' ', n1)"
    " WHEN seg = 'FURNITURE' AND bal > 5000 THEN 'ARUN RAJA SELVAM' ELSE concat(n3, ' ', n2, ' ', n1) END AS name12",
    "concat(n2, ' ', n3, 'VEL') AS parent_name",
    "CASE WHEN nat < 12 THEN concat(n3, ' ', n2, ' ', n1) ELSE concat(n2, ' ', n3, 'VEL') END AS income_holder",
    "CASE WHEN nat < 12 THEN 'student' ELSE 'parent' END AS income_applicant",
    "CASE WHEN bal < 0 THEN concat(n2, ' ', n3, 'VEL') ELSE concat(n3, ' ', n2, ' ', n1) END AS bank_holder",
    "CASE WHEN bal > 8000 THEN 'Joint' ELSE 'Single' END AS account_type",
    "concat('1', substr(k, 9, 1), '-0', d8, '-200', substr(k, 7, 1)) AS dob",
    "concat(CASE WHEN bal > 9000 THEN '28' ELSE concat('1', substr(k, 9, 1)) END, '-0', d8, '-200', substr(k, 7, 1)) AS dob12",
    "CASE seg WHEN 'BUILDING' THEN 'BC' WHEN 'AUTOMOBILE' THEN 'SC' WHEN 'MACHINERY' THEN 'MBC' WHEN 'HOUSEHOLD' THEN 'ST'"
    " ELSE 'DNC' END AS community",
    "CASE WHEN bal < 500 THEN 'bc' WHEN seg = 'MACHINERY' THEN 'Most Backward Class' WHEN seg = 'BUILDING' THEN 'Backward Class'"
    " WHEN seg = 'AUTOMOBILE' THEN 'Scheduled Caste' WHEN seg = 'HOUSEHOLD' THEN 'st' ELSE 'Denotified Community' END"
    " AS category_entered",
    "CASE WHEN bal > 7000 THEN income + 1000 WHEN bal < 0 THEN NULL ELSE income END AS income_entered",
    "concat('0', d9, '-0', d8, '-200', CASE WHEN bal < 3000 THEN '1' ELSE '0' END) AS issue_date",
    "CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN concat('15-0', d8, '-200', CASE WHEN bal < 4000 THEN '1' ELSE '2' END) END"
    " AS valid_upto",
    "concat('REG', k) AS register_number", "CAST(floor(marks10 / 5.0) AS INT) AS per_subject",
    "CAST(floor(marks10 / 5.0) AS INT) + CASE WHEN bal > 9500 THEN -5 ELSE 0 END AS percent10",
    "marks10 + 60 AS marks12",
]

_NL = "chr(10)"


TEXTS = {
    "ms10": f"concat('DEPARTMENT OF GOVERNMENT EXAMINATIONS', {_NL}, 'TAMIL NADU', {_NL}, 'SECONDARY SCHOOL LEAVING CERTIFICATE',"
            f" {_NL}, 'NAME OF THE CANDIDATE : ', full_name, {_NL}, 'DATE OF BIRTH : ', dob, {_NL}, 'PERMANENT REGISTER NUMBER : ',"
            f" register_number, {_NL}, 'NAME OF THE SCHOOL : GOVT HIGH SCHOOL,', {_NL}, 'SALEM', {_NL}, 'SESSION : MARCH 2020',"
            f" {_NL}, 'FATHER NAME : ', parent_name, {_NL}, 'TAMIL ', CAST(per_subject AS STRING_), {_NL}, 'ENGLISH ',"
            f" CAST(per_subject AS STRING_), {_NL}, 'MATHEMATICS ', CAST(per_subject AS STRING_), {_NL}, 'SCIENCE ',"
            f" CAST(per_subject AS STRING_), {_NL}, 'SOCIAL SCIENCE ', CAST(marks10 - 4 * per_subject AS STRING_), {_NL},"
            f" 'TOTAL MARKS : ', CAST(marks10 AS STRING_), ' / 500', {_NL}, 'PERCENTAGE : ', CAST(percent10 AS STRING_), '%',"
            f" {_NL}, 'RESULT : PASS')",
    "ms12": f"concat('HIGHER SECONDARY COURSE CERTIFICATE', {_NL}, 'GOVERNMENT OF TAMIL NADU', {_NL}, 'CANDIDATE NAME', {_NL}, name12,"
            f" {_NL}, 'DOB: ', replace(dob12, '-', '/'), {_NL}, 'REGISTER NO: ', register_number, {_NL},"
            f" 'EXAMINATION HELD IN MAY 2022', {_NL}, 'GRAND TOTAL ', CAST(marks12 AS STRING_), ' out of 600')",
    "community": f"concat('COMMUNITY CERTIFICATE', {_NL}, 'Certificate No: TN-COM-', k, {_NL}, 'This is to certify that Selvan ',"
                 f" full_name, ' son of Thiru ', parent_name, ' residing at Omalur Taluk', {_NL}, 'belongs to Hindu Vanniyar"
                 f" community which is recognised as ', community, '.', {_NL}, 'Date of Issue: ', issue_date, {_NL},"
                 f" 'District: Salem', {_NL}, 'Quota: Management', {_NL}, 'Tahsildar')",
    "income": f"concat('INCOME CERTIFICATE', {_NL}, 'Certificate No: INC/2001/', substr(k, 4, 6), {_NL}, 'Applicant Name: ',"
              f" income_holder, {_NL}, 'Annual Income: Rs. ', CAST(income AS STRING_), {_NL}, 'Date of Issue: ', issue_date, {_NL},"
              f" CASE WHEN valid_upto IS NOT NULL THEN concat('Valid upto: ', valid_upto) ELSE '-' END, {_NL}, 'Taluk: Omalur',"
              f" {_NL}, 'District: Salem', {_NL}, 'Zonal Deputy Tahsildar')",
    "aadhaar": f"concat('Government of India', {_NL}, full_name, {_NL}, 'DOB: ', replace(dob, '-', '/'), {_NL},"
               f" CASE WHEN bal < 4000 THEN 'FEMALE' ELSE 'MALE' END, {_NL}, '4', substr(k, 1, 3), ' ', substr(k, 4, 3), '7 9',"
               f" substr(k, 7, 3), {_NL}, 'Unique Identification Authority of India')",
    "bankpass": f"concat('STATE BANK OF INDIA', {_NL}, 'PASSBOOK', {_NL}, 'Account No: 31', k, {_NL}, 'IFSC: SBIN0',"
                f" substr(k, 4, 6), {_NL}, 'Name: ', bank_holder, {_NL},"
                f" CASE WHEN account_type = 'Joint' THEN 'Joint Account' ELSE 'Savings Bank Account' END)",
}


def _dialect(text: str, kind: str) -> str:
    return text.replace("STRING_", kind)


CASE_VIEWS = {
    "case_keys": _dialect(f"SELECT {', '.join(KEYED)} FROM customer", "VARCHAR"),
    "case_names": _dialect(f"SELECT {', '.join(NAMED)} FROM case_keys", "VARCHAR"),
    "cases": _dialect(f"SELECT {', '.join(CASES)} FROM case_names", "VARCHAR"),
    "certificates": " UNION ALL ".join(
        _dialect(f"SELECT student_id, '{kind}' AS slot, {text} AS text FROM cases", "VARCHAR") for kind, text in TEXTS.items()),
    "all_texts": "SELECT concat(slot, '-', student_id) AS doc_key, text FROM certificates"
                 " UNION ALL SELECT concat('D-', doc_id), text FROM documents",
}
VIEWS.update(CASE_VIEWS)


def cases(t: Tables) -> DataFrame:
    keyed = t.customers.selectExpr(*[_dialect(c, "STRING") for c in KEYED])
    return keyed.selectExpr(*[_dialect(c, "STRING") for c in NAMED]).selectExpr(*[_dialect(c, "STRING") for c in CASES])


def certificates(t: Tables, *slots: str) -> DataFrame:
    """(student_id, slot, text), one scan of the customer table."""
    wanted = slots or tuple(TEXTS)
    rows = F.array(*[F.struct(F.lit(s).alias("slot"), F.expr(_dialect(TEXTS[s], "STRING")).alias("text")) for s in wanted])
    return cases(t).select("student_id", F.inline(rows))


def all_texts(t: Tables) -> DataFrame:
    certs = certificates(t).select(F.concat_ws("-", "slot", F.col("student_id").cast("string")).alias("doc_key"), "text")
    docs = t.raw("documents").select(F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("doc_key"), "text")
    return certs.unionByName(balanced(docs))
