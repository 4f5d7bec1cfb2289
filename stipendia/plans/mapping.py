"""The driver tables read as scholarship entities.

Column texts below are plain ANSI expressions that Spark and the checking
engine both accept, so an entity means the same on both sides; the jobs that
run on the entities are written independently of the checking SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from stipendia.operators.frames import fixed_rows, spread

AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

# One rule per scheme (scheme, version, income cap, minimum marks, category, college deadline,
# budget, effective from, effective to).
RULES = [
    ("1-URGENT", "2001.1", 5000.00, 150000.00, "BUILDING", "1998-06-30 00:00:00", 900000000.00, "1995-01-01", None),
    ("2-HIGH", "2001.1", 7500.00, 200000.00, None, "1999-12-31 00:00:00", 50000000.00, "1995-01-01", None),
    ("3-MEDIUM", "2001.1", 2500.00, 100000.00, "MACHINERY", "2001-08-10 12:00:00", 800000000.00, "1996-01-01", None),
    ("4-NOT SPECIFIED", "2001.1", 9000.00, 250000.00, None, None, 0.00, "1995-01-01", None),
    ("5-LOW", "2001.1", 6000.00, 50000.00, "FURNITURE", "2001-12-31 00:00:00", 700000000.00, "1997-01-01", None),
]

STATUS = """CASE
 WHEN o_orderstatus = 'O' THEN CASE WHEN o_totalprice < 50000 THEN 'DRAFT' ELSE 'SUBMITTED' END
 WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice < 150000 THEN 'COLLEGE_REVIEW'
   WHEN o_totalprice < 250000 THEN 'CORRECTION_REQUIRED' ELSE 'MINISTRY_SCRUTINY' END
 ELSE CASE WHEN o_totalprice < 100000 THEN 'NOT_SELECTED' WHEN o_totalprice < 200000 THEN 'SELECTED'
   WHEN o_totalprice < 300000 THEN 'SANCTIONED' WHEN o_totalprice < 400000 THEN 'PAID'
   WHEN o_totalprice < 450000 THEN 'AWARD_ACCEPTANCE' ELSE 'CONTINUATION' END END"""

APPLICATIONS = [
    "o_orderkey AS application_id", "o_custkey AS student_id", "o_orderpriority AS scheme_id",
    f"{STATUS} AS application_status",
    "CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_totalprice >= 250000) THEN 'VERIFIED'"
    " WHEN o_orderstatus = 'P' THEN 'IN_REVIEW' ELSE 'PENDING' END AS document_status",
    "CASE WHEN o_totalprice < 20000 THEN 'EXTERNAL_TRACKING' ELSE 'INTERNAL' END AS route",
    "CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS academic_year",
    "CAST(o_totalprice AS DECIMAL(18,2)) AS marks", "o_orderdate AS submitted_at",
]
STUDENTS = [
    "c_custkey AS student_id", "c_name AS full_name", "c_nationkey AS college_id", "c_mktsegment AS category",
    "c_mktsegment AS department",
    "CASE WHEN c_acctbal < 2500 THEN 'UG' WHEN c_acctbal < 7500 THEN 'PG' ELSE 'DIPLOMA' END AS course",
    "CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS DECIMAL(14,2)) END AS family_income",
    "CASE WHEN c_acctbal >= 0 THEN 'ACTIVE' ELSE 'INVITED' END AS account_status",
]
PAYMENTS = [
    "l_orderkey AS application_id", "l_linenumber AS instalment",
    "CAST(l_orderkey * 1000000 + l_partkey AS BIGINT) AS payment_id", "l_suppkey AS officer_id",
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS sanctioned",
    "CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)"
    " AS DECIMAL(18,2)) AS paid",
    "CASE WHEN l_returnflag = 'R' THEN 'REVERSED' WHEN l_linestatus = 'F' THEN 'CONFIRMED'"
    " ELSE 'PENDING' END AS payment_status",
    "CASE WHEN l_returnflag = 'A' THEN 'INSTITUTIONAL_FEE' ELSE 'STUDENT' END AS recipient_type",
    "l_discount > 0.05 AS is_partial", "l_shipdate AS paid_on",
]
DEFICIENCIES = [
    "l_orderkey AS application_id",
    "CASE WHEN l_tax < 0.015 THEN 'MISSING_DOCUMENT' WHEN l_tax < 0.025 THEN 'DATA_MISMATCH'"
    " WHEN l_tax < 0.045 THEN 'INVALID_INFORMATION' WHEN l_tax < 0.065 THEN 'UNCLEAR_DOCUMENT'"
    " ELSE 'OTHER' END AS deficiency_type",
    "CASE WHEN l_quantity < 15 THEN 'LOW' WHEN l_quantity < 35 THEN 'MEDIUM' ELSE 'HIGH' END AS severity",
    "CASE WHEN l_linestatus = 'O' THEN 'OPEN' ELSE 'RESOLVED' END AS status", "l_shipdate AS created_at",
]
REVIEWS = [
    "l_orderkey AS application_id", "l_suppkey AS reviewer_id",
    "CASE WHEN l_returnflag = 'A' THEN 'VERIFIED' ELSE 'CORRECTION_REQUESTED' END AS decision",
    "l_shipdate AS reviewed_at", "l_linenumber AS line_number", "l_partkey AS part_number",
]
HISTORY = ["event_id AS history_id", "user_id AS application_id", "event_type AS new_status",
           "ts AS changed_at", "value", "props"]

PROFILES = [
    "c_custkey AS student_id",
    "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN 'Girls' ELSE 'Boys' END AS gender",
    "CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal * 50) AS BIGINT) END AS income",
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'BC' WHEN 'AUTOMOBILE' THEN 'SC' WHEN 'MACHINERY' THEN 'MBC'"
    " WHEN 'HOUSEHOLD' THEN 'General' END AS category",
    "CASE r_name WHEN 'ASIA' THEN 'Tamil Nadu' WHEN 'EUROPE' THEN 'Tamil Nadu' WHEN 'AFRICA' THEN 'Kerala'"
    " WHEN 'AMERICA' THEN 'Maharashtra' END AS state",
    "CASE WHEN n_nationkey < 8 THEN 'Salem' WHEN n_nationkey < 16 THEN 'Chennai' END AS district",
    "CASE WHEN c_acctbal < 1500 THEN 'Engineering' WHEN c_acctbal < 3000 THEN 'Medical' WHEN c_acctbal < 5000 THEN 'Arts'"
    " WHEN c_acctbal < 7000 THEN 'Diploma' WHEN c_acctbal < 8500 THEN 'All' END AS course",
    "CASE WHEN c_mktsegment = 'FURNITURE' THEN true WHEN c_acctbal < 3000 THEN false END AS disabled",
    "CASE WHEN n_regionkey = 1 THEN true WHEN n_regionkey = 2 THEN false END AS govt_school",
    "CASE WHEN n_nationkey < 10 THEN true WHEN n_nationkey < 20 THEN false END AS agri_labor",
    "CASE WHEN n_nationkey >= 23 THEN 'farmer' END AS parent_occupation",
    "CASE WHEN c_acctbal > 9000 THEN true WHEN c_acctbal > 4000 THEN false END AS armed_forces",
    "CASE WHEN c_acctbal < 2000 THEN true WHEN c_acctbal < 6000 THEN false END AS first_graduate",
    "CASE n_regionkey WHEN 0 THEN 'management' WHEN 4 THEN 'unknown' WHEN 3 THEN NULL ELSE 'government' END AS quota_type",
]
# Scheme catalogue of the checks (id, gender, income limit, category, state, district, course,
# disability, government school, agricultural labour, armed forces, first graduate, quota, potential when disabled).
SCHEMES = [
    ("central-merit", "All", 450000, "General", "All-India", "All", "All", 0, 0, 0, 0, 0, 0, 0),
    ("girls-degree", "Girls", 200000, "All", "Tamil Nadu", "All", "All", 0, 1, 0, 0, 0, 0, 0),
    ("boys-degree", "Boys", 99999999, "All", "Tamil Nadu", "All", "All", 0, 0, 0, 0, 0, 0, 0),
    ("bc-fee", "All", 250000, "BC", "Tamil Nadu", "All", "All", 0, 0, 0, 0, 0, 1, 0),
    ("obc-post", "All", 300000, "OBC", "All", "All", "All", 0, 0, 0, 0, 0, 0, 0),
    ("sc-engineering", "All", 250000, "SC", "All-India / National", "All", "Engineering", 0, 0, 0, 0, 0, 0, 0),
    ("salem-farmers", "All", 150000, "All", "Tamil Nadu", "Salem", "All", 0, 0, 1, 0, 0, 0, 0),
    ("special-ability", "All", 800000, "All", "All-India", "All", "Diploma", 1, 0, 0, 0, 0, 0, 1),
    ("forces-wards", "All", 99999999, "All", "All-India", "All", "All", 0, 0, 0, 1, 0, 0, 0),
    ("first-graduate", "All", 99999999, "All", "Tamil Nadu", "All", "All", 0, 0, 0, 0, 1, 0, 0),
]
SCHEME_FIELDS = ["scheme_id", "gender", "income_limit", "category", "state", "district", "course",
                 "requires_disability", "requires_govt_school", "requires_agri_labor", "requires_armed_forces",
                 "requires_first_graduate", "requires_govt_quota", "potential_if_disabled"]
ROSTER = [
    "c_custkey AS row_number", "c_nationkey AS college_id",
    "CASE WHEN c_acctbal < -900 THEN '' ELSE concat('R', CAST(CAST(floor(c_acctbal / 10) AS BIGINT) AS STRING_)) END"
    " AS register_number",
    "CASE WHEN c_acctbal > 9900 THEN NULL ELSE c_name END AS full_name",
    "CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 500 THEN 'no-mail'"
    " ELSE concat('S', CAST(c_custkey AS STRING_), '@Example.org') END AS email",
]
# Numbers and addresses already in use, read from the officers' table.
REGISTER = [
    "s_nationkey AS college_id", "concat('R', CAST(CAST(floor(s_acctbal / 10) AS BIGINT) AS STRING_)) AS register_number",
    "concat('s', CAST(s_suppkey AS STRING_), '@example.ORG') AS email",
]
UPLOADS = [
    "l_orderkey AS application_id",
    "CASE l_returnflag WHEN 'A' THEN 'income' WHEN 'N' THEN 'community' ELSE 'marksheet' END AS document_type",
    "CAST(l_orderkey * 1000000 + l_partkey AS BIGINT) AS verification_id", "l_shipdate AS processed_at",
    "l_discount >= 0.08 AS mismatch",
]


def dialect(columns: list[str], text_type: str) -> list[str]:
    return [c.replace("STRING_", text_type) for c in columns]


def _sql_value(value) -> str:
    return "NULL" if value is None else (f"'{value}'" if isinstance(value, str) else f"{value:.2f}")


_SCHEME_ROWS = ", ".join(
    "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in SCHEMES)
_RULE_ROWS = ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in RULES)

VIEWS = {
    "apps_raw": f"SELECT {', '.join(APPLICATIONS)} FROM orders",
    "students": f"SELECT {', '.join(STUDENTS)} FROM customer",
    "colleges": "SELECT n_nationkey AS college_id, n_name AS college_name, r_name AS state"
                " FROM nation JOIN region ON n_regionkey = r_regionkey",
    "apps": "SELECT a.*, s.college_id FROM apps_raw a LEFT JOIN students s ON a.student_id = s.student_id",
    "stage_times": "SELECT l_orderkey AS application_id, min(l_shipdate) AS first_ship,"
                   " min(CASE WHEN l_linestatus = 'O' THEN l_shipdate END) AS scrutiny_ship,"
                   " min(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS selected_at,"
                   " min(CASE WHEN l_returnflag = 'N' THEN l_shipdate END) AS sanctioned_at,"
                   " max(CASE WHEN l_linestatus = 'F' THEN l_shipdate END) AS paid_at,"
                   " max(l_suppkey) AS last_officer, count(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 END)"
                   " AS open_deficiencies FROM lineitem GROUP BY l_orderkey",
    "apps_timed": "SELECT a.*, CASE WHEN a.document_status = 'VERIFIED' THEN t.first_ship END AS college_verified_at,"
                  " CASE WHEN a.document_status = 'VERIFIED' THEN t.scrutiny_ship END AS scrutinized_at,"
                  " t.selected_at, t.sanctioned_at, t.paid_at,"
                  " CASE WHEN a.application_status <> 'SUBMITTED' THEN t.last_officer END AS reviewer_id,"
                  " t.open_deficiencies, CAST(a.marks / 5000 AS DECIMAL(18,2)) AS attendance"
                  " FROM apps a LEFT JOIN stage_times t ON a.application_id = t.application_id",
    "payments_raw": f"SELECT {', '.join(PAYMENTS)} FROM lineitem",
    "payments": "SELECT p.*, a.student_id, a.college_id, a.scheme_id, a.academic_year FROM payments_raw p"
                " JOIN apps a ON p.application_id = a.application_id",
    "rules": "SELECT scheme_id, rule_version, CAST(max_income AS DECIMAL(14,2)) AS max_income,"
             " CAST(min_marks AS DECIMAL(18,2)) AS min_marks, category,"
             " CAST(college_deadline AS TIMESTAMP) AS college_deadline,"
             " CAST(allocated_budget AS DECIMAL(18,2)) AS allocated_budget,"
             " CAST(effective_from AS DATE) AS effective_from, CAST(effective_to AS DATE) AS effective_to"
             f" FROM (VALUES {_RULE_ROWS}) AS r(scheme_id, rule_version, max_income, min_marks, category,"
             " college_deadline, allocated_budget, effective_from, effective_to)",
    "doc_checks": "SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'VERIFIED'"
                  " WHEN l.quality IS NULL THEN 'PENDING' ELSE 'REJECTED' END AS verification_status,"
                  " CASE WHEN l.quality IS NOT NULL THEN least(100, CAST(floor(d.n_chars / 10.0) AS INT)) END AS confidence"
                  " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "deficiencies": f"SELECT {', '.join(DEFICIENCIES)} FROM lineitem WHERE l_returnflag = 'R'",
    "reviews": f"SELECT {', '.join(REVIEWS)} FROM lineitem",
    "history": f"SELECT {', '.join(HISTORY)} FROM events",
    "profiles": f"SELECT {', '.join(PROFILES)} FROM customer JOIN nation ON c_nationkey = n_nationkey"
                " JOIN region ON n_regionkey = r_regionkey",
    "schemes": f"SELECT * FROM (VALUES {_SCHEME_ROWS}) AS s({', '.join(SCHEME_FIELDS)})",
    "roster": f"SELECT {', '.join(dialect(ROSTER, 'VARCHAR'))} FROM customer",
    "taken_keys": f"SELECT {', '.join(dialect(REGISTER, 'VARCHAR'))} FROM supplier",
    "uploads": f"SELECT {', '.join(UPLOADS)} FROM lineitem",
    "tickets": "SELECT event_id AS ticket_id, user_id AS student_id, ts AS opened_at, value AS weight"
               " FROM events WHERE event_type = 'error'",
}


class Tables:
    """Entity DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def customers(self) -> DataFrame:
        """For work that costs far more than moving the narrow row it is done on."""
        return spread(self.raw("customer"), "c_custkey")

    @cached_property
    def apps_raw(self) -> DataFrame:
        return self.raw("orders").selectExpr(*APPLICATIONS)

    @cached_property
    def students(self) -> DataFrame:
        return self.raw("customer").selectExpr(*STUDENTS)

    @cached_property
    def colleges(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("college_id"), F.col("n_name").alias("college_name"),
            F.col("r_name").alias("state"))

    @cached_property
    def apps(self) -> DataFrame:
        return self.apps_raw.join(self.students.select("student_id", "college_id"), "student_id", "left")

    @cached_property
    def apps_timed(self) -> DataFrame:
        ship, flag, line = F.col("l_shipdate"), F.col("l_returnflag"), F.col("l_linestatus")
        times = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("application_id")).agg(
            F.min(ship).alias("first_ship"), F.min(F.when(line == "O", ship)).alias("scrutiny_ship"),
            F.min(F.when(flag == "A", ship)).alias("selected_at"),
            F.min(F.when(flag == "N", ship)).alias("sanctioned_at"),
            F.max(F.when(line == "F", ship)).alias("paid_at"), F.max("l_suppkey").alias("last_officer"),
            F.count_if((flag == "R") & (line == "O")).alias("open_deficiencies"))
        checked = F.col("document_status") == "VERIFIED"
        return self.apps.join(times, "application_id", "left").select(
            *self.apps.columns, F.when(checked, F.col("first_ship")).alias("college_verified_at"),
            F.when(checked, F.col("scrutiny_ship")).alias("scrutinized_at"),
            "selected_at", "sanctioned_at", "paid_at",
            F.when(F.col("application_status") != "SUBMITTED", F.col("last_officer")).alias("reviewer_id"),
            "open_deficiencies", (F.col("marks") / 5000).cast("decimal(18,2)").alias("attendance"))

    @cached_property
    def payments_raw(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*PAYMENTS)

    @cached_property
    def payments(self) -> DataFrame:
        return self.payments_raw.join(
            self.apps.select("application_id", "student_id", "college_id", "scheme_id", "academic_year"),
            "application_id")

    @cached_property
    def rules(self) -> DataFrame:
        names = ["scheme_id", "rule_version", "max_income", "min_marks", "category", "college_deadline",
                 "allocated_budget", "effective_from", "effective_to"]
        types = ["string", "string", "double", "double", "string", "string", "double", "string", "string"]
        df = fixed_rows(self.spark, RULES, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
        return df.select(
            "scheme_id", "rule_version", F.col("max_income").cast("decimal(14,2)").alias("max_income"),
            F.col("min_marks").cast("decimal(18,2)").alias("min_marks"), "category",
            F.col("college_deadline").cast("timestamp_ntz").alias("college_deadline"),
            F.col("allocated_budget").cast("decimal(18,2)").alias("allocated_budget"),
            F.col("effective_from").cast("date").alias("effective_from"),
            F.col("effective_to").cast("date").alias("effective_to"))

    @cached_property
    def doc_checks(self) -> DataFrame:
        labels = self.raw("labels")
        return self.raw("documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left").select(
            "doc_id", "source",
            F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "VERIFIED")
            .when(F.col("quality").isNull(), "PENDING").otherwise("REJECTED").alias("verification_status"),
            F.when(F.col("quality").isNotNull(), F.least(F.lit(100), F.floor(F.col("n_chars") / 10.0).cast("int"))
                   ).alias("confidence"))

    @cached_property
    def deficiencies(self) -> DataFrame:
        return self.raw("lineitem").where("l_returnflag = 'R'").selectExpr(*DEFICIENCIES)

    @cached_property
    def reviews(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*REVIEWS)

    @cached_property
    def profiles(self) -> DataFrame:
        customer, nation, region = self.customers, self.raw("nation"), self.raw("region")
        return (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
                .join(region, nation.n_regionkey == region.r_regionkey).selectExpr(*PROFILES))

    @cached_property
    def schemes(self) -> DataFrame:
        types = ["string", "string", "long"] + ["string"] * 4 + ["int"] * 7
        df = fixed_rows(self.spark, SCHEMES, ", ".join(f"{n} {t}" for n, t in zip(SCHEME_FIELDS, types)))
        flags = {c: F.col(c) == 1 for c in SCHEME_FIELDS[7:]}
        return df.withColumns(flags).withColumn(
            "potential_courses", F.array(F.lit("Engineering"), F.lit("Diploma")))

    @cached_property
    def roster(self) -> DataFrame:
        return self.raw("customer").selectExpr(*dialect(ROSTER, "STRING"))

    @cached_property
    def register(self) -> DataFrame:
        return self.raw("supplier").selectExpr(*dialect(REGISTER, "STRING"))

    @cached_property
    def uploads(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*UPLOADS)

    @cached_property
    def history(self) -> DataFrame:
        return self.raw("events").selectExpr(*HISTORY)

    @cached_property
    def tickets(self) -> DataFrame:
        return self.raw("events").where("event_type = 'error'").selectExpr(
            "event_id AS ticket_id", "user_id AS student_id", "ts AS opened_at", "value AS weight")
