import random

from pyspark.sql import functions as F

from stipendia.functions.scalars import as_instant
from stipendia.operators import documents, eligibility, fields, filters, frames, intake, lifecycle, readiness, retrieval

PROFILE = ("student_id string, gender string, income long, category string, state string, district string, course string, disabled boolean, "
           "govt_school boolean, agri_labor boolean, parent_occupation string, armed_forces boolean, first_graduate boolean, quota_type string")
SCHEME = ("scheme_id string, gender string, income_limit long, category string, state string, district string, course string, requires_disability boolean, "
          "requires_govt_school boolean, requires_agri_labor boolean, requires_armed_forces boolean, requires_first_graduate boolean, "
          "requires_govt_quota boolean, potential_if_disabled boolean, potential_courses array<string>")


def profile(key, **over):
    base = dict(gender="Girls", income=150000, category="BC", state="Tamil Nadu", district="Salem", course="Engineering", disabled=False,
                govt_school=True, agri_labor=False, parent_occupation=None, armed_forces=False, first_graduate=True, quota_type="government")
    base.update(over)
    return (key, *base.values())


def scheme(key, **over):
    base = dict(gender="All", income_limit=250000, category="All", state="All", district="All", course="All", d=False, g=False, a=False, f=False,
                first=False, quota=False, pot=False, courses=None)
    base.update(over)
    return (key, *base.values())


def match(spark, people, schemes):
    got = eligibility.match_all(spark.createDataFrame(people, PROFILE), spark.createDataFrame(schemes, SCHEME)).collect()
    return {(r.student_id, r.scheme_id): (r.match_type, r.score) for r in got}


def test_eligibility(spark):
    people = [profile("ok"), profile("rich", income=300000), profile("unknown", income=None), profile("nofg", first_graduate=None),
              profile("mgmt", quota_type="management"), profile("dis", disabled=True, income=None)]
    schemes = [scheme("plain", category="BC", course="Engineering", district="Salem", state="Tamil Nadu"), scheme("fg", first=True),
               scheme("quota", quota=True), scheme("dis", d=True, pot=True), scheme("open", income_limit=99999999)]
    got = match(spark, people, schemes)
    assert got[("ok", "plain")] == ("CONFIRMED MATCH", 95)
    assert got[("rich", "plain")] == ("NOT MATCHED", 0) and got[("unknown", "plain")] == ("NEEDS MORE INFORMATION", 0)
    assert got[("nofg", "fg")] == ("NEEDS MORE INFORMATION", 0) and got[("mgmt", "quota")] == ("NOT MATCHED", 0)
    assert got[("dis", "dis")] == ("POTENTIAL MATCH", 55) and got[("ok", "dis")] == ("NOT MATCHED", 0)
    assert got[("rich", "open")] == ("CONFIRMED MATCH", 70)
    reason = eligibility.match_all(spark.createDataFrame(people[:1], PROFILE), spark.createDataFrame(schemes[:1], SCHEME)).first().criteria
    assert {c.criterion for c in reason} == {"income", "category", "state", "district", "course"} and all(c.reason for c in reason)


def test_rule_index_equals_all_pairs(spark):
    """Every pair that no criterion refuses, and no other, for more schemes than one bit set holds."""
    rnd = random.Random(11)
    yes_no = [True, False, None]
    words = dict(gender=["Girls", "Boys", "All", "", None], category=["BC", "bc", "MBC", "DNC", "SC", "General", "", None], income=[None, 0, 99, 100, 101, 5000, 10**9],
                 state=["Tamil Nadu", "KERALA", "All", None, ""], district=["Salem", "salem", "All", "Chennai", None], course=["Engineering", "ARTS", "All", None],
                 quota_type=["government", "Management", "unknown", None], parent_occupation=["farmer", None])
    people = [profile(f"p{i}", **{k: rnd.choice(v) for k, v in words.items()}, disabled=rnd.choice(yes_no), govt_school=rnd.choice(yes_no),
                      agri_labor=rnd.choice(yes_no), armed_forces=rnd.choice(yes_no), first_graduate=rnd.choice(yes_no)) for i in range(60)]
    rare = lambda: rnd.random() < 0.2
    schemes = [scheme(f"s{i:03}", gender=rnd.choice(["All", "Girls", "Boys", None]), income_limit=rnd.choice([99999999, 100, 0, 5000, None]),
                      category=rnd.choice(["All", "all", "ALL", "BC", "OBC", "sc", "General", None]), state=rnd.choice(["All", "All-India", "tamil nadu", "Kerala", None]),
                      district=rnd.choice(["All", "All", "Salem", None]), course=rnd.choice(["All", "All", "engineering"]), d=rare(), g=rare(), a=rare(), f=rare(),
                      first=rare(), quota=rare(), pot=rare()) for i in range(150)]
    people, schemes = spark.createDataFrame(people * 2, PROFILE), spark.createDataFrame(schemes, SCHEME)
    every = [tuple(r) for r in eligibility.match_all(people, schemes).collect()]
    found = [tuple(r) for r in eligibility.open_matches(people, schemes).collect()]
    assert sorted(map(str, found)) == sorted(str(r) for r in every if r[2] != "NOT MATCHED") and 500 < len(found) < len(every) / 2
    for empty in (people.limit(0), schemes), (people, schemes.limit(0)):
        assert eligibility.open_matches(*empty).count() == 0


def test_plans_start_no_job(spark):
    people, schemes = spark.createDataFrame([profile("a")], PROFILE), spark.createDataFrame([scheme("s")], SCHEME)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    eligibility.open_matches(people, schemes)
    eligibility.match_all(people, schemes)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before


def test_upload_labels(spark):
    rows = [("Class 12 Marksheet", "twelfth", True), ("Aadhaar Card", "aadhar", True), ("Bank Passbook", "income", False),
            ("College Bonafide Certificate", "admission", True), ("OBC Certificate", "caste", True)]
    df = spark.createDataFrame(rows, "l string, u string, want boolean")
    assert [r for r in df.select("l", "want", readiness.upload_matches(F.col("l"), F.col("u")).alias("got")).collect() if r.got != r.want] == []


def test_levels(spark):
    rows = [(95, False, "READY_TO_SUBMIT"), (95, True, "NEEDS_CONFIRMATION"), (80, False, "REVIEW_BEFORE_SUBMIT"), (60, True, "CORRECTIONS_NEEDED"),
            (10, False, "NOT_READY")]
    df = spark.createDataFrame(rows, "s int, u boolean, want string")
    assert [r for r in df.select("want", readiness.level(F.col("s"), F.col("u")).alias("got")).collect() if r.got != r.want] == []


def test_titles_with_noise(spark):
    df = spark.createDataFrame([(1, "SEC0NDARY SCH00L LEAV1NG CERT1F1CATE\nx"), (2, "SECONDARY SCHOOL LEAVING CERTIFICATE"), (3, "some income text here"),
                                (4, "short")], "id int, text string")
    got = {r.id: (r.title_type, r.title_confidence, r.identified) for r in documents.titles(df).collect()}
    assert got == {1: ("ms10", 85, True), 2: ("ms10", 95, True), 3: ("unknown", 61, False), 4: ("unknown", 0, False)}


def test_types(spark):
    df = spark.createDataFrame([(1, "COMMUNITY CERTIFICATE certified that X belongs to MBC community. Tahsildar, Salem district"),
                                (2, "nothing of interest is written in this text"), (3, "tiny")], "id int, text string")
    got = {r.id: r for r in documents.classify(df).collect()}
    assert (got[1].doc_type, got[1].confidence, got[1].state, got[1].authority) == ("community", 98, "Tamil Nadu", "Tahsildar")
    assert got[1].reasons[0] == "Community/Caste Certificate explicit title" and got[1].scores["community"] >= 20
    assert (got[2].doc_type, got[3].doc_type, got[3].confidence) == ("unknown", "unknown", 0)


def test_marksheet_text(spark):
    sheet = "\n".join(["STATEMENT OF MARKS", "NAME OF THE CANDIDATE", "ARUN KUMAR S", "TAMIL 90", "ENGLISH 91", "MATHS 88", "PHYSICS 90 100",
                       "CHEMISTRY 90 100", "GRAND TOTAL 449 / 500", "PERCENTAGE : 89.8%", "DATE OF BIRTH : 31-02-2004", "FATHER NAME : HEADMASTER"])
    row = fields.marksheet_fields(spark.createDataFrame([("a", "ms10", sheet)], "id string, doc_type string, text string")).first()
    assert (row.name, row.scored, row.maximum, row.percentage, row.percentage_source) == ("Arun Kumar S", 449, 500, 89.8, "explicit")
    assert row.conflict is None and row.dob is None and row.father_name is None
    assert [(s.subject, s.marks) for s in row.subjects] == [("TAMIL", 90), ("ENGLISH", 91), ("MATHS", 88), ("PHYSICS", 90), ("CHEMISTRY", 90)]
    other = "MARKSHEET\nTOTAL MARKS : 455 / 500\nPERCENTAGE : 70%"
    row = fields.marksheet_fields(spark.createDataFrame([("a", "ms10", other)], "id string, doc_type string, text string")).first()
    assert (row.percentage, row.conflict, row.marks_confidence, row.percentage_confidence) == (70.0, "percentage", 58, 55)


def test_questions(spark):
    rows = [("family income 1.5 lakh in salem", 150000, "Salem", "Tamil Nadu", None, None), ("₹2,50,000", 250000, None, None, None, None),
            ("I am an MBC student looking for college aid", None, None, None, "MBC", None),
            ("assistance for male college student in diploma", None, None, None, None, "Boys"), ("salary is around 50k", 50000, None, None, None, None),
            ("250000", 250000, None, None, None, None), ("my roll number is 12", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, inc long, dist string, st string, cat string, sex string")
    got = retrieval.slots(df).collect()
    assert [r for r in got if (r.income, r.district, r.state, r.category, r.gender) != (r.inc, r.dist, r.st, r.cat, r.sex)] == []
    asks = [("hello there", "greeting"), ("how to apply for it", "apply"), ("I am a bc student, am I eligible", "eligibility"), ("qwerty", "unknown"),
            ("is dbt enabled in my bank", "dbt_check")]
    df = spark.createDataFrame(asks, "text string, want string")
    assert [r for r in retrieval.intents(df).collect() if r.intent != r.want] == []


def test_answers_equal_brute_force(spark):
    corpus = [(1, "What documents are needed for scholarship renewal", False, None, None), (4, "hi", False, None, None),
              (11, "What is NSP portal", False, None, None),
              (1001, "what is the income limit for kerala obc engineering scholarship", True, "Kerala", "OBC"),
              (1002, "what is the income limit for bihar obc engineering scholarship", True, "Bihar", "OBC")]
    corpus = spark.createDataFrame(corpus, "qa_id long, question string, generated boolean, state string, category string")
    asked = [(1, "hi"), (2, "tell me what is nsp please"), (3, "income limit kerala obc engineering"), (4, "income limit obc engineering"),
             (5, "documents needed renewal"), (6, "zzz qqq"), (7, "What is NSP portal?"), (8, "documents needed renewal")]
    got = {r.query_id: (r.qa_id, round(r.score, 3)) for r in retrieval.best_answers(
        spark.createDataFrame(asked, "query_id int, text string"), corpus).collect()}
    assert got == {1: (4, 1.0), 2: (11, 0.95), 3: (1001, 0.833), 5: (1, 0.75), 7: (11, 1.0), 8: (1, 0.75)}


def test_pairs_that_cannot_reach_the_threshold_are_not_compared(spark, monkeypatch):
    """7 of 35 tokens shared is just enough; 5 of 20 and 20 is not, though the rarest tokens known hold one that is shared."""
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    corpus = [(1, " ".join(words("shared", 7)))] + [(100 + i, " ".join(words("often", 5) + words(f"other{i}x", 15))) for i in range(20)]
    corpus = spark.createDataFrame([(*c, False, None, None) for c in corpus], "qa_id long, question string, generated boolean, state string, category string")
    mixed = " ".join(w for i, s in enumerate(words("shared", 7)) for w in [*words(f"own{i}x", 4), s])
    asked = spark.createDataFrame([(1, mixed), (2, " ".join(words("often", 5) + words("mine", 15)))], "query_id int, text string")
    seen = []
    monkeypatch.setattr(retrieval, "once", lambda df, *columns: seen.append(df) or frames.once(df, *columns))
    rows = retrieval.best_answers(asked, corpus).collect()
    assert [(r.query_id, r.qa_id, round(r.score, 6)) for r in rows] == [(1, 1, 0.2)]
    assert [r.qa_id for r in seen[-1].collect()] == [1]


def test_intake(spark):
    rows = spark.createDataFrame([(1, "c", "R1", "A", "a@x"), (2, "c", "R1", "B", "b@x"), (3, "c", "R2", "C", "c@x"), (4, "c", "R3", "D", "D@x"),
                                  (5, "c", "", "E", "e@x"), (6, "c", "R5", "F", "bad"), (7, "c", "R6", "G", "g@x")],
                                 "n int, college_id string, register_number string, full_name string, email string")
    register = spark.createDataFrame([("c", "R2"), ("other", "R6")], "college_id string, register_number string")
    accounts = spark.createDataFrame([("d@X",)], "email string")
    got = {r.n: r.verdict for r in intake.verdicts(rows, register, accounts).collect()}
    assert got == {1: "DUPLICATE", 2: "DUPLICATE", 3: "DUPLICATE", 4: "DUPLICATE", 5: "INVALID", 6: "INVALID", 7: "VALID"}


def test_feedback(spark):
    df = spark.createDataFrame([("n", "a@b.c", "t", "hello", "", 5), ("n", "bad", "t", "x", "", 9), ("", "", "", "", "", 0)],
                               "name string, email string, issue_type string, message string, comment string, rating int")
    assert [r.issues for r in filters.feedback_issues(df).collect()] == [[], ["invalid email", "rating out of range"], ["empty report"]]


def test_submission_moves(spark):
    rows = [("DRAFT", "SUBMITTED"), ("CORRECTION_REQUIRED", "RESUBMITTED"), ("PAID", None)]
    df = spark.createDataFrame(rows, "s string, want string")
    assert [r for r in df.select("want", lifecycle.status_after_submit(F.col("s")).alias("got")).collect() if r.got != r.want] == []
    one = df.select(lifecycle.status_after_review(F.lit("VERIFIED"), F.col("s")).alias("x"), lifecycle.stage_of(F.lit("IN_PROCESS")).alias("y")).first()
    assert (one.x, one.y) == ("COLLEGE_REVIEW", "COLLEGE_REVIEW")


def test_second_alert_run_creates_none(spark):
    apps = spark.createDataFrame([("a1", "s", "SUBMITTED"), ("a2", "s", "PAID")], "application_id string, scheme_id string, application_status string")
    rules = spark.range(1).select(F.lit("s").alias("scheme_id"), as_instant("2024-01-01 00:00:00").alias("college_deadline"))
    now = "2024-01-03 06:00:00"
    late = lifecycle.overdue_applications(apps, rules, now)
    none = spark.createDataFrame([], "application_id string, created_at timestamp_ntz")
    first = lifecycle.delay_alerts(late, none, now)
    assert [(r.application_id, r.days_overdue) for r in first.collect()] == [("a1", 3)]
    sent = first.select("application_id", as_instant(now).alias("created_at"))
    assert lifecycle.delay_alerts(late, sent, "2024-01-04 05:00:00").count() == 0
    assert lifecycle.delay_alerts(late, sent, "2024-01-04 07:00:00").count() == 1


def test_case_file_keeps_childless_applications(spark):
    from stipendia.operators import enrich
    apps = spark.createDataFrame([(1, "A"), (2, "B")], "application_id long, application_status string")
    none = spark.createDataFrame([], "application_id long, deficiency_type string, severity string, status string, created_at timestamp")
    reviews = spark.createDataFrame([], "application_id long, reviewed_at timestamp, decision string, reviewer_id long")
    results = spark.createDataFrame([], "application_id long, evaluated_at timestamp, result string")
    moves = spark.sql("SELECT 1L application_id, timestamp'2024-01-02 00:00:00' changed_at, 'SUBMITTED' new_status")
    got = {(r.application_id, r.section, r.detail) for r in enrich.case_file(apps, reviews, none, results, moves).collect()}
    assert got == {(1, "history", "SUBMITTED"), (2, None, None)}


def test_page_size_is_never_cut(spark):
    import pytest
    from stipendia.operators.frames import page, page_after
    rows = spark.range(300)
    for bad in (0, 101):
        with pytest.raises(ValueError):
            page(rows, [rows["id"]], 1, bad)
        with pytest.raises(ValueError):
            page_after(rows, "id", None, bad)


def test_long_words_keep_their_letters(spark):
    from pyspark.sql import functions as F
    from stipendia.functions.names import title_name
    row = spark.range(1).select(F.length(title_name(F.lit("a" * 1500))).alias("n")).first()
    assert row.n == 1500


def test_school_of_the_second_label(spark):
    from stipendia.operators.fields import with_school
    texts = ["SCHOOL: GHS\nROLL NO 12\nNAME OF THE SCHOOL : KENDRIYA SALEM WEST", "NAME OF THE SCHOOL : KENDRIYA SALEM WEST\nROLL NO 9\nSCHOOL: MODEL SCHOOL ERODE", "no label"]
    rows = with_school(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")).orderBy("id").collect()
    assert [r.school for r in rows] == ["KENDRIYA SALEM WEST", "KENDRIYA SALEM WEST", None]
