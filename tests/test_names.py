from pyspark.sql import functions as F

from stipendia.functions import names, text, values


def statuses(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, strict boolean")
    got = names.with_name_match(df, "a", "b", F.col("strict")).collect()
    return {(r.a, r.b, r.strict): (r.name_status, round(r.name_score, 2)) for r in got}


def test_ladder(spark):
    cases = {
        ("Arun K.", "Arun K", True): ("EXACT_MATCH", 1.0), ("K. Arun", "K Arun", True): ("EXACT_MATCH", 1.0),
        ("Thiru SAMPLE STUDENT", "SAMPLE STUDENT", True): ("EXACT_MATCH", 1.0),
        ("Raj Arun Kumar", "Arun Kumar Raj", True): ("EXACT_MATCH", 0.98),
        ("DEMO CANDIDATE", "DEMO CANDIDATE K", False): ("EXACT_MATCH", 0.95),
        ("DEMO CANDIDATE", "DEMO CANDIDATE K", True): ("LIKELY_MATCH", 0.92),
        ("Balasubramaniam S", "Balasubramaniam Sivasankaranarayanan", False): ("LIKELY_MATCH", 0.9),
        ("NITHISH KUMAR", "NITHISH KUMAR RAJA", False): ("NEEDS_REVIEW", 0.65),
        ("DEMO CANDIDATE", "DEMO CANDDATE", False): ("LIKELY_MATCH", 0.93),
        ("DEMO CANDIDATE", "DEMO CANDDATE", True): ("MINOR_DIFFERENCE", 0.9),
        ("SAMPLE STUDENT", "TEST APPLICANT", True): ("MISMATCH", 0.14), ("", "SAMPLE STUDENT", True): ("MISSING", 0.0),
    }
    assert statuses(spark, list(cases)) == cases


def test_each_token_is_used_once(spark):
    got = statuses(spark, [("K K Raja", "K Raja Kumar", False), ("A Arun", "Arun Arun", False)])
    assert got[("A Arun", "Arun Arun", False)][0] == "LIKELY_MATCH"
    assert got[("K K Raja", "K Raja Kumar", False)][0] == "LIKELY_MATCH"


def test_values(spark):
    rows = [("₹2,50,000", 250000), ("Rs. 250000/-", 250000), ("R. 180000", 180000), ("Rs 75,000.00", 75000), ("1.80.000", 180000),
            ("-5000", None), ("abc", None), ("2O0O00", 200000)]
    df = spark.createDataFrame(rows, "raw string, want long")
    assert [r for r in df.select("raw", "want", values.parse_income(F.col("raw")).alias("got")).collect() if r.got != r.want] == []
    dates = [("15/08/2004", "2004-08-15"), ("15-08-2004", "2004-08-15"), ("31-02-2004", None), ("2004.5.7", "2004-05-07"),
             ("01-01-1800", None)]
    df = spark.createDataFrame(dates, "raw string, want string")
    assert [r for r in df.select("raw", "want", values.iso_date(F.col("raw")).alias("got")).collect() if r.got != r.want] == []
    assert spark.range(1).select(values.income_display(F.lit("Rs 12500000")).alias("x")).first().x == "₹1,25,00,000"


def test_candidates(spark):
    rows = [("ARUN KUMAR", None, "HIGH_CONFIDENCE", 90), ("ARUN KUMAR", 60, "NEEDS_REVIEW", 60), ("N1THISH KUMAR", None, "NEEDS_REVIEW", 68),
            ("ARUN K SINGH", None, "NEEDS_REVIEW", 65), ("ARUN COPY", None, "NEEDS_REVIEW", 65), ("HEADMASTER OFFICE BOARD", None, None, None),
            ("TOTAL MARKS", None, "NOT_DETECTED", 35), ("", None, "NOT_DETECTED", 0), ("XZRTQ", None, "NOT_DETECTED", 35)]
    df = spark.createDataFrame(rows, "raw string, conf int, status string, confidence int")
    got = df.select("raw", "status", "confidence", names.resolve_candidate(F.col("raw"), F.col("conf")).alias("r")).collect()
    assert [r for r in got if r.status and (r.r.status, r.r.confidence) != (r.status, r.confidence)] == []


def test_word_distance(spark):
    df = spark.createDataFrame([("a b c d", "a x c", 2), ("", "a b", 2), ("same words here", "same words here", 0)], "a string, b string, d int")
    got = df.select("d", text.word_distance(text.split_words(F.col("a")), text.split_words(F.col("b"))).alias("x")).collect()
    assert [r for r in got if r.x != r.d] == []
    words = " ".join(f"w{i}" for i in range(2000))
    one = spark.createDataFrame([(words, words.replace("w7 ", "v7 "))], "a string, b string")
    assert one.select(text.word_distance(text.split_words(F.col("a")), text.split_words(F.col("b"))).alias("x")).first().x == 1


def test_masking(spark):
    row = spark.range(1).select(text.mask_identity(F.lit("1234 5678 9012")).alias("i"), text.mask_account(F.lit("123456789")).alias("a"),
                                text.mask_identities_in_text(F.lit("id 1234 5678 9012, x123456789012")).alias("t")).first()
    assert (row.i, row.a, row.t) == ("XXXX-XXXX-9012", "XXXXX6789", "id XXXX-XXXX-9012, x123456789012")


def test_institutions(spark):
    rows = [("Govt. Hr Sec School, Salem", "GOVERNMENT HIGHER SECONDARY SCHOOL SALEM", "MATCH"), ("", "x", "MISSING"),
            ("ABC College", "XYZ Academy", "DIFFERENT")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    got = df.select("a", "want", names.institution_match(F.col("a"), F.col("b"))["status"].alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []
