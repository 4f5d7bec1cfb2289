import random
import statistics

from pyspark.sql import Window as W, functions as F

from stipendia.operators import consistency, frames, lifecycle


def events(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(30)}", rnd.randrange(200), i) for i in range(3000)]
    return spark.createDataFrame(rows, "key string, at int, id int")


def shapes(spark):
    """Many keys with a hot one, one key with all rows, null keys and null order, times, no rows."""
    rows = events(spark)
    times = rows.select(F.when(F.col("key") != "k1", F.col("key")).alias("key"), F.when(F.col("at") > 5, F.timestamp_seconds(F.col("at") * 50_000)).alias("at"), "id")
    return [rows, rows.withColumn("key", F.lit("one")).withColumn("at", F.col("at") * 700), times, rows.limit(0)]


def test_numbered_equals_window(spark):
    for df in shapes(spark):
        order = [F.col("at"), F.col("id")]
        plain = df.withColumn("seq", F.row_number().over(W.partitionBy("key").orderBy(*order)))
        assert sorted(map(str, frames.numbered(df, ["key"], order).collect())) == sorted(map(str, plain.collect()))


def test_neighbours_equal_window(spark):
    for df in shapes(spark):
        order, w = [F.col("at"), F.col("id")], W.partitionBy("key").orderBy("at", "id")
        plain = df.select("*", F.lag("id").over(w).alias("before"), F.lead("at").over(w).alias("after"))
        got = frames.with_neighbours(df, ["key"], order, {"id": "before"}, {"at": "after"}).collect()
        assert sorted(map(str, got)) == sorted(map(str, plain.collect()))
        assert frames.with_neighbours(df, ["key"], order, {}, {"id": "next"}).count() == len(got)


def test_pages_equal_sorted_rows(spark):
    rnd = random.Random(9)
    values = [None] * 3 + [rnd.choice([7, rnd.randrange(10**9), -rnd.randrange(50)]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v long")
    for sign in (1, -1):
        first = (lambda v: (v is not None, sign * (v or 0)))
        ranked = sorted(range(len(values)), key=lambda i: (*first(values[i]), i))
        order = [F.col("v").asc() if sign == 1 else F.col("v").desc_nulls_first(), F.col("id")]
        for number in (1, 2, 36, 70, 71, 72):
            got = frames.page(df, order, number, 10, key=sign * F.col("v")).collect()
            assert [r.id for r in got] == ranked[10 * (number - 1):10 * number] and all((r.total, r.pages) == (703, 71) for r in got)
    assert frames.page(df.limit(0), [F.col("id")], 1, 10, key=F.col("v")).count() == 0
    assert frames.page(df, [F.col("id")], 1, 500, key=F.col("id"), most=500).count() == 500


def test_exact_median(spark):
    df = events(spark)
    got = {r.key: r.median for r in frames.exact_median(df, ["key"], "at", 7).collect()}
    by_key = {}
    for r in df.collect():
        by_key.setdefault(r.key, []).append(r.at)
    assert got == {k: float(statistics.median(v)) for k, v in by_key.items()}


def test_rule_table_beyond_the_bound(spark, monkeypatch):
    rows, rules = spark.range(40).toDF("a"), spark.range(25).select(F.col("id").alias("b"))
    small = {(r.a, r.rule.b) for r in frames.with_each_rule(rows, rules).collect()}
    monkeypatch.setattr(frames, "RULE_CHUNK", 5)
    large = [(r.a, r.rule.b) for r in frames.with_each_rule(rows, rules).collect()]
    assert len(large) == len(small) == 1000 and set(large) == small


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, ver int")
    new = spark.createDataFrame([(1, "c", 2), (2, "x", 4), (3, "d", 1)], "id int, v string, ver int")
    assert {(r.id, r.v) for r in frames.upsert(old, new, ["id"], "ver").collect()} == {(1, "c"), (2, "b"), (3, "d")}


def test_null_keys_are_counted(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "k string")
    assert sorted(r.key_count for r in frames.with_key_count(df, ["k"]).collect()) == [1, 2, 2]


def test_case_status_equals_all_pairs(spark):
    """The anchor rule finds the same verdict as comparing every pair."""
    from stipendia.functions.names import with_name_match
    rnd = random.Random(5)
    pool = ["ARUN KUMAR", "ARUN KUMAR K", "ARUN KUMR", "KUMAR ARUN", "ARUN KUMAR RAJA", "MEENA DEVI", "ARUNA KUMAR"]
    rows = [(c, f"d{i}", rnd.choice(pool), None, None) for c in range(60) for i in range(rnd.randrange(1, 6))]
    docs = spark.createDataFrame(rows, "case_id int, doc_type string, name string, dob string, parent_name string")
    got = {r.case_id: r.status for r in consistency.evaluate_cases(docs).collect()}
    d = docs.select("case_id", F.monotonically_increasing_id().alias("i"), "name").cache()
    pairs = d.alias("a").join(d.alias("b"), F.expr("a.case_id = b.case_id AND a.i < b.i")).select(
        F.col("a.case_id").alias("case_id"), F.col("a.name").alias("x"), F.col("b.name").alias("y"))
    bad, mild, sizes = set(), set(), {}
    for r in with_name_match(pairs, "x", "y", False).collect():
        if r.name_status == "MISMATCH":
            bad.add(r.case_id)
        elif r.name_status != "EXACT_MATCH":
            mild.add(r.case_id)
    for c, *_ in rows:
        sizes[c] = sizes.get(c, 0) + 1
    want = {c: "INSUFFICIENT DATA" if n < 2 else "SIGNIFICANT CONFLICT" if c in bad else "MINOR DIFFERENCE" if c in mild
            else "CONSISTENT" for c, n in sizes.items()}
    assert got == want


def test_document_versions(spark):
    df = spark.createDataFrame([(1, "income", 10, 1), (1, "income", 11, 2), (1, "ms10", 12, 1)],
                               "application_id int, document_type string, verification_id int, processed_at int")
    got = {r.verification_id: (r.version, r.is_current) for r in lifecycle.document_versions(df).collect()}
    assert got == {10: (1, False), 11: (2, True), 12: (1, True)}


def test_stored_previous_status(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'a', NULL, 'DRAFT', timestamp_ntz'2024-01-01'), (2, 'a', 'DRAFT', 'SUBMITTED', timestamp_ntz'2024-01-02'),
        (3, 'a', 'DRAFT', 'PAID', timestamp_ntz'2024-01-03') AS t(history_id, application_id, previous_status, new_status, changed_at)""")
    assert [r.history_id for r in lifecycle.stored_previous_disagrees(df).collect()] == [3]
