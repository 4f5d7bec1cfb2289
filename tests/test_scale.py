"""Work is shared by all cores whatever files hold a table, and no task gathers the rows of a few keys."""

import contextlib
import hashlib
import io

from pyspark.sql import functions as F

from stipendia.functions.scalars import matches, regex
from stipendia.operators import eligibility, frames, lifecycle
from stipendia.operators.retrieval import COURSE_SLOTS, whole_phrase
from stipendia.plans import exchange
from stipendia.plans.certificates import all_texts, cases, certificates
from stipendia.plans.mapping import SCHEMES, Tables
from stipendia.plans.questions import all_questions, asked
from stipendia.plans.workload import REGISTRY


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_scheme_matches_holds_refused_pairs(spark, sf_dir):
    """every student with every scheme, refusals included."""
    rows = REGISTRY["scheme_matches"](spark, sf_dir)
    students = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert rows.count() == students * len(SCHEMES) and rows.where("match_type = 'NOT MATCHED'").count() > 0


def test_pairs_with_rules_have_no_hot_key(spark, sf_dir):
    """F16: rules of unknown size are not met by a key that one task would gather."""
    t = Tables(spark, sf_dir)
    rules = spark.createDataFrame([(i,) for i in range(3)], "b int")
    for df in frames.with_each_rule(spark.range(9), rules), eligibility.match_all(t.profiles, t.schemes):
        plan = plan_of(df)
        assert "SortMergeJoin" not in plan and ("CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan)


def test_details_are_made_where_read(spark, sf_dir):
    """F16: the texts of reasons are not built for outcomes alone."""
    t = Tables(spark, sf_dir)
    assert "is needed for" not in plan_of(REGISTRY["pair_outcomes"](spark, sf_dir))
    assert "is needed for" in plan_of(eligibility.match_all(t.profiles, t.schemes))


def test_stages_are_looked_up_in_the_row(spark):
    """the applications of a stage are not gathered to learn its defaults."""
    apps = spark.createDataFrame([(s,) for s in ("DRAFT", "SUBMITTED", "NO_SUCH", None)], "lifecycle_stage string")
    df = lifecycle.with_stage_defaults(apps)
    assert "Join" not in plan_of(df)
    known = {stage: rest for stage, *rest in lifecycle.STAGE_DEFAULTS}
    for r in df.collect():
        assert [r.stage_label, r.who_must_act, r.next_action] == known.get(r.stage, [None] * 3)


def test_customer_work_is_shared(spark, sf_dir):
    """F2 and the other findings on certificates and questions: a customer file of one row group is not one task."""
    t, cores = Tables(spark, sf_dir), spark.sparkContext.defaultParallelism
    for df in certificates(t, "ms10"), cases(t), asked(t):
        assert df.rdd.getNumPartitions() >= cores
    for df in all_texts(t), all_questions(t):
        assert df.rdd.getNumPartitions() >= 2 * cores


def test_literals_before_patterns(spark):
    """a pattern that is tried only on texts with one of its literals finds what it finds alone."""
    patterns = [p for _, p in COURSE_SLOTS] + [whole_phrase(["first graduate", "b.e"]), r"\btamil\s*nadu\b", r"NAME\s*OF|dob", r"^hi$", r"[0-9]+ lakh"]
    texts = ["", None, "b.e student", "I AM IN B.TECH", "tamilnadu", "TAMIL  NADU", "name of", "Name  OF x", "hi", "hi there", "12 lakh", "12 LAKH",
             "first graduate", "xfirst graduatey", "be", "abe", "class 9", "KK dob", "DOBİ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for flags in "", "i":
        for p in patterns:
            plain = F.coalesce(F.col("t").rlike(regex(p, flags)), F.lit(False))
            assert df.where(matches(F.col("t"), p, flags) != plain).count() == 0
    assert "Contains" in plan_of(df.where(matches(F.col("t"), "(?:dob|age)+", "i")))


def test_file_copies_has_no_folder_a_document(spark, tmp_path, monkeypatch):
    """a file for every document, but folders of many; repeated, negative and missing ids keep their rows."""
    docs = [(i, f"text {i % 50}") for i in range(200)] + [(7, "other"), (-3, "text 1"), (None, "text 2"), (500, None), (501, ""), (502, "two\nlines")]
    schema = "doc_id long, text string"
    spark.createDataFrame(docs, schema).coalesce(4).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    monkeypatch.setattr(exchange, "work_folder", lambda _: str(tmp_path / "work"))
    got = [tuple(r) for r in REGISTRY["file_copies"](spark, str(tmp_path / "in")).collect()]
    print_of = {(d, t): hashlib.sha256(((t or "") + "\n").encode()).hexdigest() for d, t in docs}
    groups = {h: [d for d, t in docs if print_of[d, t] == h] for h in print_of.values()}
    want = [(d, h, len(t or "") + 1, len(groups[h]), min(x for x in groups[h] if x is not None)) for d, t in docs for h in [print_of[d, t]]]
    assert sorted(got, key=str) == sorted(want, key=str)
    texts = list((tmp_path / "work").rglob("*.txt"))
    assert len(texts) == len(docs) and len({p.parent for p in texts}) <= 16
    monkeypatch.setattr(exchange, "work_folder", lambda _: str(tmp_path / "empty"))
    assert REGISTRY["file_copies"](spark, str(tmp_path / "none")).count() == 0


def test_rows_of_applications_meet_names_in_one_join(spark, sf_dir):
    """student and college are joined to the applications, not to the rows of theirs."""
    t = Tables(spark, sf_dir)
    joins = [line for line in plan_of(exchange._named(t, t.payments_raw)).splitlines() if "Join" in line]
    assert "application_id" in joins[0] and "college_id" not in joins[0]
