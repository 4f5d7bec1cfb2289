import json

import pytest

from pyspark.sql import functions as F

from stipendia.operators import documents
from stipendia.sources import commits, readers, sinks


def test_roster_headers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Reg No,STUDENT NAME ,Email,Income,Branch\n R1 , Arun ,a@x.y,\"Rs 1,20,000\",\nR2,Mala,,,\n")
    rows = {r.register_number: r for r in readers.roster(spark, str(tmp_path / "r.csv"), "C1").collect()}
    assert (rows["R1"].full_name, rows["R1"].family_income, rows["R1"].department) == ("Arun", 120000.0, "Computer Science")
    assert (rows["R2"].family_income, rows["R2"].course, rows["R2"].college_id) == (200000.0, "B.E. / B.Tech", "C1")


def test_labelled_documents_keep_the_newer_generation(spark, tmp_path):
    base = {"id": "d1", "cohort_id": "c", "document_type": "10th_marksheet", "ground_truth": {"studentName": "A"}}
    newer = {**base, "ground_truth": {"studentName": "A", "marks": "455/500"}}
    for i, doc in enumerate([base, newer, {**base, "id": "d2"}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=1))
    rows = {r.id: r.ground_truth.marks for r in readers.labelled_documents(spark, str(tmp_path)).collect()}
    assert rows == {"d1": "455/500", "d2": None}


def test_file_fingerprints(spark, tmp_path):
    for name, content in [("a.bin", b"one"), ("b.bin", b"one"), ("c.bin", b"two")]:
        (tmp_path / name).write_bytes(content)
    copies = documents.fingerprints(readers.files(spark, str(tmp_path), "*.bin")).collect()
    assert sorted(r.copies for r in copies) == [1, 2, 2] and "content" not in copies[0].asDict()


@pytest.mark.parametrize("store", ["file", "viewfs"])
def test_texts_are_files_in_few_folders(spark, tmp_path, monkeypatch, store):
    """one file a row, read once, in folders of many; also in a store that only Spark reaches."""
    monkeypatch.setattr(sinks, "FOLDER_FILES", 3)
    monkeypatch.setattr(readers, "BATCH_FILES", 5)
    root = f"file://{tmp_path}"
    if store == "viewfs":
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.texts.link./in", root)
        root = "viewfs://texts/in"
    rows = [(n, f"text {i}\n é") for i, n in enumerate(["7", "7", "-7", "", "a-1", *map(str, range(20))])] + [("e", "")]
    folders = sinks.write_texts(spark.createDataFrame(rows, "name string, text string").coalesce(2), f"{root}/out", "name", "text")
    assert 2 <= len(folders) < len(rows)
    (tmp_path / "out" / "lost").mkdir()
    (tmp_path / "out" / "lost" / "name=7-0.txt").write_text("left by a lost attempt")
    batches = list(readers.file_batches(spark, folders))
    got = [(r.name, bytes(r.content), r.length) for b in batches for r in b.withColumn("name", sinks.file_name(F.col("path"))).collect()]
    assert sorted(got) == sorted((n, x := (t + "\n").encode(), len(x)) for n, t in rows)
    assert len(batches) > 1 and all(b.rdd.getNumPartitions() <= 5 for b in batches)
    none = spark.createDataFrame([], "name string, text string")
    assert list(readers.file_batches(spark, sinks.write_texts(none, f"{root}/none", "name", "text"))) == []


def test_sheets(spark, tmp_path):
    df = spark.createDataFrame([("a1", "", None)], "application_id string, full_name string, scheme_id string")
    for layout, width in ((sinks.COLLEGE_SHEET, 26), (sinks.APPLICATION_SHEET, 27), (sinks.PAYMENT_SHEET, 15), (sinks.DEFICIENCY_SHEET, 13), (sinks.HISTORY_SHEET, 10)):
        out = sinks.sheet(df, layout)
        assert len(out.columns) == width and out.first()[layout[1][0]] in ("—", "a1")
    sinks.write_json_lines(df, str(tmp_path / "rows"))
    assert readers.manifest(spark, str(tmp_path / "rows"), df.schema).count() == 1


def test_state(spark, tmp_path):
    state = str(tmp_path / "state")
    for epoch, (value, at) in enumerate([("old", 1), ("new", 2)]):
        batch = spark.createDataFrame([(1, value, at)], "id int, v string, at int")
        sinks.write_delta(batch, epoch, state, ["id"], ["at"])
        sinks.write_delta(batch, epoch, state, ["id"], ["at"])
    assert [r.v for r in sinks.read_state(spark, state, ["id"], ["at"]).collect()] == ["new"]
    sinks.compact(spark, state, str(tmp_path / "folded"), ["id"], ["at"])
    assert spark.read.parquet(str(tmp_path / "folded")).count() == 1


def test_entity_schema(spark, tmp_path):
    spark.createDataFrame([("h1", "a")], "history_id string, application_id string").write.parquet(str(tmp_path / "h"))
    assert readers.entity(spark, str(tmp_path / "h"), "history").first().history_id == "h1"


def test_bundles_are_published_whole_and_once(spark, tmp_path):
    folder, one = str(tmp_path / "out"), spark.createDataFrame([("a1", 1)], "id string, n int")
    assert commits.published(spark, folder) == {}

    def broken(batches):
        raise RuntimeError("lost")
        yield from batches

    with pytest.raises(Exception, match="lost"):
        commits.publish({"one": one, "two": one.mapInArrow(broken, "id string")}, folder, 1)
    assert commits.published(spark, folder) == {}  # the first dataset is on disk, but no note names it
    assert commits.publish({"one": one, "two": one.limit(0)}, folder, 1)
    assert not commits.publish({"one": one.union(one)}, folder, 1)
    assert commits.publish({"one": one.union(one)}, folder, 2, "parquet")
    assert {k: v.count() for k, v in commits.published(spark, folder).items()} == {"one": 2}
    assert {k: v.count() for k, v in commits.published(spark, folder, 1).items()} == {"one": 1, "two": 0}
    csv = str(tmp_path / "csv")
    commits.publish({"one": one}, csv, 7, "csv")
    assert commits.published(spark, csv, fmt="csv")["one"].first().id == "a1"


def test_batches_are_appended_once(spark, tmp_path):
    folder, rows = str(tmp_path / "log"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert commits.log(spark, folder, rows.schema).count() == 0
    for writer, n, sent in (("x", 1, True), ("x", 1, False), ("x", 2, True), ("y", 1, True), ("x", 2, False)):
        assert commits.append_once(rows, folder, writer, n) == sent
    rows.write.parquet(f"{folder}/log/writer=y/sequence=2")  # a batch that was lost before its note
    got = sorted((r.writer, r.sequence, r.id) for r in commits.log(spark, folder, rows.schema).collect())
    assert got == sorted((w, n, i) for w, n in (("x", 1), ("x", 2), ("y", 1)) for i in (1, 2))


def test_tolerant_readers(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text('Reg No,STUDENT NAME ,Email,Branch\n R1 , Arun ,a@x.y,ECE\nR2,Mala\nR3,"Devi, M",d@x.y,,\n,,none,\n')
    (tmp_path / "r" / "b.csv").write_text('Reg No,STUDENT NAME ,Email,Branch\nR4,Ravi,r@x.y,\n')
    good, bad = readers.tolerant_roster(spark, str(tmp_path / "r"), 5)
    assert sorted((r.register_number, r.full_name, r.department, r.college_id) for r in good.collect()) == [("R1", "Arun", "ECE", 5), ("R4", "Ravi", "Computer Science", 5)]
    assert sorted((r._line or "", *r.reasons) for r in bad.collect()) == [
        ("", "Missing Register Number", "Missing Student Name", "Missing or invalid Email"),
        ('R2,Mala', "wrong number of columns"), ('R3,"Devi, M",d@x.y,,', "wrong number of columns")]
    assert (good.count(), bad.count(), good.select("email").distinct().count()) == (2, 3, 2)
    (tmp_path / "m.jsonl").write_text('{"id": "1", "n": 2, "x": 0}\n{"id": "2", "n": "no"}\n{"n": 3}\n[1]\n{"id": \n\n')
    good, bad = readers.tolerant_manifest(spark, str(tmp_path / "m.jsonl"), "id string, n int", "id")
    assert [tuple(r) for r in good.collect()] == [("1", 2)]
    assert sorted((r.value, r.reason) for r in bad.collect()) == [
        ('[1]', "not readable"), ('{"id": ', "not readable"), ('{"id": "2", "n": "no"}', "not readable"), ('{"n": 3}', "no id")]
