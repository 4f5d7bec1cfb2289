"""Streams over files with late and repeated rows, against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stipendia.streaming import logs

SCHEMA = "id int, key string, at timestamp"
START = dt.datetime(2024, 1, 1)


def write_batches(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i}")


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def run(spark, stream, tmp_path):
    logs.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def sample(n=400):
    rnd = random.Random(11)
    rows = [(i, f"k{rnd.randrange(6)}", START + dt.timedelta(minutes=37 * i + rnd.randrange(-20, 20))) for i in range(n)]
    cuts = [rows[i:i + 100] for i in range(0, n, 100)]
    for a, b in zip(cuts, cuts[1:]):
        b.extend(a[:5])
    return cuts


def test_alert_suppression(spark, tmp_path):
    batches = sample()
    write_batches(spark, str(tmp_path / "in"), batches)
    got = {(r.key, r.alert_at) for r in run(spark, logs.alerts(read(spark, str(tmp_path / "in")), "key", "at", 24, "10 days"), tmp_path)}
    last, want = {}, set()
    for batch in batches:
        for _, key, at in sorted(batch, key=lambda r: (r[1], r[2])):
            if key not in last or at > last[key] + dt.timedelta(hours=24):
                last[key] = at
                want.add((key, at))
    assert got == want and all(
        b - a > dt.timedelta(hours=24) for k in {k for k, _ in got} for s in [sorted(t for q, t in got if q == k)] for a, b in zip(s, s[1:]))


def test_repeated_ids_are_dropped(spark, tmp_path):
    batches = sample()
    write_batches(spark, str(tmp_path / "in"), batches)
    rows = run(spark, logs.deduplicated(read(spark, str(tmp_path / "in")), "id", "at", "10 days"), tmp_path)
    assert sorted(r.id for r in rows) == list(range(400))


def test_weekly_windows_close(spark, tmp_path):
    write_batches(spark, str(tmp_path / "in"), [sum(sample(), [])])
    unique = logs.deduplicated(read(spark, str(tmp_path / "in")), "id", "at", "1 hour")
    rows = run(spark, logs.weekly_counts(unique, "at", F.col("key") == "k1", None), tmp_path)
    assert rows and all((r.week_start - dt.datetime(1970, 1, 1)).days % 7 == 0 for r in rows)


def test_first_per_day(spark, tmp_path):
    write_batches(spark, str(tmp_path / "in"), [[(1, "a", START), (2, "a", START + dt.timedelta(hours=2)), (3, "b", START)]])
    rows = run(spark, logs.first_per_day(read(spark, str(tmp_path / "in")), "key", "at"), tmp_path)
    assert sorted(r.key for r in rows) == ["a", "b"]
