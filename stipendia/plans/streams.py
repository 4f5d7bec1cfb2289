"""Streaming queries over the events log, run until the log is consumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipendia.functions.scalars import utc_clock, utc_instant
from stipendia.plans.registry import query
from stipendia.session import work_folder
from stipendia.sources import readers, sinks
from stipendia.streaming import logs


def events(t):
    raw = readers.stream(t.spark, t.sf_dir, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
                         "events.parquet")
    return raw.withColumn("ts", utc_instant(F.col("ts")))


def finished(t, stream):
    folder = work_folder(t.spark)
    logs.run_to_files(stream, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_weekly_counts", "STR-02", """
WITH w AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS s, event_type FROM events)
SELECT CAST(s AS VARCHAR) AS week_start, count(*) AS events, count_if(event_type = 'purchase') AS completed FROM w
WHERE s + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1""")
def _(t):
    rows = finished(t, logs.weekly_counts(events(t), "ts", F.col("event_type") == "purchase"))
    return rows.withColumn("week_start", F.date_format(utc_clock(F.col("week_start")), "yyyy-MM-dd HH:mm:ss"))


@query("stream_quota", "STR-04", """
WITH c AS (SELECT user_id AS "key", time_bucket(INTERVAL 15 MINUTE, ts) AS s, count(*) AS n FROM events GROUP BY 1, 2)
SELECT "key", CAST(s AS VARCHAR) AS window_start, n AS requests FROM c WHERE n > 1
 AND s + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE""")
def _(t):
    rows = finished(t, logs.quota_exceeded(events(t), "user_id", "ts", 1))
    return rows.withColumn("window_start", F.date_format(utc_clock(F.col("window_start")), "yyyy-MM-dd HH:mm:ss"))


@query("stream_unique_events", "STR-05", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    twice = events(t).union(events(t))  # a log that delivers each event two times
    return finished(t, logs.deduplicated(twice, "event_id", "ts", "40 days")).select("event_id", "user_id", "event_type")


@query("stream_alerts", "STR-01", """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'error'),
a AS (SELECT user_id, min(ms) AS ms FROM e GROUP BY 1
 UNION ALL SELECT user_id, nxt FROM (SELECT a.user_id, (SELECT min(e.ms) FROM e WHERE e.user_id = a.user_id AND e.ms > a.ms + 86400000) AS nxt FROM a)
 WHERE nxt IS NOT NULL)
SELECT CAST(user_id AS VARCHAR) AS "key", ms AS alert_ms FROM a""")
def _(t):
    late = events(t).where(F.col("event_type") == "error")
    return finished(t, logs.alerts(late, "user_id", "ts")).select("key", F.unix_millis("alert_at").alias("alert_ms"))


@query("stream_current_state", "STR-03 SNK-04", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def _(t):
    folder = work_folder(t.spark)
    run = logs.maintain_state(events(t), f"{folder}/state", f"{folder}/checkpoint", ["user_id"], ["ts", "event_id"])
    run.awaitTermination()
    return sinks.read_state(t.spark, f"{folder}/state", ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
