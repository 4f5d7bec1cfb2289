"""Streams over the append-only status and request logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stipendia.functions.scalars import is_true
from stipendia.operators.frames import count_if
from stipendia.sources import sinks

HOUR_MS = 3_600_000


def marked(events: DataFrame, at: str, delay: str | None) -> DataFrame:
    """Set the watermark; ``None`` keeps the one an earlier step of the stream has set."""
    return events if delay is None else events.withWatermark(at, delay)


def deduplicated(events: DataFrame, id_column: str, at: str, delay: str | None = "1 day") -> DataFrame:
    """Each id once, as long as its copies arrive within the watermark delay."""
    return marked(events, at, delay).dropDuplicatesWithinWatermark([id_column])


def weekly_counts(events: DataFrame, at: str, completed, delay: str | None = "1 day") -> DataFrame:
    """Submissions and completed reviews per 7-day window, emitted when the window closes."""
    return (marked(events, at, delay).groupBy(F.window(at, "7 days").alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), count_if(is_true(completed), "completed"))
            .select(F.col("w.start").alias("week_start"), "events", "completed"))


def quota_exceeded(requests: DataFrame, key: str, at: str, limit: int, minutes: int = 15, delay: str | None = "15 minutes") -> DataFrame:
    """Keys with more than ``limit`` requests in a fixed window."""
    counts = marked(requests, at, delay).groupBy(F.col(key).alias("key"), F.window(at, f"{minutes} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"))
    return counts.where(F.col("requests") > limit).select("key", F.col("w.start").alias("window_start"), "requests")


def first_per_day(events: DataFrame, key: str, at: str) -> DataFrame:
    """Simpler alert rule: suppressed relative to the first event of the watermark window."""
    return events.withWatermark(at, "24 hours").dropDuplicatesWithinWatermark([key])


def alerts(events: DataFrame, key: str, at: str, hours: int = 24, delay: str | None = "24 hours") -> DataFrame:
    """At most one alert per key within ``hours`` of its last alert.

    The state of a key is the time of its last alert.  It is dropped once the
    watermark is ``hours`` past that alert, when it can suppress nothing more.
    An event older than the last alert is suppressed by that alert.
    """
    gap = hours * HOUR_MS

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for batch in batches for t in batch["at_ms"].tolist())
        last = state.get[0] if state.exists else None
        sent = []
        for t in times:
            if last is None or t > last + gap:
                last = t
                sent.append(t)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + gap, state.getCurrentWatermarkMs() + 1))
        if sent:
            yield pd.DataFrame({"key": [keys[0]] * len(sent), "alert_ms": sent})

    rows = marked(events, at, delay).select(F.col(key).cast("string").alias("key"), F.col(at),
                                                  F.unix_millis(F.col(at)).alias("at_ms"))
    out = rows.groupBy("key").applyInPandasWithState(step, "key string, alert_ms long", "last long", "append",
                                                     GroupStateTimeout.EventTimeTimeout)
    return out.select("key", F.timestamp_millis("alert_ms").alias("alert_at"))


def maintain_state(events: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]):
    """Live state per key: each micro-batch writes its newest rows as a delta folder."""
    def write(batch: DataFrame, epoch: int) -> None:
        sinks.write_delta(batch, epoch, path, keys, order)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; output files are exactly-once."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
