"""Audit-log streams. Every function takes a streaming or a batch DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.operators.logs import LOCK_MINUTES, LOCKOUT_SCHEMA, LOG_STATUSES, MAX_FAILURES, lock_step


def _event_time(logs: DataFrame, watermark: str) -> DataFrame:
    return logs.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)


def log_stream_stats(
    logs: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes",
) -> DataFrame:
    """Logs per window, action and status count; a slide makes the windows overlap."""
    span = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    counted = _event_time(logs, watermark).groupBy(span.alias("w"), "action").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in LOG_STATUSES])
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "action",
                          "total", *LOG_STATUSES)


def user_activity_sessions(logs: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Bursts of activity per user: start, end of the last event, number of events."""
    rows = _event_time(logs, watermark)
    burst = rows.groupBy("user_id", F.session_window("created_at", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))
    return burst.select("user_id", F.col("w.start").alias("first_at"), "last_at", "n")


def drop_replayed_logs(logs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each log_id once, however often a source sends it."""
    rows = _event_time(logs, watermark)
    return rows.dropDuplicatesWithinWatermark(["log_id"]) if logs.isStreaming else rows.dropDuplicates(["log_id"])


def lockout_stream(
    attempts: DataFrame, max_failures: int = MAX_FAILURES, minutes: int = LOCK_MINUTES, watermark: str = "1 hour",
) -> DataFrame:
    """Login lockouts as attempts arrive (attempt_id, user_id, tried_at, ok).

    State per user: failures so far and the end of the lock, two numbers. A
    user's attempts are taken in time order within a micro-batch; state that has
    no failure left is dropped once the watermark passes.
    """
    lock_us = minutes * 60 * 1_000_000

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, until = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            if failures == 0:
                state.remove()
            return
        # One user's rows of one micro-batch; the source's rate limit bounds them.
        rows = pd.concat(list(frames)).sort_values(["us", "attempt_id"])
        outcomes, counts = [], []
        for at, ok in zip(rows["us"], rows["ok"]):
            outcome, failures, until = lock_step(at, ok, failures, until, max_failures, lock_us)
            outcomes.append(outcome)
            counts.append(failures)
        state.update((int(failures), int(until)))
        state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows[["attempt_id", "user_id", "tried_at", "ok"]].assign(
            outcome=outcomes, failures=np.array(counts, dtype=np.int32))

    rows = attempts.withColumn("tried_at", F.col("tried_at").cast("timestamp")).withWatermark(
        "tried_at", watermark).withColumn("us", F.unix_micros("tried_at"))
    return rows.groupBy("user_id").applyInPandasWithState(
        step, LOCKOUT_SCHEMA, "failures int, locked_until bigint", "append", "EventTimeTimeout")
