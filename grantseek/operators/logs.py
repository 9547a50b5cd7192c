"""Audit-log queries and login lockouts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantseek.common import cut_lineage
from grantseek.functions.text import like_filter, version_key
from grantseek.common import top_k

LOG_STATUSES = ["success", "failed", "denied"]  # fixed values
MAX_FAILURES = 5
LOCK_MINUTES = 15


def recent(logs: DataFrame, now: dt.datetime | Column, days: int = 7) -> DataFrame:
    """Logs of the last days. ``now`` is a parameter, so a report can be repeated."""
    at = F.lit(now) if isinstance(now, dt.datetime) else now
    return logs.where(F.col("created_at") >= at - F.expr(f"INTERVAL {int(days)} DAYS"))


def visible_logs(logs: DataFrame, user_id: int, role: str) -> DataFrame:
    """Admins see everything, others their own rows."""
    return logs if role == "admin" else logs.where(F.col("user_id") == user_id)


def list_logs(
    logs: DataFrame, now, *, user_id: int, role: str, days: int = 7, action: str | None = None,
    status: str | None = None, keyword: str | None = None, of_user: int | None = None,
) -> DataFrame:
    rows = visible_logs(recent(logs, now, days), user_id, role)
    if role == "admin" and of_user:
        rows = rows.where(F.col("user_id") == of_user)
    if action:
        rows = rows.where(F.col("action") == action)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if keyword:
        fields = [c for c in ("resource_name", "username", "path") if c in logs.columns]
        match = F.lit(False)
        for c in fields:
            match = match | F.coalesce(like_filter(F.col(c), keyword), F.lit(False))
        rows = rows.where(match)
    return rows


def newest_logs(rows: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """The next ``limit`` rows, newest first; ``after`` is (created_at, log_id) of the last row of the page before.

    Going on after a key costs the same on every page; Spark keeps ``limit`` rows of each partition.
    """
    if after is not None:
        at, log_id = (v if isinstance(v, Column) else F.lit(v) for v in after)
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("log_id") < log_id)))
    return rows.orderBy(F.desc("created_at"), F.desc("log_id")).limit(limit)


def log_actions(logs: DataFrame) -> DataFrame:
    return logs.select("action").distinct().orderBy("action")


def log_status_counts(logs: DataFrame) -> DataFrame:
    """One row: all logs and those of each status."""
    return logs.agg(F.count(F.lit(1)).alias("total"),
                    *[F.count_if(F.col("status") == s).alias(s) for s in LOG_STATUSES])


def top_actions(logs: DataFrame, n: int = 15) -> DataFrame:
    return logs.groupBy("action").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "action").limit(n)


def top_users(logs: DataFrame, n: int = 15) -> DataFrame:
    named = logs.where("username IS NOT NULL")
    return named.groupBy("username").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "username").limit(n)


def log_daily_stats(logs: DataFrame) -> DataFrame:
    """Logs and mean duration per day and action, with subtotals where a key is null."""
    return logs.withColumn("day", F.to_date("created_at")).rollup("day", "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("sum_ms"), F.max("duration_ms").alias("max_ms"))


def log_latency(logs: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Approximate duration quantiles per action; sketches are merged, no group is collected."""
    q = F.percentile_approx("duration_ms", [0.5, 0.95, 0.99], accuracy)
    return logs.groupBy("action").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).select(
        "action", "n", F.get("q", F.lit(0)).alias("p50_ms"), F.get("q", F.lit(1)).alias("p95_ms"),
        F.get("q", F.lit(2)).alias("p99_ms"))


def active_devices(tokens: DataFrame, now) -> DataFrame:
    """Login tokens neither revoked nor expired, newest first."""
    return tokens.where(~F.col("revoked") & (F.col("expires_at") > now)).orderBy(F.desc("created_at"), F.desc("token_id"))


def update_check(clients: DataFrame, versions: DataFrame, newest: int = 50) -> DataFrame:
    """Per client (client_id, platform, current_version): the update on offer, if any.

    The latest version is the greatest among the ``newest`` published rows of
    the platform.
    """
    latest = latest_version(versions, newest)
    flag = F.lit(False)
    rows = clients.join(latest, "platform", "left")
    target, current = version_key(F.col("latest_version")), version_key(F.col("current_version"))
    has_update = F.col("latest_version").isNotNull() & (target > current)
    below = (F.length("min_supported_version") > 0) & (current < version_key(F.col("min_supported_version")))
    return rows.select(
        "client_id", "platform", "current_version", "latest_version",
        F.coalesce(has_update, flag).alias("has_update"),
        (F.coalesce("mandatory", flag) | F.coalesce(below, flag)).alias("mandatory"))


def latest_version(versions: DataFrame, newest: int = 50) -> DataFrame:
    """Greatest published version per platform; of equal versions the newest row."""
    recent_rows = top_k(versions.where("published"), ["platform"], [F.desc("version_id")], newest, rank="_r")
    best = F.struct(version_key(F.col("version")).alias("v"), "version_id")
    row = F.struct("version", "mandatory", "min_supported_version")
    return recent_rows.groupBy("platform").agg(F.max_by(row, best).alias("b")).select(
        "platform", F.col("b.version").alias("latest_version"), F.col("b.mandatory").alias("mandatory"),
        F.col("b.min_supported_version").alias("min_supported_version"))


# ---------------------------------------------------------------- lockouts

LOCKOUT_SCHEMA = "attempt_id bigint, user_id bigint, tried_at timestamp, ok boolean, outcome string, failures int"
_EXIT_SCHEMA = "part int, first_user bigint, first_us bigint, last_user bigint, failures array<int>, locked_until array<bigint>"


def lock_step(at: int, ok: bool, failures: int, locked_until: int, max_failures: int, lock_us: int):
    """One attempt (times in microseconds): (outcome, failures, locked_until) after it."""
    if locked_until > at:
        return "denied", failures, locked_until
    if ok:
        return "success", 0, 0
    if failures + 1 >= max_failures:
        return "locked", 0, at + lock_us
    return "failed", failures + 1, locked_until


def login_lockouts(attempts: DataFrame, max_failures: int = MAX_FAILURES, minutes: int = LOCK_MINUTES) -> DataFrame:
    """Outcome of every login attempt (attempt_id, user_id, tried_at, ok) and failures counted after it.

    The fifth failure in a row locks the account and resets the counter;
    attempts while locked are denied and do not count; a success resets.

    Attempts are range-partitioned by (user, time), so one user's attempts may
    spread over many tasks. Each task reads its rows with constant memory. A
    first replay tells, for each partition, the state it ends in for *every*
    number of failures it may begin with; the driver chains these, one row for each
    partition, and a second replay gives the outcomes. Only a partition that begins inside a
    lock, whose end no number of failures tells, is read once more by itself.
    """
    ordered = cut_lineage(
        attempts.select("attempt_id", "user_id", F.col("tried_at").cast("timestamp").alias("tried_at"), "ok")
        .withColumn("us", F.unix_micros("tried_at"))
        .repartitionByRange("user_id", "us", "attempt_id").sortWithinPartitions("user_id", "us", "attempt_id"),
        ordered=True)
    lock_us = minutes * 60 * 1_000_000

    def follow(pdf: pd.DataFrame, user, states: list[tuple[int, int]]):
        """Replay rows from all ``states`` of ``user`` at once; they are one state as soon as another user comes."""
        outcomes, counts = [], []
        for who, at, ok in zip(pdf["user_id"], pdf["us"], pdf["ok"]):
            if who != user:
                user, states = who, [(0, 0)]
            steps = [lock_step(at, ok, failures, until, max_failures, lock_us) for failures, until in states]
            states = [(failures, until) for _, failures, until in steps]
            outcomes.append(steps[0][0])
            counts.append(states[0][0])
        return user, states, outcomes, counts

    def exits(only: int | None = None, entry: tuple[int, int] | None = None):
        """The end of each partition for every number of failures; with ``only``, of one partition for one entry."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, begun = TaskContext.get().partitionId(), None
            if only is not None and part != only:
                return
            user, states = None, []
            for pdf in batches:
                if begun is None and len(pdf):
                    user = pdf["user_id"].iloc[0]
                    begun = (user, pdf["us"].iloc[0])
                    states = [entry] if entry else [(n, 0) for n in range(max(1, max_failures))]
                user, states, *_ = follow(pdf, user, states)
            if begun:
                yield pd.DataFrame({"part": [part], "first_user": [begun[0]], "first_us": [begun[1]], "last_user": [user],
                                    "failures": [[f for f, _ in states]], "locked_until": [[u for _, u in states]]})
        return ordered.mapInPandas(run, _EXIT_SCHEMA).orderBy("part").collect()

    entry: dict[int, tuple[int, int, int]] = {}
    user, state = None, (0, 0)
    for end in exits():
        if user == end["first_user"] and state != (0, 0):
            entry[end["part"]] = (user, *state)
            if state[1] > end["first_us"]:  # it begins inside a lock
                end = exits(end["part"], state)[0]
        else:
            state = (0, 0)
        at = state[0] if len(end["failures"]) > 1 else 0
        user, state = end["last_user"], (end["failures"][at], end["locked_until"][at])

    def outcomes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, *state = entry.get(TaskContext.get().partitionId(), (None, 0, 0))
        states = [tuple(state)]
        for pdf in batches:
            user, states, outcomes, counts = follow(pdf, user, states)
            yield pdf[["attempt_id", "user_id", "tried_at", "ok"]].assign(outcome=outcomes, failures=np.array(counts, dtype=np.int32))
    return ordered.mapInPandas(outcomes_of, LOCKOUT_SCHEMA)
