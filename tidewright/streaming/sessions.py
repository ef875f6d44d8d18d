"""Streaming: event-time windows, sessions, last-seen state, a session state machine, and retry queues.

Streams need a TIMESTAMP column; a column without a zone is cast in the
session's zone (UTC) before the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """``df`` with a watermark on ``ts``."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def activity(df: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None) -> DataFrame:
    """Messages per key in tumbling or sliding windows of a watermarked stream or a table."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("messages")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str) -> DataFrame:
    """Sessions that end after ``gap`` without a message."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("messages")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")


def last_seen(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(ts).alias("last_ts"))


STABLE_CHECKS = 2
GRACE_S = 25 * 60
WATCHDOG_S = 60 * 60
STATE = "status string, length long, stable long, finalizing_since long"
READY = "stream string, status string, length long, at long"


def advance(state: tuple, live: bool, length: int, now: int) -> tuple[tuple, bool]:
    """Next state of a stream and whether it has just become READY.

    RECORDING while live; FINALIZING after that, until the length has been the
    same in two checks, the grace period is over, or the watchdog - measured
    from entering FINALIZING - bites.  READY is told once.
    """
    status, old, stable, since = state
    if status == "READY":
        return state, False
    if live:
        return ("RECORDING", max(length, old), 0, 0), False
    if status != "FINALIZING":
        return ("FINALIZING", length, 0, now), False
    stable = stable + 1 if length == old else 0
    done = stable >= STABLE_CHECKS or now - since >= WATCHDOG_S or (now - since >= GRACE_S and length == old)
    return ("READY" if done else "FINALIZING", length, stable, since), done


def finalize(df: DataFrame) -> DataFrame:
    """READY streams from checks of (stream, live, length, at); state is kept per stream with ``applyInPandasWithState``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("PENDING", 0, 0, 0)
        out = []
        for r in pd.concat(list(parts)).sort_values("at").itertuples():
            now, ready = advance(now, bool(r.live), int(r.length), int(r.at))
            if ready:
                out.append((key[0], "READY", int(r.length), int(r.at)))
        state.update(now)
        yield pd.DataFrame(out, columns=["stream", "status", "length", "at"])

    return df.groupBy("stream").applyInPandasWithState(run, READY, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def should_process(status: Column, age_h: Column, item_age_d: Column) -> Column:
    """process / skip / fail of an item by its job status, the job's age in hours and the item's in days."""
    return (F.when(status.isin("completed", "running"), "skip").when(item_age_d > 7, "skip")
            .when((status == "queued") & (age_h < 2), "skip").when((status == "queued") & (age_h > 48), "fail").otherwise("process"))


def missing_items(items: DataFrame, jobs: DataFrame, key: str, age_d: str, recent: int = 20, most: int = 10) -> DataFrame:
    """Of the most recent items those without a job and not older than a week, at most ``most``."""
    last = items.orderBy(age_d, key).limit(recent)
    return last.join(jobs.select(key), key, "left_anti").where(F.col(age_d) <= 7).orderBy(age_d, key).limit(most)


def retry_queue(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Failures folded per key: how often it was retried and what the last failure was."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("retry_count"), F.max_by("reason", order).alias("reason"), F.max(order).alias("failed_at"))


def ready_to_retry(df: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Queue rows whose time has come; rows without a valid time are passed over."""
    return df.where((F.col("retry_count") < most) & (F.try_to_timestamp("retry_after") <= now))


def retain(df: DataFrame, order: str, most: int = 100) -> DataFrame:
    """The last ``most`` rows."""
    return df.orderBy(F.desc(order)).limit(most)
