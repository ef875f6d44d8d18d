"""The recording state machine of a stream, on event-time timers.

Checks of a stream (live or not, and the length of its recording so far) move
its session: RECORDING while it is live; FINALIZING from the first check after
that; back to RECORDING if the recording still grows; READY when its length was
the same in ``stable`` checks, when ``grace`` seconds have passed since it was
last live, or when ``watchdog`` seconds have passed since FINALIZING began.  The
watchdog is a timer: it needs no further check of that stream, and it is told
with its own time, so a row is the same whenever the batch came.  READY is told
once and ends the session; the next live check opens another.

The state and the timers live in the state store, the rows go to a file sink
that knows its batches: a query that stops and starts again on its checkpoint
tells nothing twice and loses nothing.  Checks of a stream that come in one
batch are sorted there; checks older than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources import store

READY = "stream long, began long, at long, length long, reason string"
STATE = StructType([StructField("status", StringType()), *(StructField(n, LongType()) for n in ("began", "length", "stable", "last_live", "since"))])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Session:
    """One stream's session; ``None`` where there is none."""

    def __init__(self, now: tuple | None, stable: int, grace: int, watchdog: int):
        self.now, self.stable, self.grace, self.watchdog = now, stable, grace, watchdog

    def deadline(self) -> int | None:
        """When the watchdog ends the session, if nothing else does."""
        return self.now[5] + self.watchdog if self.now and self.now[0] == "FINALIZING" else None

    def expire(self, at: int) -> tuple | None:
        """What is told if the watchdog's time has come at ``at``; the session ends with it."""
        end = self.deadline()
        if end is None or at < end:
            return None
        told, self.now = (self.now[1], end, self.now[2], "watchdog"), None
        return told

    def check(self, at: int, live: bool, length: int) -> tuple | None:
        """The session after one check; (began, at, length, reason) if it is READY by it."""
        if live:
            if self.now is None:
                self.now = ("RECORDING", at, 0, 0, at, 0)
            _, began, old, stable, _, _ = self.now
            self.now = ("RECORDING", began, max(old, length), 0 if length > old else stable, at, 0)
            return None
        if self.now is None:
            return None
        status, began, old, stable, last, since = self.now
        since = at if status == "RECORDING" else since
        if length > old:
            self.now = ("RECORDING", began, length, 0, last, 0)
            return None
        stable += 1
        reason = "stable" if stable >= self.stable else "grace" if at - last >= self.grace else None
        self.now = None if reason else ("FINALIZING", began, old, stable, last, since)
        return (began, at, old, reason) if reason else None


class Machine(StatefulProcessor):
    def __init__(self, stable: int, grace: int, watchdog: int):
        self.limits = (stable, grace, watchdog)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def _load(self) -> Session:
        return Session(tuple(self.state.get()) if self.state.exists() else None, *self.limits)

    def _save(self, session: Session) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if session.now is None:
            self.state.clear()
            return
        self.state.update(session.now)
        if session.deadline() is not None:
            self.handle.registerTimer(session.deadline() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, told = self._load(), []
        checks = pd.concat(list(rows)).sort_values(["at", "live", "length"])
        for at, live, length in zip(checks["at"].tolist(), checks["live"].tolist(), checks["length"].tolist()):
            told += [session.expire(at), session.check(at, live, length)]
        self._save(session)
        yield _rows(key[0], told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session = self._load()
        told = session.expire(expiredTimerInfo.getExpiryTimeInMs() // 1000)
        if told:
            session.now = None
            self.state.clear()
        yield _rows(key[0], [told])

    def close(self) -> None:
        pass


def _rows(stream: int, told: list) -> pd.DataFrame:
    return pd.DataFrame([(stream, *t) for t in told if t], columns=["stream", "began", "at", "length", "reason"])


def ready(checks: DataFrame, delay: str, stable: int = 2, grace: int = 25 * 60, watchdog: int = 60 * 60) -> DataFrame:
    """(stream, began, at, length, reason) of sessions that became READY, from a stream of (stream, ts, live, length)."""
    timed = checks.withWatermark("ts", delay).withColumn("at", F.unix_timestamp("ts"))
    return timed.groupBy("stream").transformWithStateInPandas(Machine(stable, grace, watchdog), READY, "Append", "EventTime")


def run(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, delay: str, **limits: int) -> None:
    """Read what has come to the folder ``source`` since the last call with this checkpoint, tell what is ready, and stop."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        checks = spark.readStream.schema(schema).parquet(source)
        told = ready(checks, delay, **limits).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        told.start(out).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def replay(checks: DataFrame, delay: str, parts: int = 3, **limits: int) -> DataFrame:
    """READY sessions of a table of checks, as a stream that comes in ``parts`` spans of time with a restart after each."""
    spark = checks.sparkSession
    source, out, checkpoint = (store.folder(spark, n) for n in ("checks", "ready", "machine"))
    checks = checks.select("stream", F.col("ts").cast("timestamp").alias("ts"), "live", F.col("length").cast("long").alias("length"))
    low, high = checks.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    if low is None:
        return spark.createDataFrame([], READY)
    span = (high - low) // parts + 1
    for i in range(parts):
        since = F.unix_timestamp("ts") - low
        checks.where((since >= i * span) & (since < (i + 1) * span)).write.mode("append").parquet(source)
        run(spark, source, "stream long, ts timestamp, live boolean, length long", out, checkpoint, delay, **limits)
    return spark.read.schema(READY).parquet(out)
