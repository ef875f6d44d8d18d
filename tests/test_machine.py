"""The session machine: its steps by hand, and the stream with restarts and a timer that fires without another check."""

from __future__ import annotations

import datetime

from tidewright.sources import store
from tidewright.streaming import machine


def walk(checks, stable=2, grace=1500, watchdog=3600):
    s, told = machine.Session(None, stable, grace, watchdog), []
    for at, live, length in checks:
        told += [t for t in (s.expire(at), s.check(at, live, length)) if t]
    return told, s.now


def test_steps():
    assert walk([(0, False, 5)]) == ([], None)  # nothing is known of a stream that was never live
    assert walk([(0, True, 0), (60, True, 50), (120, False, 60), (180, False, 60), (240, False, 60)])[0] == [(0, 240, 60, "stable")]  # growth resets
    assert walk([(0, True, 9), (60, False, 9), (120, False, 9), (180, False, 9)])[0] == [(0, 120, 9, "stable")]  # told once
    assert walk([(0, True, 9), (2000, False, 9)], stable=9)[0] == [(0, 2000, 9, "grace")]
    assert walk([(0, True, 9), (60, False, 9), (9000, False, 9)], stable=9, grace=10**6) == ([(0, 3660, 9, "watchdog")], None)
    told, now = walk([(0, True, 9), (60, False, 9), (9000, True, 1)], stable=9, grace=10**6)
    assert told == [(0, 3660, 9, "watchdog")] and now[:3] == ("RECORDING", 9000, 1)  # a new session
    assert walk([(0, True, 9), (60, False, 9), (61, True, 9)])[1][0] == "RECORDING"


def test_stream_restarts_and_timers(spark):
    stamp = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.timezone.utc)
    kind = "stream long, ts timestamp, live boolean, length long"
    limits = {"stable": 2, "grace": 1500, "watchdog": 3600}
    source, out, mark = (store.folder(spark, n) for n in "abc")

    def come(*checks):
        spark.createDataFrame([(s, stamp(t), live, n) for s, t, live, n in checks], kind).coalesce(1).write.mode("append").parquet(source)
        machine.run(spark, source, kind, out, mark, "10 seconds", **limits)
        return sorted((r.stream, r.at - 1_700_000_000, r.reason) for r in spark.read.schema(machine.READY).parquet(out).collect())

    assert come((1, 0, True, 5), (2, 0, True, 5), (1, 60, False, 5)) == []
    assert come((2, 100, False, 5), (1, 120, False, 5)) == [(1, 120, "stable")]
    machine.run(spark, source, kind, out, mark, "10 seconds", **limits)  # nothing new: nothing told again
    # stream 2 gets no further check: only time passes, by another stream's checks
    assert come((3, 9000, True, 0)) == [(1, 120, "stable"), (2, 3700, "watchdog")]
    assert come((2, 9100, False, 5), (2, 9101, False, 5)) == [(1, 120, "stable"), (2, 3700, "watchdog")]
    assert come((2, 9200, True, 1), (2, 9260, False, 1), (2, 9320, False, 1)) == [(1, 120, "stable"), (2, 3700, "watchdog"), (2, 9320, "stable")]


def test_replay_of_nothing(spark):
    assert machine.replay(spark.createDataFrame([], "stream long, ts timestamp, live boolean, length long"), "1 hour").count() == 0
