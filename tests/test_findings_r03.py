"""Rounding as the SQL has it, padding among many windows, and analyses in texts of bounded size."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from tidewright import registry
from tidewright.operators import clips
from tidewright.plans import base, rollup_queries


def padded(s, e, times, smooth):
    near = lambda t: min((abs(x - t), i) for i, x in enumerate(times))[1]
    lo, hi = near(s), near(e)
    peak = max(smooth[lo:lo + max(1, hi + 10 - lo)])
    if peak <= 0:
        return s, e
    left = next((k for k in range(18) if smooth[near(s - 5.0 * k)] <= 0.45 * peak), 18)
    right = next((k for k in range(9) if smooth[near(e + 5.0 * k)] <= 0.35 * peak), 9)
    a, b = max(s - 120.0, min(s - 10.0, s - 5.0 * left)), min(e + 5.0 * right, e + 45.0)
    return a, a + 30 if b - a < 30 else a + 180 if b - a > 180 else b


def test_dynamic_padding_among_many_windows(spark):
    """Each step once looked at every window: 3,000 ranges among 2,000 windows took minutes."""
    r = random.Random(3)
    times = [15.0 * i + r.randrange(10) for i in range(2000)]
    smooth = [r.choice([0.0, 0.1, 0.5, 1.0, 2.0]) if i % 50 else 0.0 for i in range(2000)]
    ranges = [(i, float(s), float(s + r.randrange(0, 150))) for i, s in ((i, r.randrange(-200, 30_200)) for i in range(3000))]
    d = spark.createDataFrame(ranges, "id long, start double, end double").crossJoin(spark.createDataFrame([(times, smooth)], "t array<double>, v array<double>"))
    began = time.monotonic()
    got = {x.id: (x.x.s, x.x.e) for x in d.select("id", clips.dynamic_padding(F.col("start"), F.col("end"), F.col("t"), F.col("v")).alias("x")).collect()}
    assert time.monotonic() - began < 60
    assert got == {i: padded(s, e, times, smooth) for i, s, e in ranges}


def test_six_places_of_halves(spark):
    """DuckDB multiplies by a million and rounds: 0.5022125 is 502212.49999999994 millionths."""
    x = [0.5022125, 0.6287874999999999, -0.6287874999999999, 1e-9, 2.5e-7, None]
    want = [0.502212, 0.628788, -0.628788, 0.0, 0.0, None]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(base.r6("x")).collect()
    assert [r[0] for r in got] == want


def test_analyses_come_in_texts_of_bounded_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rollup_queries.moments, "documents", lambda whole, keys: seen.append(whole) or whole)
    registry.load()[0]["l20_moment_documents"](spark, "/root/testdata/sf0.1")
    longest = seen[0].agg(F.max(F.length("value"))).first()[0]
    assert longest < 200_000  # a session's messages in one text were over 300,000 characters


def test_texts_are_taken_apart_once(spark):
    """A text was put in lower case for each reaction token, and split for each mention of its words."""
    plan = lambda name: registry.load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan("l01_reaction_hits").count("lower(") == 1
    assert plan("i19_jaccard_tokens").count("regexp_replace(") <= 4
