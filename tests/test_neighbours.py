"""Rows around anchors and chapter threads by hand-worked cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import neighbours


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def windows(spark, *data):
    return spark.createDataFrame(data, "v string, i long, start double, end double, a boolean, b boolean, ch long, topic string, hint boolean")


def w(v, i, length=10.0, a=False, b=False, ch=0, topic="", hint=None):
    return (v, i, i * 100.0, i * 100.0 + length, a, b, ch, topic, hint)


def test_around(spark):
    d = windows(spark, *[w("x", i, a=i in (4, 7)) for i in range(9)], *[w("y", i) for i in range(3)])
    assert rows(neighbours.around(d, ["v"], "i", "a", "left", k=2), "v", "i", "place") == [("x", 2, 2), ("x", 3, 1)]
    assert rows(neighbours.around(d, ["v"], "i", "a", "right", k=9), "i") == [(5,), (6,), (7,), (8,)]
    # 25 seconds are reached by the third row; 15 at most by the second, though 25 are not reached
    assert rows(neighbours.around(d, ["v"], "i", "a", "left", least=F.lit(25.0), most=F.lit(99.0)), "i") == [(1,), (2,), (3,)]
    assert rows(neighbours.around(d, ["v"], "i", "a", "left", least=F.lit(25.0), most=F.lit(15.0)), "i") == [(2,), (3,)]
    assert rows(neighbours.around(d, ["v"], "i", "a", "right", least=F.lit(10.0), most=F.lit(99.0)), "i") == [(5,)]


def test_between_and_boundary(spark):
    d = windows(spark, *[w("x", i, a=i in (1, 2), b=i in (6, 8)) for i in range(9)], w("y", 0, a=True), w("y", 1, b=True), w("z", 0))
    assert rows(neighbours.between(d, ["v"], "i", "a", "b"), "v", "i") == [("x", 3), ("x", 4), ("x", 5)]
    d = windows(spark, *[w("x", i, ch=i // 4) for i in range(6)])
    assert rows(neighbours.boundary(d, ["v"], "ch", "i", 2), "ended", "side", "i") == [(0, "left", 2), (0, "left", 3), (0, "right", 4), (0, "right", 5), (1, "left", 4), (1, "left", 5)]


def test_chapter_threads(spark):
    d = windows(spark, w("x", 0, topic="boss", hint=True), w("x", 1, topic="boss fight"), w("x", 2, topic="menu"), w("x", 3, topic="", hint=True), w("x", 4, topic="menu"),
                w("x", 5, ch=1, topic="menu"), w("x", 6, ch=2, topic="menu", hint=True), w("x", 7, ch=2, topic="boss", hint=False))
    got = neighbours.chapter_threads(d, ["v"], "ch", "i", "topic", "hint")
    # the first row has thread 1 whatever its hint; a new chapter counts from nought, and a hint keeps it there
    assert rows(got, "i", "thread") == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 1), (6, 0), (7, 1)]
    assert neighbours.chapter_threads(d.where("false"), ["v"], "ch", "i", "topic", "hint").count() == 0
