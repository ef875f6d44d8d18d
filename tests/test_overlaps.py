"""Word overlap on odd rows, and how often a text is taken apart."""

from __future__ import annotations

from tidewright.functions import text


def test_overlaps(spark):
    items = spark.createDataFrame([(1, "The red fox, the den"), (2, "fox"), (3, ""), (4, None), (5, "a b c d e f"), (6, "none of these")], "item long, text string")
    docs = spark.createDataFrame([(10, "RED fox"), (11, None), (12, ""), (13, "e f... d c x y"), (14, "fox fox fox"), (None, "the den of a red fox"), (15, "e f")], "doc long, text string")
    found = text.overlaps(items, docs, "item", "doc", 0.5)
    got = sorted(((r.item, r.doc or 0, round(r.overlap, 6)) for r in found.collect()))
    # the text without an id is a document like any other, as in SQL
    assert got == [(1, 0, 1.0), (1, 10, 0.5), (2, 0, 1.0), (2, 10, 1.0), (2, 14, 1.0), (5, 13, 0.666667)]
    assert text.overlaps(items, docs.limit(0), "item", "doc", 0.5).count() == 0
    assert text.overlaps(items.limit(0), docs, "item", "doc", 0.5).count() == 0


def test_a_text_is_taken_apart_once(spark):
    docs = spark.createDataFrame([(i, f"w{i} common words here") for i in range(20)], "doc long, text string")
    plan = text.overlaps(docs.withColumnRenamed("doc", "item"), docs, "item", "doc", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan  # the words are in a table of their own by then
