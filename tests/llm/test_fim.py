import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import fim


def brute(doc_id, text, rate=100):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(b"7:" + str(doc_id).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10**12), st.text(alphabet=st.sampled_from("ab<>PSM \n\r é漢😀\x00"), max_size=40), st.sampled_from([0, 30, 100]))
def test_equals_regular_expression(doc_id, text, rate):
    got = fim.transform(doc_id, text, rate=rate)
    assert got == brute(doc_id, text, rate)
    assert fim.restore(got[4], got[1]) == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \t\nx"), max_size=30))
def test_words(text):
    n, form, p, m, out = fim.transform(3, text, units="words")
    assert n == len(re.findall(r"\s+|\S+", text)) and fim.restore(out, form) == text


def test_rows(spark):
    texts = [None, "", "\n", "one line", "a\nb\n\nc", "has <M> inside", "é漢😀\n" * 5000, "x" * 300_000, "a\nb\n\nc"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "a\nb\n\nc"), (None, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("mine")).withColumn("n", F.lit("mine"))
    got = fim.restored(fim.fill_in_middle(docs)).collect()
    want = [(i, *brute("" if i is None else i, t or ""), t or "") for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    none = fim.fill_in_middle(docs.where("false"))
    assert none.collect() == [] and none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


@pytest.mark.parametrize("rate", [0, 40])
def test_rate_and_forms(spark, rate):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = {r.form: r["count"] for r in fim.fill_in_middle(docs, rate=rate, spm=25).groupBy("form").count().collect()}
    made = 4000 - forms.get("plain", 0)
    assert abs(made - 40 * rate) < 130 and (not rate or abs(forms["spm"] - made / 4) < 90)
