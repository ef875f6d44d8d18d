from collections import Counter

from tidewright.llm import rules

SPACES = " \t\n\v\f\r"


def brute(text):
    text = text or ""
    words = "".join(" " if c in SPACES else c for c in text).split(" ")
    words = [w for w in words if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(hit)


TEXTS = [None, "", " \n\t", "one", "a b c d e a b c d e", "a b c d e f\na b c d e f\n\n\na b c d e f", "x " * 200, "Été ÉTÉ ** || <b> & % $ #\n*",
         "a b c d\x1ce f", "line one here\nline one here\r\nline one here", "no repeats at all in this quite long enough line, really none",
         " ".join(f"w{i % 7}" for i in range(300))]


def test_ledger_equals_brute_force(spark, monkeypatch):
    rows = [(i, t, "m") for i, t in enumerate(TEXTS)] + [(None, "null id row", "m"), (1, "again", "m"), (1, "again", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    want = sorted(((d, *brute(t)) for d, t, _ in rows), key=str)
    for long_text in (rules.LONG_TEXT, 3):
        monkeypatch.setattr(rules, "LONG_TEXT", long_text)
        assert sorted(((d, *rules.measure((t or "").encode())[:5]) for d, t, _ in rows), key=str) == want
    got = rules.ledger(df)
    assert sorted(((r.doc_id, *r[1:6]) for r in got.collect()), key=str) == want
    assert rules.ledger(df.limit(0)).count() == 0
    kept = rules.keep(df)
    assert kept.columns == df.columns
    assert {r.text for r in kept.collect()} == {r.text for r in df.collect() if r.text and "no repeats" in r.text}


def test_policies_and_ablation(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 4)], "doc_id long, fail_bits long")
    assert [r.doc_id for r in df.where(rules.passes("base")).orderBy("doc_id").collect()] == [1, 4]
    got = {r.rule: (r.n_failed, r.n_alone) for r in rules.ablation(df).collect()}
    assert got["few_words"] == (2, 1) and got["repeats"] == (1, 0) and got["symbols"] == (1, 1)
