import numpy as np

from tidewright.llm import langid


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()}
    got = langid.op10_language_id(spark, path).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert 0.15 < len(held) / len(got) < 0.35
    right = [r.lang_pred == truth[r.doc_id][0] for r in held]
    assert np.mean(right) > 0.97
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05  # calibrated
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(i, f"the cat and the dog number {i} went home", "en", 1) for i in range(40)]
    rows += [(100 + i, f"der Hund und die Katze Nummer {i} gehen nach Hause", "de", 1) for i in range(40)]
    rows += [(500, None, "en", 1), (501, "", None, 1), (502, "123 .. ²", "de", 1), (None, "und der Hund", "de", 1), (503, "the dog " * 60_000, None, 1),
             (3, "the cat", "en", 1), (3, "the cat", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(df, langid._crc("doc_id") % 4 != 2)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    told = {r.doc_id: r.lang_pred for r in got}
    assert told[500] == told[501] == told[502] == "und" and told[503] == "en" and told[None] == "de"
    assert np.mean([told[d] == lang for d, _, lang, _ in rows[:80]]) == 1
    again = langid.fit(df.repartition(3), langid._crc("doc_id") % 4 != 2)
    assert np.array_equal(model.table, again.table)
    nothing = langid.predict(df, langid.fit(df.limit(0), langid._crc("doc_id") % 4 != 2))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_chunks_do_not_change_the_features(monkeypatch):
    text = "Straße und Häuser, viele Häuser ".encode() * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "CHUNK", 17)
    parts = langid.features(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_features_averaging_softmax_and_step_equal_brute_force():
    """Everything again with plain Python numbers, n-gram by n-gram."""
    import math

    def grams(text):
        raw = [32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in b" " + text + b" "]
        out = []
        for n in (2, 3, 4):
            for i in range(len(raw) - n + 1):
                h = n
                for c in raw[i:i + n]:
                    h = (h ^ c) * 0x01000193 % (1 << 32)
                out.append((h ^ h >> 16) % (1 << 16))
        return out

    rng = np.random.default_rng(2)
    table, bias = rng.normal(size=(1 << 16, 3)).astype(np.float32), np.array([0.1, -0.2, 0.3])
    model = langid.Model(["a", "b", "c"], table, bias, 1.7, 0.0)
    for text in ("The Cat\nsat", "ö", "x", "Der Hund " * 40):
        got, want = langid.features(text.encode()), {}
        for g in grams(text.encode()):
            want[g] = want.get(g, 0) + 1
        assert dict(zip(got[0].tolist(), got[1].tolist())) == want
        n = sum(want.values())
        z = [(sum(c * float(table[g, i]) for g, c in want.items()) / n + bias[i]) / 1.7 for i in range(3)]
        p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
        assert np.allclose(model.scores(text.encode()), p, atol=1e-6)
    embed, out, bias = rng.normal(size=(6, 2)), rng.normal(size=(2, 3)), rng.normal(size=3)
    b, w, y, rate = np.array([1, 4]), np.array([0.25, 0.75]), 2, 0.3
    v = [sum(w[i] * embed[b[i], d] for i in range(2)) for d in range(2)]
    z = [sum(v[d] * out[d, k] for d in range(2)) + bias[k] for k in range(3)]
    g = [math.exp(x) / sum(map(math.exp, z)) - (k == y) for k, x in enumerate(z)]
    back = [sum(out[d, k] * g[k] for k in range(3)) for d in range(2)]
    e2, o2, b2 = embed.copy(), out.copy(), bias.copy()
    for d in range(2):
        for k in range(3):
            o2[d, k] -= rate * v[d] * g[k]
        for i in range(2):
            e2[b[i], d] -= rate * 20 * w[i] * back[d]
    b2 -= 0.1 * rate * np.array(g)
    langid.step(embed, out, bias, b, w, y, rate)
    assert np.allclose(embed, e2) and np.allclose(out, o2) and np.allclose(bias, b2)


def test_training_reads_whole_texts(spark):
    """What tells two languages apart lies behind the first few thousand bytes."""
    rows = [(i, "zz " * 2000 + ("uvu " if i % 2 else "wxw ") * 3000, "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, langid._crc("doc_id") % 4 != 2)
    assert [r.lang_pred for r in langid.predict(df, model).orderBy("doc_id").collect()] == ["ab"[i % 2] for i in range(60)]
