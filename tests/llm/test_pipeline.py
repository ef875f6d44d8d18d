import corpus_pipeline
from tidewright.llm import simhash


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in seen[name].values())
    assert set(seen["personal_data"]) <= set(seen["near_dedup"]) <= set(seen["line_dedup"]) <= set(seen["quality_rules"])
    fps = [simhash.fingerprint(r.text.encode()) for r in seen["near_dedup"].values()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["personal_data"])


def test_empty(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage again in plain Python, over a table with copies, repeated passages, junk and personal data."""
    import re
    import zlib

    import numpy as np
    from test_lines import brute as brute_lines
    from test_near import brute_groups
    from test_pii import BASE, luhn

    from tidewright.llm import bpe, pii, rules

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text) for r in source if len(r.text) < 6000] + [(9001, None), (9002, ""), (9003, source[3].text), (9004, source[5].text + " tail")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long"
                          ).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for d, t in docs:
        m = dict(zip(rules.MEASURES, rules.measure((t or "").encode())))
        if not any(eval(rule, {}, dict(m)) for rule in rules.RULES.values()):  # noqa: S307
            kept.append((d, t))
    words = re.compile(r"[^\x20\x09-\x0D]")
    kept = [(d, t) for d, t, n in brute_lines(kept, 50) if not n or words.search(t)]
    # the contract of a near-duplicate stage on word shingles: five words, similarity of 0.8 or more, by all pairs
    keep = set(brute_groups(kept).values())
    want = {}
    tok = bpe.library(bpe.default_path())
    for d, t in kept:
        if d not in keep:
            continue
        found = []
        for k in pii.KINDS:
            last = 0
            for m in re.finditer(BASE.get(k.name, k.pattern), t):
                digits, near = re.sub("[^0-9]", "", m[0]), t[last:m.start()][-pii.NEAR:]
                last = m.end()
                if k.name == "ip":
                    ok = all(int(p) <= 255 for p in m[0].split("."))
                elif k.name == "card":
                    ok = 13 <= len(digits) <= 19 and luhn(digits)
                elif k.name == "phone":
                    ok = 9 <= len(digits) <= 15
                elif k.name == "iban":
                    plain = m[0].replace(" ", "")
                    ok = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
                else:
                    ok = bool(re.search(k.near, near, re.I)) or m[0].startswith("AKIA") or k.base
                if ok:
                    found.append((m.start(), m.end(), k.name))
        out, at = [], 0
        for s, e, name in sorted(found):
            if s >= at:
                out += [t[at:s], f"<{name.upper()}>"]
            at = max(at, e)
        ids = tok.encode("".join(out) + t[at:], add_special_tokens=False).ids + [2]
        want[d] = sorted((s, zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 4096))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids_crc32, r.doc_tokens))
    assert {d: sorted(p) for d, p in got.items()} == want
    assert len(want) < len(docs) - 20
