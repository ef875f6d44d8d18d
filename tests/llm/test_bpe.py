import hashlib
import random

import pytest

from tidewright.llm import bpe, packing

POOL = "aAbBzZ09'sS.,!ÀÉßéñ×÷ªº­   İıſǅσςΣαάά́é中文字🙂\t\n\r \x0b\x0c\x1c\x85<|>_-"


def texts():
    rnd = random.Random(1)
    out = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return out + ["a<|endoftext|>b <|startoftext|>c <|endoftext", "I'LL we've 'S 't", "x" * 3000, "", " \n ", "the same words " * 5000]


def test_pieces_encode_as_the_library_does():
    path = bpe.default_path()
    tok, plain = bpe.library(path), bpe.Encoder(path)
    words = {w for t in texts() for p in t.lower().split() if bpe.PLAIN.fullmatch(p) for w in bpe.WORDS.findall(p)}
    lex = bpe.Lexicon(bpe.Lexicon.build({w.encode(): plain.merge(w) for w in words}))
    assert all(lex.get(w.encode()) == plain.merge(w) for w in words)
    assert lex.get(b"") is None and lex.get(b"no such word") is None
    enc = bpe.Encoder(path, lex)
    for t in texts():
        assert [i for p in t.encode().split() for i in enc.piece(p)] == tok.encode(t, add_special_tokens=False).ids, t


def test_library_ids_tell_pieces_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(bpe, "STORE_PIECES", 50)
    path = bpe.default_path()
    tok, store = bpe.library(path), bpe.LibraryIds(path)
    for at in range(0, len(texts()), 40):
        part = texts()[at:at + 40]
        for t, ids in zip(part, store.texts([t.encode().split() for t in part])):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert list(store.texts([[], []])) == [b"", b""]


def test_lexicon_shares_suffixes():
    block = bpe.Lexicon.build({w: (i,) for i, w in enumerate([b"walking", b"talking", b"walked", b"talked", b"walk", b"talk"])})
    lex = bpe.Lexicon(block)
    assert lex.get(b"talk") == (5,) and lex.get(b"walked") == (2,) and lex.get(b"wal") is None
    assert len(lex.first) - 1 == 9  # one branch for both stems
    assert bpe.Lexicon(bpe.Lexicon.build({})).get(b"a") is None


@pytest.mark.parametrize("together", [500_000, 37])
def test_digests_encode_decode(spark, monkeypatch, together):
    monkeypatch.setattr(bpe, "TOGETHER", together)
    path = bpe.default_path()
    tok = bpe.library(path)
    rows = [(i, t, i) for i, t in enumerate(texts())] + [(None, None, 1), (7, "again", 2), (7, "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, path, bpe.lexicon(df, path, 500)).collect()}

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = set()
    for d, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert got == want
    back = bpe.decode(bpe.encode(df, path), path).collect()
    assert sorted((r.doc_id or -1, sha(r.text)) for r in back) == sorted(
        (d or -1, sha(tok.decode(tok.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False))) for d, t, _ in rows)
    assert bpe.digests(df.limit(0), path, bpe.lexicon(df.limit(0), path)).count() == 0


@pytest.mark.parametrize("shards", [200_000, 40])
def test_packing(spark, monkeypatch, shards):
    import zlib

    import numpy as np

    monkeypatch.setattr(packing, "SHARD_PIECES", shards)
    path = bpe.default_path()
    tok = bpe.library(path)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma,", "Delta"]) for _ in range(int(rnd.lognormvariate(6, 1.3)))), "x")
            for i in range(120)]
    rows += [(500, None, "y"), (501, "", "y"), (None, "null id", "z"), (1, "twice", "z"), (1, "twice", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = packing.pack(df, path).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in pieces.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    want = []
    for d, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), packing.WINDOW):
            part = ids[s:s + packing.WINDOW]
            want.append((d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str) == sorted(want, key=str)
    if shards > 1000:
        assert len(pieces) <= sum(w[2] for w in want) / packing.WINDOW * 1.01 + 1
    assert packing.pack(df.limit(0), path).count() == 0


def test_best_fit_is_tightest():
    import numpy as np

    lengths = sorted(np.random.default_rng(0).integers(1, 4097, 800).tolist(), reverse=True)
    which, offset = packing.best_fit(lengths)
    left = []
    for n, w, o in zip(lengths, which, offset):
        fits = [c for c in left if c >= n]
        if w == len(left):
            assert not fits
            left.append(4096)
        else:
            assert left[w] == min(fits)
        assert o == 4096 - left[w]
        left[w] -= n


def test_every_script_goes_through_the_lexicon_and_exact_merging(monkeypatch):
    """All code points, words of many scripts, long words and special tokens within words, with the library for comparison only."""
    import unicodedata

    path = bpe.default_path()
    tok, enc = bpe.library(path), bpe.Encoder(path)
    assert len(bpe.newer_marks()) < 150
    known = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn" and chr(c) not in bpe.newer_marks()]
    rnd = random.Random(5)
    some = known[:0x3000] + rnd.sample(known, 4000)
    text = " ".join(f"a{c}1 {c}́x" for c in some)
    cases = ["Привет, мир! ΟΔΥΣΣΕΥΣ’s «œuvre» naïve—don’t", "中文字" * 400, "ไทย" * 90, "العربية", "İSTANBUL ſtraße", "x" * 5000, "ab" * 3000, "न्मी" * 60,
             "a<|endoftext|>中<|startoftext|><|endoftext|>", "<|é|>", "\U0001f642‍\U0001f525" * 40, text]
    want = [tok.encode(t, add_special_tokens=False).ids for t in cases]

    class Closed:
        def encode(self, *_, **__):
            raise AssertionError("the library must not be asked")

    monkeypatch.setattr(enc, "library", Closed())
    for t, ids in zip(cases, want):
        assert [i for p in t.encode().split() for i in enc.piece(p)] == ids, t[:40]
    lex = bpe.Lexicon(bpe.Lexicon.build({w.encode(): enc.merge(w) for w in ("привет", "中文字", "œuvre")}))
    assert lex.get("œuvre".encode()) == enc.merge("œuvre")


def test_heap_and_scan_merge_alike(monkeypatch):
    enc, rnd = bpe.Encoder(bpe.default_path()), random.Random(6)
    words = ["".join(rnd.choice("aabetionsré") for _ in range(rnd.randint(1, 90))) for _ in range(400)] + ["a" * n for n in range(1, 70)]
    merged = []
    for most in (0, 1000):
        monkeypatch.setattr(bpe, "LONG_WORD", most)
        merged.append([enc.merge(w) for w in words])
    assert merged[0] == merged[1]
