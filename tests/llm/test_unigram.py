import random

from tidewright.llm import unigram

POOL = "aAbBzZ09'sS.,!ÀÉßéñ×÷ªº­   İıſǅσςΣαάά́é中文字🙂\t\n\r \x0b\x0c\x85<|>_-▁▁"


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = unigram.default_path()
    vocab, unknown = unigram.vocabulary(path)
    tok = Tokenizer(models.Unigram(vocab, unk_id=unknown, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    texts += ["".join(rnd.choice("aeinst rthou") for _ in range(60)) for _ in range(400)]
    texts += ["<unk>a", "<s> x", "<0x0A>", "", "▁", " ", "  ", "word " * 40_000, "y" * 20_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (3, "again and again", "x"), (3, "again and again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.n_tokens) for r in unigram.count_tokens(df, path).collect()), key=str)
    assert got == sorted(((d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows), key=str)
    assert unigram.count_tokens(df.limit(0), path).count() == 0


def test_ties_take_the_earliest_start():
    c = unigram.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0)])
    assert c("ab") == (1, -2.0)
    assert c("abc") == (1, -3.0)
    assert c("zab") == (2, -15.0)


def test_scores_equal_brute_force(spark):
    """The best score of every word again, over all places where a vocabulary piece fits."""
    path = unigram.default_path()
    vocab = dict(unigram.vocabulary(path)[0])
    longest, unknown = max(map(len, vocab)), min(vocab.values()) - unigram.UNKNOWN_PENALTY

    def best(word):
        score = [0.0] + [float("-inf")] * len(word)
        for end in range(1, len(word) + 1):
            fits = [score[s] + vocab[word[s:end]] for s in range(max(0, end - longest), end) if word[s:end] in vocab]
            score[end] = max(fits + ([score[end - 1] + unknown] if word[end - 1] not in vocab else []))
        return score[-1]

    rnd = random.Random(2)
    texts = ["".join(rnd.choice(POOL + "etaoin ") for _ in range(rnd.randint(1, 50))) for _ in range(200)] + ["the whole 文 text\n of it", "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in unigram.count_tokens(df, path).collect():
        want = sum(best(unigram.MARK + w) for w in unigram.words(texts[r.doc_id]))
        assert abs(r.score - want) < 1e-6 * max(1, abs(want)), texts[r.doc_id]
