import pytest
import numpy as np
from test_simhash import brute_fp

from tidewright.llm import near


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_groups(rows):
    """The smallest id of each row's group, by all pairs."""
    sets, fps, parent = [brute_shingles(t) for _, t in rows], [brute_fp(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            alike = 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and sets[i]
            if alike or (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return {r[0]: low[find(i)] for i, r in enumerate(rows)}


def test_planted_near_copies_are_one_group(spark, tmp_path):
    """Lightly edited copies on either side of 0.8, and a key with far more than PAIRS texts, against all pairs."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choice(words, 150))) for i in range(40)]
    for i in range(40):
        for k in range(1, 6):
            text = rows[i][1].split()
            for at in rng.choice(150, k, replace=False):
                text[at] = "edited"
            rows.append((1000 + 10 * i + k, " ".join(text)))
    hot = [f"h{i}" for i in range(200)]
    for i in range(120):
        text = list(hot)
        for at in rng.choice(200, int(rng.integers(1, 7)), replace=False):
            text[at] = f"e{i}"
        rows.append((5000 + i, " ".join(text)))
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "One  two"), (9004, rows[0][1].upper())]
    want = brute_groups(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert {r.doc_id: r.component_id for r in near.groups(docs).collect()} == want
    kept = near.dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    far = sum((brute_fp(rows[i][1]) ^ brute_fp(t)).bit_count() > 3 for i in range(40) for d, t in rows if d // 10 == 100 + i and want[d] == i)
    assert far > 40  # copies that three bits do not reach
    assert near.groups(docs.limit(0)).count() == 0


def test_pipeline_stage_takes_them(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(120))
    rows = [(1, text), (2, text.replace("word30", "other").replace("word80", "other")), (3, text[::-1])]
    assert (brute_fp(rows[0][1]) ^ brute_fp(rows[1][1])).bit_count() > 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_part_sizes_never_lose_a_similar_pair():
    rng = np.random.default_rng(7)
    dropped = 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.3, 0.8, 0.9, 1.0])], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64) * np.uint64(2)]))
        may = near.may_be_similar(near.part_sizes(a), near.part_sizes(b))
        assert may or not near.similar(a, b)
        dropped += not may
    assert dropped > 50 and near.part_sizes(np.zeros(0, np.uint64)) is None
    assert near.part_sizes(np.arange(300, dtype=np.uint64)) is None  # 300 in one part: nothing is said, the pair is kept
    assert near.may_be_similar(None, b"x")


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_broadcast_or_not_gives_the_same_groups(spark, monkeypatch, few):
    monkeypatch.setattr(near, "FEW", few)
    rnd = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words, 60)) for _ in range(12)]
    rows = [(i * 10 + j, base[i] + f" tail{j}" * (j % 3)) for i in range(12) for j in range(4)]
    got = {r.doc_id: r.component_id for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d // 10 * 10 for d, _ in rows}


def test_a_passage_met_twice_a_task_is_no_key_of_many_texts(spark, monkeypatch):
    """Six passages in a hundred texts each, so that a chunk of twelve texts meets each of them twice."""
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{k}x{j}" for j in range(20)) for k in range(6)]
    rows = [(i, i, " ".join(f"u{x}" for x in rng.integers(0, 1 << 40, 60)) + " " + passages[i % 6]) for i in range(600)]
    monkeypatch.setattr(near, "HELD", 11 * 76)
    docs = spark.createDataFrame(rows, "row long, doc_id long, text string").coalesce(1)
    held = near._profiles(docs, "row").selectExpr("explode(keys) as key").groupBy("key").count()
    assert held.agg({"count": "max"}).first()[0] <= near.PAIRS


def test_large_keys_by_size_lose_no_pair(spark, monkeypatch):
    """Every shared key is large and only one star is tried, so the pairs left meet by key and size; sizes on either side of 0.8."""
    monkeypatch.setattr(near, "PAIRS", 1)
    monkeypatch.setattr(near, "STARS", 1)
    rng = np.random.default_rng(11)
    rows = []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(400)]
        for i in range(30):
            n = int(rng.integers(20, 400)) if i % 2 else int(100 * 1.25 ** (i // 2 % 6))
            text = words[:n]
            if i % 3 == 0:
                text[int(rng.integers(0, n))] = f"e{i}"
            rows.append((100 * family + i, " ".join(text)))
    want = brute_groups(rows)
    assert len(set(want.values())) > 6
    assert {r.doc_id: r.component_id for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
