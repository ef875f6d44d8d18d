import numpy as np
import pytest

from tidewright.llm import embeddings


def brute(rows):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links, parent = [set() for _ in rows], list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
                    parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return {r[0]: (len(links[i]), low.get(find(i), r[0])) for i, r in enumerate(rows)}, sum(map(len, links))


@pytest.mark.parametrize("block", [2048, 30])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=48)
        for _ in range(int(rng.integers(1, 25))):
            rows.append((len(rows), (centre + rng.normal(size=48) * rng.choice([0.05, 0.2, 0.35])).tolist(), int(c % 3)))
    hot = rng.normal(size=48)
    rows += [(len(rows) + i, (hot + rng.normal(size=48) * 0.02).tolist(), 1) for i in range(120)]
    rows += [(5000 + i, rows[3][1], rows[3][2]) for i in range(4)]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 48, 1), (6003, [None] * 48, 1), (6004, [float("nan")] * 48, 1),
             (6005, [float("inf")] * 48, 1), (6006, rows[3][1], None), (6007, [1.0], 2), (6008, [2.0], 2), (6009, [-0.0, 1.0], 2), (6010, [0.0, 1.0], 2)]
    df = spark.createDataFrame([(v, e, l, "x") for v, e, l in rows], "vec_id long, embedding array<float>, label int, links string")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want, total = brute(rows)
    got = {r.vec_id: r for r in embeddings.neighbours(df).collect()}
    assert set(got) == set(want)
    assert all(got[v].n_links <= n for v, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * total
    assert sum(got[v].component_id == c for v, (_, c) in want.items()) >= 0.95 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.neighbours(df.limit(0)).count() == 0


def test_hadamard():
    x = np.eye(8)
    assert np.allclose(embeddings.hadamard(embeddings.hadamard(x)), x)
    assert np.allclose(np.abs(embeddings.hadamard(x)), 1 / np.sqrt(8))


def same_bucket(x, label):
    return np.zeros((len(x), 32), np.int64)


same_bucket.__module__ = "__main__"  # workers get it by value


@pytest.mark.parametrize("block", [2048, 7])
def test_a_bucket_of_vectors_of_several_lengths_loses_no_link(spark, monkeypatch, block):
    """All keys coincide, so every two vectors of a label and length meet and links are those of all pairs."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "bucket_keys", same_bucket)
    rng = np.random.default_rng(4)
    rows = []
    for d in (3, 4, 9):
        centre = rng.normal(size=d)
        rows += [(len(rows) + i, (centre + rng.normal(size=d) * 0.3).tolist(), i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, total = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.neighbours(df).collect()}
    assert got == want and total > 40
