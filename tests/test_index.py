"""The vector index against exact searches, and threshold joins against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tidewright import registry
from tidewright.operators import inverted, similar


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>, chapter long")


def cosines(x):
    x = np.array(x, float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_index_recall_on_the_whole_table(spark, sf):
    rows = registry.load()[0]["i03_index_recall"](spark, f"/root/testdata/{sf}").collect()
    found, wanted = sum(r.found for r in rows), sum(r.wanted for r in rows)
    assert len(rows) == {"sf0.01": 5, "sf0.1": 20}[sf] and wanted == 40 * len(rows)
    assert found / wanted >= 0.9 and all(r.opened < r.lists for r in rows)


def test_index_opens_few_lists_where_vectors_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 50)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 24)) * 4
    x = centre[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 24)) * 0.5
    d = vectors(spark, [(i, v.tolist(), i % 3) for i, v in enumerate(x)])
    index = inverted.build(d, 10, extra=["chapter"])
    got = inverted.search(index, d.where("id % 100 = 0"), 10).collect()
    sim, hit = cosines(x), 0
    for q in range(0, 3000, 100):
        mine = sorted((r.rank, r.id, r.score, r.chapter) for r in got if r.query == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(sim[q, i] - s) < 1e-8 and c == i % 3 for _, i, s, c in mine)
        hit += len({m[1] for m in mine} & set(np.argsort(-sim[q])[:10]))
    assert hit / 300 > 0.95 and index.probes <= len(index.centroids) // 4


def test_index_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [1.0, 0.0, 0.0], 0), (5, [], 0), (6, [2.0, 0.0], 0), (7, [0.0, 1.0], 0)]
    d = vectors(spark, rows)
    index = inverted.build(d, 5)
    got = inverted.search(index, d, 5, probes=len(index.centroids)).collect()
    assert sorted((r.query, r.rank, r.id, r.score) for r in got if r.query == 1) == [(1, 1, 1, 1.0), (1, 2, 6, 1.0), (1, 3, 7, 0.0)]
    assert {r.query for r in got} == {1, 6, 7}
    empty = inverted.build(d.where("false"), 5)
    assert inverted.search(empty, d, 5).collect() == []


@pytest.mark.parametrize("size", [2048, 12])
def test_links_equal_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(similar, "SIZE", size)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(9, 10))
    x = centre[rng.integers(0, 9, 160)] + rng.normal(size=(160, 10)) * 0.35
    rows = [(i, v.tolist(), int(i % 4 == 0)) for i, v in enumerate(x)]
    odd = [(200, None, 0), (201, [0.0] * 10, 0), (202, [], 0), (203, [1.0, 2.0], 0), (204, [2.0, 4.0], 0), (205, rows[1][1], 1)]
    d = vectors(spark, rows + odd)
    got = {(r.chapter, r.a, r.b): r.sim for r in similar.links(d, ["chapter"], 0.8).collect()}
    sim, group = cosines(x), [r[2] for r in rows]
    want = {(group[i], i, j): sim[i, j] for i in range(160) for j in range(i + 1, 160) if group[i] == group[j] and sim[i, j] >= 0.8} | {(0, 203, 204): 1.0}
    want |= {(1, i, 205): sim[i, 1] for i in range(160) if group[i] == 1 and sim[i, 1] >= 0.8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    n = {r.id: (r.n_links, r.best) for r in similar.degrees(d, similar.links(d, ["chapter"], 0.8), ["chapter"]).collect()}
    assert len(n) == 166 and n[200] == (0, None) and sum(v[0] for v in n.values()) == 2 * len(want)


def test_blocks_that_are_too_far_apart_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "SIZE", 20)
    rng = np.random.default_rng(3)
    far = np.concatenate([np.eye(8)[c] * 10 + rng.normal(size=(60, 8)) * 0.1 for c in range(8)])
    d = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(far)])
    linked = similar.links(d, ["chapter"], 0.9)
    assert linked.count() == 8 * 60 * 59 // 2
    tasks = linked.select("chapter").rdd.getNumPartitions()
    assert tasks >= 1


def test_first_fit_equals_a_single_pass(spark):
    rng = np.random.default_rng(4)
    for share in (0.004, 0.02, 0.1):
        n = 120
        pairs = [(0, i, j, 1.0) for i in range(n) for j in range(i + 1, n) if rng.random() < share] + [(1, i, i + 1, 1.0) for i in range(60)]  # and a chain
        rows = [(i, None, 0) for i in range(n)] + [(i, None, 1) for i in range(61)]
        linked = spark.createDataFrame(pairs, "chapter long, a long, b long, sim double")
        got = {(r.chapter, r.id): r.cluster for r in similar.first_fit(vectors(spark, rows), linked, ["chapter"]).collect()}
        for c, size in ((0, n), (1, 61)):
            near = {(a, b) for g, a, b, _ in pairs if g == c}
            clusters = []
            for i in range(size):
                home = next((k for k in clusters if any((j, i) in near for j in k)), None)
                if home is None:
                    clusters.append(home := [])
                home.append(i)
            assert {i: got[c, i] for i in range(size)} == {i: k for k, members in enumerate(clusters) for i in members}
    assert similar.first_fit(vectors(spark, []), linked, ["chapter"]).count() == 0
