import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import ann


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def brute(rows, k, asks):
    """(query, vec_id, score) by comparing everything, best first."""
    ok = [i for i, r in enumerate(rows) if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    out = {}
    for i in ok:
        if asks(rows[i][0]):
            near = sorted((-float(np.dot(rows[i][1], rows[j][1])), rows[j][0], j) for j in ok if j != i and len(rows[j][1]) == len(rows[i][1]))
            out[i] = [(v, -s) for s, v, _ in near[:k]]
    return out


def recall(got, rows, k, asks, key=lambda r: r.query_id):
    """Share of the true neighbours that were found; every row found is checked on the way."""
    by, want, hit, all_ = {}, brute(rows, k, asks), 0, 0
    for r in got:
        by.setdefault(key(r), []).append(r)
    vec = {r[0]: r[1] for r in rows}
    for i, best in want.items():
        mine = sorted(by.get(rows[i][0], []), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert all(abs(r.score - np.dot(rows[i][1], vec[r.vec_id])) < 1e-9 * max(1, abs(r.score)) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert rows[i][0] not in [r.vec_id for r in mine]
        hit += len({r.vec_id for r in mine} & {v for v, _ in best})
        all_ += len(best)
    return hit / max(1, all_)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = ann.op11_nearest_neighbours(spark, path).collect()
    assert recall(got, rows, 20, lambda v: v % 20 == 0) >= 0.93


def test_recall_over_norms_of_every_size_and_few_dimensions(spark):
    rng = np.random.default_rng(5)
    for d in (3, 24, 150):
        centre = rng.normal(size=(20, d))
        x = centre[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, d)) * 0.6
        x *= np.exp(rng.normal(size=(1500, 1)) * 1.5)
        rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
        got = ann.search(frame(spark, rows), F.col("vec_id") % 50 == 0, 10).collect()
        assert recall(got, rows, 10, lambda v: v % 50 == 0) >= 0.9, d


def test_large_buckets_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "PAIRS", 1 << 10)
    rng = np.random.default_rng(6)
    hot = rng.normal(size=32)
    rows = [(i, (hot + rng.normal(size=32) * 1e-3).tolist(), 0) for i in range(600)]
    rows += [(600 + i, rng.normal(size=32).tolist(), 0) for i in range(900)]
    got = ann.search(frame(spark, rows), F.col("vec_id") % 25 == 0, 8).collect()
    assert recall(got, rows, 8, lambda v: v % 25 == 0) >= 0.9


def test_ties_copies_and_what_takes_no_part(spark):
    one, two = [1.0, 0.0, 2.0], [0.5, 1.0, 0.0]
    rows = [(0, one, 1), (7, one, 1), (3, one, None), (5, two, 1), (20, None, 1), (40, [0.0, 0.0, 0.0], 1), (60, [1.0, None, 1.0], 1),
            (80, [1.0, float("nan"), 1.0], 1), (100, [float("inf"), 0.0, 0.0], 1), (120, [], 1), (None, one, 1), (140, [1.0, 2.0], 1), (9, [-1.0, 0.0, -2.0], 1)]
    got = ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0, 2).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 3, 5.0), (0, 2, 7, 5.0)]
    got = ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0, 9).collect()  # fewer candidates than k, one with a negative product
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 3, 5.0), (2, 7, 5.0), (3, 5, 0.5), (4, 9, -5.0)]


def test_repeated_rows_are_rows(spark):
    rows = [(0, [1.0, 1.0], 1)] * 2 + [(4, [2.0, 0.5], 1)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(frame(spark, rows), F.col("vec_id") == 0, 5).collect())
    assert got == [(0, 1, 4), (0, 1, 4), (0, 2, 0), (0, 2, 0)]


def test_empty_tables_and_clashing_columns(spark):
    empty = ann.search(frame(spark, []), F.col("vec_id") % 20 == 0, 5)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert dict(empty.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = frame(spark, [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1)])
    for c in ("row", "id", "vec", "key", "cell", "asks", "score", "rank"):
        rows = rows.withColumn(c, F.lit("mine"))
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(rows, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 4.0)]
    assert ann.search(rows, F.lit(False), 5).collect() == []
