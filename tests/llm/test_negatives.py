import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import negatives


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")


def brute(rows, asks, p=5, n=10, low=30, high=90):
    ok = [i for i, r in enumerate(rows) if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for a in (i for i in ok if asks(rows[i][0])):
        score = {j: sum(x * y for x, y in zip(rows[a][2], rows[j][2])) for j in ok if j != a and len(rows[j][2]) == len(rows[a][2])}
        order = sorted(score, key=lambda j: (-score[j], rows[j][0], j))
        for pos in [j for j in order if rows[j][1] == rows[a][1]][:p]:
            neg = [j for j in order if rows[j][1] != rows[a][1] and low * score[pos] <= 100 * score[j] <= high * score[pos]][:n]
            out += [(rows[a][0], rows[pos][0], r, rows[j][0], score[pos], score[j]) for r, j in enumerate(neg, 1)]
    return sorted(out)


def mined(df, asks, **more):
    return sorted(map(tuple, negatives.mine(df, asks, **more).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many regions, blocks and leaves
        for name, value in (("REGION", 60), ("BLOCK", 25), ("LEAF", 4), ("GROUPS", 3)):
            monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(8):
        centre = rng.normal(size=12) * 60
        rows += [(len(rows) + i, int(rng.integers(0, 4)), (centre + rng.normal(size=12) * 40).astype(int).tolist()) for i in range(50)]
    rows += [(400 + i, 1, [5] * 12) for i in range(80)] + [(480 + i, 2, [4] * 12) for i in range(80)]  # copies, all scores equal
    want = brute(rows, lambda v: v % 20 == 0)
    assert want and mined(frame(spark, rows), F.col("vec_id") % 20 == 0) == want
    assert mined(frame(spark, rows), F.col("vec_id") % 20 == 0, positives=2, negatives=3, low=-10, high=60) == brute(rows, lambda v: v % 20 == 0, 2, 3, -10, 60)


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(9)
    x = np.concatenate([c + rng.normal(size=(400, 6)) * 3 for c in rng.normal(size=(12, 6)) * 200]).round()
    top = float(np.sqrt((x**2).sum(axis=1)).max())
    tree = negatives.Tree(negatives.lift(x, top), 64)
    least, most = tree.bounds(x[:40])
    for i in range(40):
        d = np.sqrt(np.maximum(0, (x[i]**2).sum() + top**2 - 2 * x @ x[i]))[tree.order]
        for leaf in range(64):
            part = d[tree.edges[leaf]:tree.edges[leaf + 1]]
            assert least[i, leaf] <= part.min() + 1e-6 * top and most[i, leaf] >= part.max() - 1e-6 * top
    assert sorted(tree.order) == list(range(len(x))) and (least > 0).mean() > 0.3
    loose = negatives.Tree(negatives.lift(x[::7], top), 16).loosen()
    leaf, (least, most) = loose.route(negatives.lift(x, top)), loose.bounds(x[:5])
    d = np.sqrt(np.maximum(0, (x[:5]**2).sum(axis=1)[:, None] + top**2 - 2 * x[:5] @ x.T))
    assert (least[:, leaf] <= d + 1e-6 * top).all() and (most[:, leaf] >= d - 1e-6 * top).all()


def test_large_numbers_are_exact(spark):
    big = 1 << 30
    rows = [(0, 1, [big, 3, -big]), (1, 1, [big, 2, -big]), (2, 2, [big // 2, 5, -big // 2]), (3, 2, [big // 2, 4, -big // 2]), (4, 3, [1, 0, 0])]
    want = brute(rows, lambda v: v == 0, low=0, high=99)
    got = negatives.mine(frame(spark, rows), F.col("vec_id") == 0, low=0, high=99).select("anchor_id", "positive_id", "rank", "negative_id").collect()
    assert sorted(map(tuple, got)) == [r[:4] for r in want] and len(want) == 3


def test_nulls_ties_lengths_and_repeats(spark):
    v = [10, 0, 1]
    rows = [(0, 1, v), (0, 1, v), (9, 1, [9, 0, 0]), (3, 2, [7, 0, 0]), (2, 2, [7, 0, 0]), (2, 2, [7, 0, 0]), (5, None, v), (6, 2, None), (7, 2, [1, None, 1]),
            (None, 2, [7, 0, 0]), (8, 3, [0, 0, 0]), (11, 3, [5, 5]), (12, 1, []), (13, 2, []), (14, 4, [-7, 0, 0])]
    for asks in (lambda x: x == 0, lambda x: True):
        column = F.col("vec_id") == 0 if not asks(1) else F.lit(True)
        assert mined(frame(spark, rows), column) == brute(rows, asks)


def test_empty_tables_and_clashing_columns(spark):
    rows = frame(spark, [(0, 1, [4, 4]), (1, 1, [5, 5]), (2, 2, [3, 3])])
    empty = negatives.mine(rows.where("false"), F.lit(True))
    assert empty.collect() == [] and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(rows, F.lit(False)) == []
    for c in ("row", "id", "vec", "key", "group", "asks", "scores", "places", "d", "region"):
        rows = rows.withColumn(c, F.lit("mine"))
    assert mined(rows, F.col("vec_id") == 0) == [(0, 1, 1, 2, 40, 24)]
