"""Threshold similarity joins within groups, and what is made of their links.

:func:`links` finds all pairs of a group whose cosine reaches a threshold, and
no other pair leaves a task.  Rows know their angles to ``PIVOTS`` pivots (far
apart rows of a bounded sample); the rows of a large group are cut by nearest
pivot and hash into blocks of about ``SIZE`` rows, and two blocks meet only if
no pivot's triangle inequality shows that all their pairs are too far apart:
angles to a pivot that differ by more than the threshold's angle.  Blocks meet
in tasks of their own, whatever the size of a group.

Vectors that are null, empty or zero, and pairs of different lengths, link with
nothing.  Ids are unique within a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from .inverted import _vectors

PIVOTS, SAMPLE, SIZE = 16, 2048, 2048


def pivots(df: DataFrame, vector: str, tie: str) -> np.ndarray:
    """Up to ``PIVOTS`` directions of a sample, each the farthest from those before."""
    some = df.where(F.size(vector) > 0).orderBy(F.xxhash64(tie)).limit(SAMPLE).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    sizes = np.diff(some.column("v").combine_chunks().offsets.to_numpy()) if len(some) else np.zeros(0, int)
    x = _vectors(some.column("v"), int(np.bincount(sizes).argmax()))[1] if len(sizes) else np.zeros((0, 1))
    if not len(x):
        return np.eye(1)
    chosen, nearest = [x[0]], x @ x[0]
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(x[nearest.argmin()])
        nearest = np.maximum(nearest, x @ chosen[-1])
    return np.array(chosen)


def links(df: DataFrame, keys: list[str], least: float, vector: str = "embedding", tie: str = "id") -> DataFrame:
    """(keys, a, b, sim) of the pairs a < b of a group with a cosine of at least ``least``."""
    where = pivots(df, vector, tie)
    d, m = where.shape[1], len(where)
    reach = math.acos(max(-1.0, min(1.0, least))) + 1e-7
    kind = dict(df.dtypes)
    shape = ", ".join([*[f"{c} {kind[c]}" for c in keys], "id long", f"v {kind[vector]}"])
    src = df.where(F.size(vector) > 0).select(*keys, F.col(tie).cast("long").alias("id"), F.col(vector).alias("v"))

    def angles(batches):
        for b in batches:
            at, v = _vectors(b.column("v"), d)
            own = b.take(pa.array(at))
            far = np.arccos(np.clip(v @ where.T, -1.0, 1.0))
            yield pa.record_batch([*own.columns, pa.array(far.argmin(axis=1)), *(pa.array(far[:, i]) for i in range(m))],
                                  [*b.schema.names, "cell", *(f"p{i}" for i in range(m))])

    # vectors of rarer lengths have no angles to the pivots; they form a cell of their own with open bounds
    measured = src.where(F.size("v") == d).mapInArrow(angles, f"{shape}, cell long, " + ", ".join(f"p{i} double" for i in range(m)))
    rest = src.where(F.size("v") != d).select("*", F.lit(m).cast("long").alias("cell"), *[F.lit(None).cast("double").alias(f"p{i}") for i in range(m)])
    rows = store.keep(measured.unionByName(rest), "angles")

    n = rows.groupBy(*keys, "cell").count()
    whole = n.groupBy(*keys).agg(F.sum("count").alias("whole"))
    cut = n.join(whole, keys).select(*keys, "cell", F.when(F.col("whole") <= SIZE, 0).otherwise(F.ceil(F.col("count") / SIZE)).cast("int").alias("blocks"))
    block = F.when(F.col("blocks") == 0, F.lit(-1)).otherwise(F.col("cell") * 2**24 + F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = rows.join(cut, [*keys, "cell"]).withColumn("block", block.cast("long")).drop("cell", "blocks")

    stats = placed.groupBy(*keys, "block").agg(*[f(f"p{i}").alias(f"{n}{i}") for i in range(m) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    other = stats.select(*keys, *[F.col(c).alias(f"o_{c}") for c in stats.columns if c not in keys])
    near = F.lit(True)
    for i in range(m):
        near = near & F.coalesce((F.col(f"lo{i}") - F.col(f"o_hi{i}") <= reach) & (F.col(f"o_lo{i}") - F.col(f"hi{i}") <= reach), F.lit(True))
    tasks = stats.join(other, keys).where((F.col("block") <= F.col("o_block")) & near).select(*keys, F.col("block").alias("x"), F.col("o_block").alias("y"))
    sides = tasks.select(*keys, "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    met = placed.select(*keys, "block", "id", "v").join(sides, [*keys, "block"])

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own, x, y = t.column("block").to_numpy(), t.column("x")[0].as_py(), t.column("y")[0].as_py()
        ids, out = t.column("id").to_numpy(), []
        sizes = np.diff(t.column("v").combine_chunks().offsets.to_numpy())
        for size in np.unique(sizes):
            at, v = _vectors(t.column("v"), int(size))
            left, right = np.flatnonzero(own[at] == x), np.flatnonzero(own[at] == y)
            for lo in range(0, len(left), 512):
                part = left[lo:lo + 512]
                sim = v[part] @ v[right].T
                i, j = np.nonzero(sim >= least)
                a, b = ids[at[part[i]]], ids[at[right[j]]]
                fit = a < b if x == y else a != b
                out.append((np.minimum(a, b)[fit], np.maximum(a, b)[fit], sim[i, j][fit]))
        a, b, sim = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([*(pa.array([t.column(c)[0].as_py()] * len(a), t.schema.field(c).type) for c in keys), pa.array(a), pa.array(b), pa.array(sim)],
                        names=[*keys, "a", "b", "sim"])

    shape = ", ".join([*[f"{c} {kind[c]}" for c in keys], "a long", "b long", "sim double"])
    return met.groupBy(*keys, "x", "y").applyInArrow(meet, shape)


def degrees(df: DataFrame, linked: DataFrame, keys: list[str], tie: str = "id") -> DataFrame:
    """(keys, tie, n_links, best): each row's number of links and its greatest similarity, without the pairs themselves."""
    ends = linked.select(*keys, F.explode(F.array("a", "b")).alias(tie), "sim").groupBy(*keys, tie).agg(F.count("*").alias("n_links"), F.max("sim").alias("best"))
    return df.select(*keys, tie).join(ends, [*keys, tie], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))


def first_fit(df: DataFrame, linked: DataFrame, keys: list[str], tie: str = "id") -> DataFrame:
    """(keys, tie, cluster): in order of ``tie`` each row joins the first cluster with a row it links with, else founds one.

    A row's cluster is the smallest of its earlier partners' clusters, that is, the one of the smallest row that a
    falling chain of links reaches.  That row is found by rounds of joins over the links; each round also follows the
    row found so far, so chains shorten by half, and no group is folded in one task.
    """
    spark = df.sparkSession
    pairs = store.keep(linked.select(*keys, "a", "b"), "links")
    first = pairs.groupBy(*keys, F.col("b").alias(tie)).agg(F.min("a").alias("low"))
    now = store.keep(df.select(*keys, F.col(tie).cast("long").alias(tie)).join(first, [*keys, tie], "left").withColumn("low", F.coalesce("low", tie)), "reach")
    while True:
        of = now.select(*keys, F.col(tie).alias("a"), F.col("low").alias("via"))
        partner = pairs.join(of, [*keys, "a"]).groupBy(*keys, F.col("b").alias(tie)).agg(F.min("via").alias("far"))
        jump = of.withColumnRenamed("a", "low")
        best = now.join(jump, [*keys, "low"]).join(partner, [*keys, tie], "left").select(*keys, tie, F.col("low").alias("was"), F.least("via", F.coalesce("far", "via")).alias("low"))
        best = store.keep(best, "reach")
        if not best.where("was <> low").limit(1).count():
            break
        now = best.drop("was")
    founder = Window.partitionBy(*keys).orderBy(tie)
    number = now.where(F.col(tie) == F.col("low")).select(*keys, "low", (F.row_number().over(founder) - 1).cast("long").alias("cluster"))
    return now.join(number, [*keys, "low"]).select(*keys, tie, "cluster")
