"""A vector index of inverted lists: k-means cells, several of which a query opens, with exact reranking.

:func:`build` fits centroids on a bounded sample (``SAMPLE`` rows, the driver
holds those and the centroids), assigns every row to its nearest centroid and
keeps the lists as a table.  How many lists a query has to open is measured on
the sample: as many as hold the share ``target`` of the nearest rows of sample
rows.  :func:`search` sends each query to the lists nearest to it and scores
their rows exactly by cosine; a list of more than ``BLOCK`` rows is cut into
blocks.  Rows move once whatever the number of queries, queries once per list.

Rows whose vector is null, empty, zero or has another length than most of the
sample's have no direction to index and are not found; queries without one find
nothing.  Equal scores (to nine digits) go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store

SAMPLE, LISTS, BLOCK, ROUNDS = 8192, 1024, 8192, 12


@dataclass
class Index:
    """Centroids (one row each, of norm one), how many lists a query opens, and the table (list, id, extra, v)."""

    centroids: np.ndarray
    probes: int
    rows: DataFrame
    sizes: dict[int, int]


def _vectors(column: pa.Array | pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows of norm one) of the lists that have the length d and are not zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.diff(offs) == d)
    x = np.nan_to_num(flat[offs[at][:, None] + np.arange(d)].astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    norm = np.linalg.norm(x, axis=1)
    return at[norm > 0], x[norm > 0] / norm[norm > 0, None]


def kmeans(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly drawn rows; a cell that runs empty takes the row that is farthest from its own."""
    centre = x[np.random.default_rng(0).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        score = x @ centre.T
        cell = score.argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, cell, x)
        empty = np.flatnonzero(np.linalg.norm(total, axis=1) < 1e-12)
        total[empty] = x[np.argsort(score[np.arange(len(x)), cell])[:len(empty)]]
        centre = total / np.linalg.norm(total, axis=1, keepdims=True)
    return centre


def lists_needed(x: np.ndarray, centre: np.ndarray, n: int, k: int, target: float) -> int:
    """How many lists, nearest first, hold ``target`` of the nearest rows of the first 512 rows of the sample."""
    few = min(512, len(x))
    score = x[:few] @ x.T
    score[np.arange(few), np.arange(few)] = -2
    near = min(len(x) - 1, max(5, -(-k * len(x) // n)))  # as deep in the sample as k is in the table
    if near < 1:
        return len(centre)
    best = np.argpartition(-score, near - 1, axis=1)[:, :near]
    place = (x[:few] @ centre.T).argsort(axis=1)[:, ::-1].argsort(axis=1)
    needed = np.take_along_axis(place, (x @ centre.T).argmax(axis=1)[best], axis=1)
    return int(np.quantile(needed, target, method="higher")) + 1


def build(docs: DataFrame, k: int, vector: str = "embedding", tie: str = "id", extra: list[str] | None = None, target: float = 0.97,
          sample: int = SAMPLE, lists: int | None = None) -> Index:
    """The index of all rows of ``docs`` for searches of ``k`` rows."""
    extra = extra or []
    some = docs.where(F.size(vector) > 0).orderBy(F.xxhash64(tie)).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    n = docs.count()
    sizes = np.diff(some.column("v").combine_chunks().offsets.to_numpy()) if len(some) else np.zeros(0, int)
    d = int(np.bincount(sizes).argmax()) if len(sizes) else 1
    x = _vectors(some.column("v"), d)[1] if len(sizes) else np.zeros((0, d))
    if len(x):
        count = min(lists or LISTS, max(1, round(n**0.5)), len(x))
        centre = kmeans(x, count)
        probes = min(count, lists_needed(x, centre, n, k, target))
    else:
        centre, probes = np.eye(1, d), 1
    kind = dict(docs.dtypes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = _vectors(b.column("v"), d)
            own = b.take(pa.array(at))
            yield pa.record_batch([pa.array((v @ centre.T).argmax(axis=1)), *own.columns], ["list", *b.schema.names])

    cols = docs.where(F.col(vector).isNotNull()).select(F.col(tie).cast("long").alias("id"), *extra, F.col(vector).alias("v"))
    shape = ", ".join(["list long", "id long", *[f"{c} {kind[c]}" for c in extra], f"v {kind[vector]}"])
    rows = store.keep(cols.mapInArrow(assign, shape).repartition("list").sortWithinPartitions("list"), "lists")
    return Index(centre, probes, rows, {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()})


def search(index: Index, queries: DataFrame, k: int, vector: str = "embedding", tie: str = "id", probes: int | None = None) -> DataFrame:
    """(query, id, extra, score, rank): for every row of ``queries`` the ``k`` nearest rows of the lists that it opens."""
    centre, opened, d = index.centroids, probes or index.probes, index.centroids.shape[1]
    blocks = {at: -(-n // BLOCK) for at, n in index.sizes.items()}
    extra = [c for c in index.rows.columns if c not in ("list", "id", "v")]
    kind = dict(index.rows.dtypes)
    spark = index.rows.sparkSession
    known = spark.createDataFrame(list(blocks.items()), "list long, blocks long")
    rows = index.rows.join(known, "list").select((F.col("list") * 2**24 + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("key"), F.lit(0).alias("kind"), "id", *extra, "v")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = _vectors(b.column("v"), d)
            for lo in range(0, len(at), 256):
                near = np.argsort(-(v[lo:lo + 256] @ centre.T), axis=1, kind="stable")[:, :opened]
                pairs = [(at[lo + i], c * 2**24 + j) for i, row in enumerate(near) for c in row.tolist() for j in range(blocks.get(c, 0))]
                if pairs:
                    who, key = (np.array(p) for p in zip(*pairs))
                    own = b.take(pa.array(who))
                    yield pa.record_batch([pa.array(key), pa.array(np.ones(len(key), np.int32)), own.column("id"), own.column("v")], ["key", "kind", "id", "v"])

    asks = queries.where(F.col(vector).isNotNull()).select(F.col(tie).cast("long").alias("id"), F.col(vector).cast(kind["v"]).alias("v")).mapInArrow(
        visit, f"key long, kind int, id long, v {kind['v']}")
    both = rows.unionByName(asks, allowMissingColumns=True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key, side = b.column("key").to_numpy(), b.column("kind").to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1
            for a, z in zip([0, *edge], [*edge, len(key)]):
                if now != key[a]:
                    now, parts, block = key[a], [], None
                if not side[a]:
                    parts.append(b.slice(a, z - a))
                elif parts or block:
                    if not block:
                        t = pa.Table.from_batches(parts).combine_chunks()
                        block, parts = (t, t.column("id").to_numpy(), _vectors(t.column("v"), d)[1]), []
                    for lo in range(a, z, 256):
                        yield _best(block, b.slice(lo, min(256, z - lo)))

    def _best(block: tuple, asks: pa.RecordBatch) -> pa.RecordBatch:
        t, ids, x = block
        score = np.round(_vectors(asks.column("v"), d)[1] @ x.T, 9)
        who, at = [], []
        for i, row in enumerate(score):
            some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
            best = some[np.lexsort((ids[some], -row[some]))][:k]
            who.append(np.full(len(best), i))
            at.append(best)
        who, at = np.concatenate(who), np.concatenate(at)
        return pa.record_batch([asks.column("id").take(pa.array(who)), pa.array(ids[at]), *(t.column(c).take(pa.array(at)).combine_chunks() for c in extra),
                                pa.array(score[who, at])], ["query", "id", *extra, "score"])

    shape = ", ".join(["query long", "id long", *[f"{c} {kind[c]}" for c in extra], "score double"])
    found = both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(meet, shape)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
