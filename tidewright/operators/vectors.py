"""Vector similarity, filtered top-k search and reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

BLOCK, BATCH = 8192, 2048  # rows and queries that meet in one task


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; -1 where a vector is missing or zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(-1.0)


def normalise(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: F.lit(0.0)))


def top_k(docs: DataFrame, query: list[float], k: int, vector: str = "embedding", tie: str = "id") -> DataFrame:
    """The ``k`` nearest rows by cosine: an exact scan that keeps k rows per task. Filter before, so k rows remain."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = docs.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc(F.round("score", 9)), tie).limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), tie)).cast("long"))


def search(queries: DataFrame, docs: DataFrame, k: int, vector: str = "embedding", tie: str = "id", extra: list[str] | None = None) -> DataFrame:
    """(query, tie, extra, score, rank): for every row of ``queries`` the ``k`` nearest rows of ``docs`` by cosine, ties by ``tie``.

    Exact and in blocks: rows and queries are dealt by a hash into blocks of at most about ``BLOCK`` rows and ``BATCH``
    queries, every two blocks meet in a task of their own, and k rows per query and block go on.  Filter before or after.
    A missing or zero vector has the score -1.
    """
    extra = extra or []
    few = max(1, -(-queries.count() // BATCH))
    many = max(1, -(-docs.count() // BLOCK))
    kind = {n: t for n, t in docs.dtypes}
    unit = normalise(F.col(vector).cast("array<double>")).alias("v")
    d = docs.select(F.col(tie).alias("id"), *extra, unit, F.pmod(F.xxhash64(tie), F.lit(many)).cast("long").alias("db"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(few - 1).cast("long"))).alias("qb"))
    q = queries.select(F.col(tie).alias("query"), unit, F.pmod(F.xxhash64(tie), F.lit(few)).cast("long").alias("qb"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("db"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [left.column(c) for c in ("id", *extra)]
        if not left.num_rows or not right.num_rows:
            return pa.table([c.slice(0, 0) for c in cols] + [pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", *extra, "query", "score"])
        a, b = (_matrix(t.column("v")) for t in (left, right))
        ids, who = left.column("id").to_numpy(), right.column("query").to_numpy()
        size = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, size - x.shape[1]))) for x in (a, b))
        at, of, scores = [], [], []
        for lo in range(0, len(b), 256):
            s = b[lo:lo + 256] @ a.T
            s[~b[lo:lo + 256].any(axis=1)] = -1.0
            s[:, ~a.any(axis=1)] = -1.0
            for i, row in enumerate(np.round(s, 9)):
                some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                best = some[np.lexsort((ids[some], -row[some]))][:k]
                at.append(best)
                of.append(np.full(len(best), who[lo + i]))
                scores.append(s[i, best])
        at = np.concatenate(at)
        return pa.table([c.take(pa.array(at)) for c in cols] + [pa.array(np.concatenate(of)), pa.array(np.concatenate(scores))], names=["id", *extra, "query", "score"])

    shape = ", ".join([f"id {kind[tie]}", *[f"{c} {kind[c]}" for c in extra], "query long", "score double"])
    found = d.groupBy("db", "qb").cogroup(q.groupBy("db", "qb")).applyInArrow(nearest, shape)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).withColumnRenamed("id", tie)


def again(hits: DataFrame, k: int) -> DataFrame:
    """Hits of (query, id, score) ranked anew and cut, after a filter or another score."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def preset(docs: DataFrame, name: str, k: int, filters: dict) -> DataFrame:
    """The first ``k`` rows by time that pass the filters, with the name of the preset."""
    return docs.where(matches(filters)).orderBy("start", "id").limit(k).withColumn("preset", F.lit(name))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as the rows of a matrix, shorter ones filled up with zeros."""
    rows = [np.asarray(x.as_py() or [], np.float64) for x in column]
    out = np.zeros((len(rows), max(map(len, rows), default=0) or 1))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def matches(filters: dict) -> Column:
    """Predicate of a filter: ids; equal vod, mode, chapter, category; start in a range; overlap with a range; length bounds.

    Excluded rows go unless ``include_excluded``.
    """
    out = F.lit(True) if filters.get("include_excluded") else ~F.coalesce(F.col("excluded"), F.lit(False))
    for name in ("vod", "mode", "chapter", "category"):
        if filters.get(name) is not None:
            out = out & (F.col(name) == filters[name])
    if "ids" in filters:
        out = out & F.col("id").isin(list(filters["ids"]))
    if "start_in" in filters:
        out = out & F.col("start").between(*filters["start_in"])
    if "overlaps" in filters:
        lo, hi = filters["overlaps"]
        out = out & (F.col("end") > lo) & (F.col("start") < hi)
    length = F.col("end") - F.col("start")
    if "min_len" in filters:
        out = out & (length >= filters["min_len"])
    if "max_len" in filters:
        out = out & (length <= filters["max_len"])
    return out


def rerank(score: Column, query: str, doc: Column, keywords: Column, chat: Column, seconds: Column, mode: Column) -> Column:
    """0.4 vector, 0.3 word overlap, 0.2 keywords, 0.1 engagement."""
    terms = F.filter(F.split(F.lower(F.lit(query)), r"\s+"), lambda w: w != "")
    return (0.4 * score + 0.3 * text.text_overlap(F.lit(query), doc) + 0.2 * text.keyword_score(terms, keywords)
            + 0.1 * text.engagement_score(chat, seconds, mode))


def pairs(df: DataFrame, keys: list[str], time: str | None = None, reach: float = 0.0, vector: str = "embedding", tie: str = "id") -> DataFrame:
    """(keys, a, b, sim) of ordered pairs within a group; with ``time``, only of rows at most ``reach`` apart.

    The time bound makes this a bucketed join; without it groups must be small.
    """
    d = df.select(*keys, tie, vector, *([time] if time else []))
    if time:
        a = d.withColumn("_b", F.floor(F.col(time) / reach))
        b = d.withColumn("_b", F.explode(F.array(*[F.floor(F.col(time) / reach) + o for o in (-1, 0, 1)])))
        cond = (F.abs(F.col("x." + time) - F.col("y." + time)) <= reach) & (F.col("x._b") == F.col("y._b"))
    else:
        a, b, cond = d, d, F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    both = a.alias("x").join(b.alias("y"), cond & (F.col(f"x.{tie}") < F.col(f"y.{tie}")))
    return both.select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col(f"x.{tie}").alias("a"), F.col(f"y.{tie}").alias("b"),
                       cosine(F.col(f"x.{vector}"), F.col(f"y.{vector}")).alias("sim"))


def cluster_threshold(df: DataFrame, keys: list[str], order: str, least: float, vector: str = "embedding") -> DataFrame:
    """(keys, order, cluster): each row joins the first cluster with a member at least ``least`` similar, else founds one."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).alias("v"))))
    d = df.groupBy(*keys).agg(rows.alias("rows"))
    start = F.array().cast(f"array<struct<o:{dict(df.dtypes)[order]},v:{dict(df.dtypes)[vector]},c:int>>")

    def step(acc: Column, r: Column) -> Column:
        hit = F.array_min(F.transform(F.filter(acc, lambda a: cosine(a["v"], r["v"]) >= least), lambda a: a["c"]))
        new = F.coalesce(F.array_max(F.transform(acc, lambda a: a["c"])) + 1, F.lit(0))
        return F.concat(acc, F.array(F.struct(r["o"].alias("o"), r["v"].alias("v"), F.coalesce(hit, new).cast("int").alias("c"))))

    out = d.select(*keys, F.explode(F.aggregate("rows", start, step)).alias("r"))
    return out.select(*keys, F.col("r.o").alias(order), F.col("r.c").cast("long").alias("cluster"))


def coherence(clusters: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Share of clusters of two or more that have ``least`` members."""
    n = clusters.groupBy(*keys, "cluster").count().where("count >= 2")
    return n.groupBy(*keys).agg((F.count_if(F.col("count") >= least) / F.count("*")).alias("coherence"))


def range_similarity(sim: Column, dt: Column, same_topic: Column, tau: float = 600.0) -> Column:
    return 0.7 * (sim + 1) / 2 + 0.2 * F.exp(-dt / tau) + 0.1 * F.when(same_topic, 1.0).otherwise(0.0)
