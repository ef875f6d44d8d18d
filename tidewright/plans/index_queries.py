"""Searches through the index of inverted lists: every row whose id is divisible by 100 is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inverted, vectors
from ..registry import query
from .base import r6
from .search_queries import _queries
from .selection_queries import _vectors


@query("i03_index_search")
def i03_index(spark, sf):
    """As ``i03_ann_topk``, twice as many as wanted fetched, filtered and cut, but out of the lists that a query opens."""
    d = _vectors(spark, sf)
    index = inverted.build(d, 40, extra=["chapter"])
    hits = inverted.search(index, _queries(d), 40).where("chapter % 2 = 0")
    return vectors.again(hits, 20).select("query", F.col("id").alias("vec_id"), r6("score").alias("score"), "rank")


@query("i03_index_recall")
def i03_recall(spark, sf):
    """Per query how many of its 40 nearest rows the index finds, and how many lists of how many it opens."""
    d = _vectors(spark, sf)
    index = inverted.build(d, 40)
    want = vectors.search(_queries(d), d, 40).select("query", "id")
    found = inverted.search(index, _queries(d), 40).select("query", "id", F.lit(1).alias("hit"))
    return want.join(found, ["query", "id"], "left").groupBy("query").agg(
        F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumns(
        {"opened": F.lit(index.probes).cast("long"), "lists": F.lit(len(index.centroids)).cast("long")})
