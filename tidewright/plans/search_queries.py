"""Vector searches: every row whose id is divisible by 100 is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import intervals, vectors
from ..registry import query
from .base import BASE, r6, table, windows
from .selection_queries import _vectors

EVERY = 100

SEARCH = f"""with q as (select vec_id as query, embedding::double[] as u from embeddings where vec_id % {EVERY} = 0),
 s as (select query, vec_id, label, list_cosine_similarity(embedding::double[], u) as score from embeddings, q),
"""
RANKED = "row_number() over (partition by query order by round(score, 9) desc, vec_id)"


def _queries(d):
    return d.where(F.col("id") % EVERY == 0)


@query("i03_ann_topk", SEARCH + f""" o as (select *, {RANKED} as r from s)
 select query, vec_id, round(score, 6) as score, row_number() over (partition by query order by r) as rank from o where r <= 40 and label % 2 = 0 qualify rank <= 20""")
def i03(spark, sf):
    """Twice as many as wanted are fetched, then filtered, then cut."""
    d = _vectors(spark, sf)
    hits = vectors.search(_queries(d), d, 40, extra=["chapter"]).where("chapter % 2 = 0")
    return vectors.again(hits, 20).select("query", F.col("id").alias("vec_id"), r6("score").alias("score"), "rank")


@query("i04_vector_topk", SEARCH + f" t as (select *, {RANKED} as rank from s where label = 3) select query, vec_id, round(score, 6) as score, rank from t where rank <= 10")
def i04(spark, sf):
    """The filter applies first, so ten rows remain."""
    d = _vectors(spark, sf)
    return vectors.search(_queries(d), d.where("chapter = 3"), 10).select("query", F.col("id").alias("vec_id"), r6("score").alias("score"), "rank")


@query("i07_search_rerank", SEARCH + r""" t as (select *, """ + RANKED + r""" as r from s),
 w as (select doc_id, n_chars, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as ws,
  list_distinct(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+')) as ts from documents),
 e as (select doc_id, len(list_intersect(['the', 'boss', 'fight'], ts)) / 3 as overlap, least(1.0, case when len(ws) > 10 then 0.3 when len(ws) > 5 then 0.2 else 0.1 end
  + case when n_chars between 30 and 300 then 0.2 when n_chars between 10 and 600 then 0.1 else 0.0 end + 0.1)::double as engaged from w),
 a as (select query, vec_id as id, round(0.4 * score + 0.3 * overlap + 0.1 * engaged, 6) as total from t join e on e.doc_id = t.vec_id where r <= 50)
 select query, id, total, row_number() over (partition by query order by total desc, id) as place from a qualify place <= 10""")
def i07(spark, sf):
    d = _vectors(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    s = vectors.rerank(F.col("score"), "the boss fight", F.col("text"), F.array().cast("array<string>"), F.col("text"), F.col("n_chars"), F.lit("jc"))
    out = vectors.search(_queries(d), d, 50).join(docs, "id").withColumn("total", r6(s))
    return vectors.again(out.select("query", "id", F.col("total").alias("score")), 10).select("query", "id", F.col("score").alias("total"), F.col("rank").alias("place"))


@query("i09_text_overlap", rf"""with q as (select item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as qw from benchmark),
 w as (select item_id, len(qw) as n, unnest(qw) as w from q), d as (select doc_id, unnest(list_distinct(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'))) as w from documents)
 select item_id, doc_id, round(count(*) / any_value(n), 6) as overlap from w join d using (w) group by item_id, doc_id having count(*) >= 0.5 * any_value(n)""")
def i09(spark, sf):
    """Pairs of items and documents that share at least half of the item's words; joined on words, so no text meets all others."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    return text.overlaps(items, table(spark, sf, "documents").select("doc_id", "text"), "item_id", "doc_id", 0.5).select("item_id", "doc_id", r6("overlap").alias("overlap"))


@query("i12_search_presets", BASE + """, m as (select *, (win % 50)::bigint as place from win)
 select 'time' as preset, id from (select id from win where start < 40000 and "end" > 30000 order by start, id limit 100) union all
 select 'chapter', id from (select id from win where vod = '2024-01-05' and chapter = 2 order by start, id limit 50) union all
 select 'by_id', id from win where id in ('2024-01-03:win:7', '2024-01-04:win:20')""")
def i12(spark, sf):
    d = windows(spark, sf).withColumn("excluded", F.lit(False))
    return vectors.preset(d, "time", 100, {"overlaps": (30000, 40000)}).unionByName(
        vectors.preset(d, "chapter", 50, {"vod": "2024-01-05", "chapter": 2})).unionByName(
        vectors.preset(d, "by_id", 1000, {"ids": ["2024-01-03:win:7", "2024-01-04:win:20"]})).select("preset", "id")


@query("i23_extended_search", SEARCH + """ x as (select query, vec_id, case when label < 5 then 'burst' else 'moment' end as kind, case when label < 5 then vec_id else vec_id + 1000000000 end as id, score from s),
 t as (select *, row_number() over (partition by query order by round(score, 9) desc, id) as rank from x) select query, kind, vec_id, round(score, 6) as score, rank from t where rank <= 15""")
def i23(spark, sf):
    """One search over two indexes: bursts (labels below 5) and moments, told apart by their ids."""
    d = _vectors(spark, sf)
    bursts = d.where("chapter < 5").select("id", "embedding", F.lit("burst").alias("kind"), F.col("id").alias("vec_id"))
    moments = d.where("chapter >= 5").select((F.col("id") + 1_000_000_000).alias("id"), "embedding", F.lit("moment").alias("kind"), F.col("id").alias("vec_id"))
    return vectors.search(_queries(d), bursts.unionByName(moments), 15, extra=["kind", "vec_id"]).select("query", "kind", "vec_id", r6("score").alias("score"), "rank")


@query("i24_query_to_ranges", BASE + ", " + SEARCH.removeprefix("with ") + f""" t as (select *, {RANKED} as r from s),
 h as (select query, w.vod, w.start, w."end" from t join win w on w.last_event = t.vec_id * 20 where r <= 200),
 o as (select *, max("end") over (partition by query, vod order by start rows between unbounded preceding and 1 preceding) as reach from h),
 b as (select *, sum(case when reach is null or start - reach > 3600 then 1 else 0 end) over (partition by query, vod order by start) as run from o)
 select query, vod, min(start) as start, max("end") as "end" from b group by query, vod, run""")
def i24(spark, sf):
    d = _vectors(spark, sf)
    hits = vectors.search(_queries(d), d, 200).select("query", (F.col("id") * 20).alias("last_event"))
    return intervals.merge_gap(windows(spark, sf).join(hits, "last_event"), ["query", "vod"], 3600.0)
