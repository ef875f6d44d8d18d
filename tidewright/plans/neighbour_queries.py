"""Queries of rows around anchors, chapter threads, named chapters, arc spans and whole exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, neighbours, series
from ..registry import query
from ..sources import exports
from .base import BASE, r6, ranges, windows
from .export_queries import INDEX, SECTIONS, index
from .segment_queries import MERGED
from .selection_queries import threaded
from .series_queries import V

ANCHOR = BASE + """, an as (select *, row_number() over (partition by vod order by reactions desc, win) = 1 as anchor, count(*) over (partition by vod) as n from win),
 qs as (select vod, list_sort(list("end" - start)) as l from rng group by vod), qn as (select vod, 4 * l[floor(0.5 * (len(l) - 1))::int + 1] as least, 4 * l[floor(0.75 * (len(l) - 1))::int + 1] as most from qs),
 ax as (select vod, min(win) filter (anchor) as w from an group by vod)
"""


def anchored(spark, sf):
    """Windows with the most reacted one of each session marked, and the spans that suit its ranges."""
    best = F.row_number().over(Window.partitionBy("vod").orderBy(F.desc("reactions"), "win")) == 1
    d = ranges(spark, sf).withColumn("d", F.col("end") - F.col("start"))
    q = d.groupBy("vod").agg((4 * series.floor_quantile("d", 0.5)).alias("least"), (4 * series.floor_quantile("d", 0.75)).alias("most"))
    return windows(spark, sf).withColumn("anchor", best).join(q, "vod")


def _auto(side: str) -> str:
    sign, order = ("<", "desc") if side == "left" else (">", "asc")
    return ANCHOR + f""", s as (select an.vod, win, row_number() over v as place, coalesce(sum("end" - start) over (v rows between unbounded preceding and 1 preceding), 0) as used from an join ax on ax.vod = an.vod and win {sign} w
  window v as (partition by an.vod order by win {order})) select vod, win, place from s join qn using (vod) where used < least and used < most"""


@query("h26_lead_in_auto", _auto("left"))
def h26_auto(spark, sf):
    return neighbours.around(anchored(spark, sf), V, "win", "anchor", "left", least=F.col("least"), most=F.col("most")).select("vod", "win", "place")


@query("h26_cool_down", _auto("right"))
def h26_cool(spark, sf):
    return neighbours.around(anchored(spark, sf), V, "win", "anchor", "right", least=F.col("least"), most=F.col("most")).select("vod", "win", "place")


@query("h26_cool_down_k", ANCHOR + "select an.vod, win, row_number() over (partition by an.vod order by win) as place from an join ax on ax.vod = an.vod and win > w qualify place <= 3")
def h26_cool_k(spark, sf):
    return neighbours.around(anchored(spark, sf), V, "win", "anchor", "right", k=3).select("vod", "win", "place")


@query("h26_between", ANCHOR + """, b as (select vod, max(win) filter (energy = 'low' and win < 20) as a, min(win) filter (energy = 'high' and win > 25) as z from scored group by vod)
 select vod, win from win join b using (vod) where win > a and win < z""")
def h26_between(spark, sf):
    d = threaded(spark, sf).withColumns({"first": (F.col("energy") == "low") & (F.col("win") < 20), "second": (F.col("energy") == "high") & (F.col("win") > 25)})
    return neighbours.between(d, V, "win", "first", "second").select("vod", "win")


@query("h26_boundary", ANCHOR + """, r as (select vod, chapter, win, row_number() over (partition by vod, chapter order by win desc) as l, row_number() over (partition by vod, chapter order by win) as f from win),
 c as (select vod, chapter, lag(chapter) over (partition by vod order by chapter) as ended from (select distinct vod, chapter from win))
 select vod, chapter as ended, 'left' as side, win from r where l <= 3 union all select r.vod, c.ended, 'right', win from r join c on c.vod = r.vod and c.chapter = r.chapter where f <= 3 and c.ended is not null""")
def h26_boundary(spark, sf):
    return neighbours.boundary(windows(spark, sf), V, "chapter", "win")


@query("h30_topic_thread_global", BASE + """, h as (select *, case when win % 4 = 0 then null when win % 4 = 1 then true else topic = lag(topic) over (partition by vod order by win) end as hint from win),
 s as (select *, case when row_number() over (partition by vod order by win) = 1 then 1 when coalesce(hint, contains(topic, p) or contains(p, topic), false) then 0 else 1 end as step from (select *, lag(topic) over (partition by vod, chapter order by win) as p from h))
 select vod, win, (sum(step) over (partition by vod, chapter order by win))::bigint as thread from s""")
def h30(spark, sf):
    """Hints are missing for a quarter of the windows, and always yes for another."""
    same = F.col("topic") == F.lag("topic").over(Window.partitionBy("vod").orderBy("win"))
    d = windows(spark, sf).withColumn("hint", F.when(F.col("win") % 4 == 0, F.lit(None).cast("boolean")).when(F.col("win") % 4 == 1, True).otherwise(same))
    return neighbours.chapter_threads(d, V, "chapter", "win", "topic", "hint").select("vod", "win", "thread")


@query("j27_is_jc_named", MERGED.format(gap=120) + """, nm as (select unnest([0, 1, 2, 3]) as chapter, unnest(['Just_Chatting', 'irl', 'some_game', null]) as name),
 j as (select m.vod, m.start, count(distinct w.chapter) as n, min(w.chapter) as chapter from mg m join win w on w.vod = m.vod and w.start < m."end" and w."end" > m.start group by all)
 select vod, start, n = 1 and coalesce(lower(name) in ('just_chatting', 'irl'), false) as jc from j left join nm using (chapter)""")
def j27_named(spark, sf):
    """Arcs whose windows are all of one chapter that is named so in the list of chapters."""
    spark_names = spark.createDataFrame([(0, "Just_Chatting"), (1, "irl"), (2, "some_game"), (3, None)], "chapter long, name string")
    w = windows(spark, sf).select("vod", "chapter", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    d = intervals.overlap_join(intervals.merge_gap(ranges(spark, sf), V, 120.0), w, V, 3600.0).groupBy("vod", "start").agg(F.countDistinct("chapter").alias("n"), F.min("chapter").alias("chapter"))
    named = F.coalesce(F.lower("name").isin("just_chatting", "irl"), F.lit(False))
    return d.join(spark_names, "chapter", "left").select("vod", "start", ((F.col("n") == 1) & named).alias("jc"))


@query("j24_arc_spans", BASE + """, a as (select topic as arc_type, case when event_id % 3 = 0 then "end" + 20 end as resolution_end, "end" as climax_end, start from rng),
 d as (select arc_type, coalesce(resolution_end, climax_end + 60) - start as d from a) select arc_type, count(*) as n, sum(d) as total, round(avg(d), 6) as mean, round(count(*) / sum(count(*)) over (), 6) as share from d group by arc_type""")
def j24_spans(spark, sf):
    """An arc ends with its resolution, or a minute after its climax."""
    end = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("end") + 20), F.col("end") + 60)
    d = ranges(spark, sf).withColumn("d", end - F.col("start"))
    g = d.groupBy(F.col("topic").alias("arc_type")).agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.round(F.avg("d"), 6).alias("mean"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


# --- whole exports ---------------------------------------------------------------------------------------------------------------

FLOATS = ("chat_rate", "chat_rate_z", "burst_score", "role_confidence", "confidence")
FULL = SECTIONS + """, lx as (select t.*, s.section_id, c.name as named from th t join sn s on s.vod = t.vod and s.chapter = t.chapter and s.thread = t.thread
  left join (select unnest([0, 1, 2]) as chapter, unnest(['talk', ' ', 'game_one']) as name) c on c.chapter = t.chapter),
 fx as (select vod, id, start as start_time, "end" as end_time, "end" - start as duration, chapter as chapter_id, coalesce(nullif(trim(named), ''), topic) as category, mode, win % 13 = 0 as excluded, rate as chat_rate, z as chat_rate_z, burst as burst_score,
  reactions as reaction_hits, case when win % 2 = 0 then topic || ' at ' || win end as summary, topic, energy, role, confidence as role_confidence, same_prev as same_topic_prev, thread as topic_thread, lower(topic) as topic_key,
  case when same_prev then 'continues' end as link_type, case when same_prev then 'topic' end as link_evidence, confidence, section_id, 'Section ' || section_id[-3:] as section_title from lx)
"""


def full(spark, sf):
    t = threaded(spark, sf)
    s = t.groupBy("vod", "chapter", "thread").agg(F.min("start").alias("s"))
    n = F.row_number().over(Window.partitionBy("vod", "chapter").orderBy("s"))
    s = s.select("vod", "chapter", "thread", F.concat_ws(":", "vod", "chapter", F.lit("sec"), F.format_string("%03d", n)).alias("section_id"))
    names = spark.createDataFrame([(0, "talk"), (1, " "), (2, "game_one")], "chapter long, named string")
    same = F.col("same_prev")
    d = t.join(s, ["vod", "chapter", "thread"]).join(names, "chapter", "left").withColumns({
        "excluded": F.col("win") % 13 == 0, "summary": F.when(F.col("win") % 2 == 0, F.concat(F.col("topic"), F.lit(" at "), F.col("win"))), "topic_key": F.lower("topic"), "category": F.col("topic"),
        "link_type": F.when(same, "continues"), "link_evidence": F.when(same, "topic"), "section_title": F.concat(F.lit("Section "), F.substring("section_id", -3, 3))})
    return exports.whole(d, "named")


@query("a28_export_documents", FULL + "select * replace (" + ", ".join(f"round({c}, 6) as {c}" for c in FLOATS) + "), row_number() over (partition by vod order by start_time, id) as place from fx")
def a28_full(spark, sf):
    """Every column of the index, the category by the chapter's own name where it has one."""
    return full(spark, sf).withColumns({c: r6(c) for c in FLOATS})


@query("a28_export_statistics", FULL + """, k as (select vod, duration, unnest([{'kind': 'all', 'name': ''}, {'kind': 'category', 'name': category}, {'kind': 'mode', 'name': mode}, {'kind': 'chapter_id', 'name': chapter_id::varchar}]) as x,
  excluded, summary, chat_rate_z from fx) select vod, x.kind as kind, coalesce(x.name, 'unknown') as name, count(*) as n, sum(duration) as seconds, count(*) filter (excluded) as excluded, count(summary) as with_summary, count(chat_rate_z) as with_chat, avg(duration) as mean_seconds from k group by all""")
def a28_stats(spark, sf):
    return exports.whole_statistics(full(spark, sf), V, ["category", "mode", "chapter_id"])


@query("a30_export_rows", INDEX + """select vod, row_number() over (partition by vod order by start, id) as place, id, start, "end", duration, chapter, mode,
 case when length(coalesce(text, '')) > 200 then substr(text, 1, 200) || '...' else coalesce(text, '') end as text_preview, chat as chat_preview, 0.0::double as score from ex""")
def a30_rows(spark, sf):
    """The whole index as a search without a query finds it, up to ten thousand rows a session, in order of time."""
    d = exports.documents(index(spark, sf), V, 10000)
    return d.withColumn("place", F.row_number().over(Window.partitionBy("vod").orderBy("start", "id")).cast("long"))
