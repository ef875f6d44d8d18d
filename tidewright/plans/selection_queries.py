"""Queries of sections G, H, I and J: selection, grouping, vectors, arcs, and the flagship."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import arcs, grouping, intervals, select, series, similar, vectors
from ..registry import query
from .base import BASE, chat, r6, ranges, scored, table, windows
from .segment_queries import MERGED
from .series_queries import GATE, SAL, V, VC, salient


ONE = BASE + ", one as (select * from rng)\n"


@query("g01_seed_budget", BASE + """, l as (select vod, count(*) filter (mode = 'jc') / count(*) as share, max("end") - min(start) as dur,
 list_sort(list(reactions) filter (mode = 'jc')) as c, list_sort(list(reactions) filter (mode = 'game')) as g from win group by vod),
 t as (select *, least(24.0, greatest(4.0, round_even(greatest(3.0, round_even(dur * 0.12 / greatest(30.0, share * 55 + (1 - share) * 75), 0)) * 1.25, 0))) as total from l)
 select vod, greatest(1.0, round_even(total * share, 0))::bigint as k_chat, greatest(1.0, total - greatest(1.0, round_even(total * share, 0)))::bigint as k_game,
 greatest(2, coalesce(c[floor(0.85 * (len(c) - 1))::int + 1], 0))::bigint as min_chat, greatest(3, coalesce(g[floor(0.85 * (len(g) - 1))::int + 1], 0))::bigint as min_game from t""")
def g01(spark, sf):
    mode = F.when(F.col("mode") == "jc", "chat").otherwise("game")
    return select.seed_budget(windows(spark, sf), V, mode, F.col("reactions"))


TOPK = """, o as (select vod, list({'w': win, 's': start, 'r': reactions} order by reactions desc, start) as l from win where reactions >= 2 group by vod),
 tk as (select vod, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: case when len(a) < 8 and len(list_filter(a, lambda y: abs(y.s - x[1].s) < 5400)) = 0
   then list_concat(a, x) else a end) as r from o),
 tu as (select vod, unnest(r) as r, generate_subscripts(r, 1) as pos from tk)
"""


@query("g02_topk_spaced", BASE + TOPK + "select vod, pos, r.w as win, r.r as reactions from tu")
def g02(spark, sf):
    return select.topk_spaced(windows(spark, sf), V, "reactions", "start", 8, 2, 5400.0, ["win", "reactions"]).select("vod", "pos", "win", "reactions")


@query("g03_nms_iou", ONE + """, o as (select vod, list({'s': start, 'e': "end", 'c': score} order by score desc, start, "end") as l from one group by vod),
 k as (select vod, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: case when len(list_filter(a, lambda y:
   abs((y.s + y.e) * 0.5 - (x[1].s + x[1].e) * 0.5) < 1800 or (least(y.e, x[1].e) > greatest(y.s, x[1].s) and (least(y.e, x[1].e) - greatest(y.s, x[1].s))
    / ((y.e - y.s) + (x[1].e - x[1].s) - (least(y.e, x[1].e) - greatest(y.s, x[1].s))) >= 0.5))) = 0 then list_concat(a, x) else a end) as r from o),
 u as (select vod, unnest(r) as r from k) select vod, r.s as start, r.e as "end", r.c as score from u""")
def g03(spark, sf):
    return select.dedup_select(ranges(spark, sf), V, "score", 0.5, 1800.0, 0, ["score"]).select("vod", "start", "end", "score")


@query("g04_nms_start_order", ONE + """, o as (select vod, list({'s': start, 'e': "end", 'c': score} order by start, score desc, "end") as l from one group by vod),
 k as (select vod, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: case when len(list_filter(a, lambda y: least(y.e, x[1].e) > greatest(y.s, x[1].s))) = 0 then list_concat(a, x) else a end) as r from o),
 u as (select vod, unnest(r) as r from k) select vod, r.s as start, r.e as "end", r.c as score from u""")
def g04(spark, sf):
    return select.nms_start_order(ranges(spark, sf), V, "score").select("vod", "start", "end", "score")


@query("g05_suppress_dense_anchors", ONE + """, o as (select vod, list({'s': start, 'e': "end", 'c': score} order by start, "end", score) as l from one group by vod),
 k as (select vod, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: case when x[1].s - a[len(a)].e < 1200 then
   case when x[1].c > a[len(a)].c then list_concat(a[1:len(a)-1], x) else a end else list_concat(a, x) end) as r from o),
 u as (select vod, unnest(r) as r from k) select vod, r.s as start, r.e as "end", r.c as salience from u""")
def g05(spark, sf):
    return select.suppress_dense(ranges(spark, sf), V, "start", "end", "score", 1200.0)


@query("g06_event_nms")
def g06(spark, sf):
    d = ranges(spark, sf).withColumn("ts", F.col("end"))
    return select.event_nms(d, V, "ts", "score", ["event_id"], 20.0, 3600.0, 5.0).select("vod", "ts", "score", "event_id")


@query("g07_adaptive_anchor_cut", BASE + """, v as (select vod, list_sort(list(reactions)) as v, (max("end") - min(start)) / 60.0 as m from win group by vod),
 q as (select *, unnest([0.70, 0.75, 0.80, 0.85, 0.90]) as q from v), c as (select *, v[floor(q::double * (len(v) - 1))::int + 1] as cut from q),
 n as (select *, len(list_filter(v, lambda e: e >= cut)) as n from c), f as (select *, n >= greatest(1.0, m / 60 / 5 * 1.0) and n <= greatest(1.0, 3 * m / 60 / 5) as ok from n)
 select vod, coalesce(arg_min(cut, q) filter (ok), max(cut) filter (q = 0.80)) as cut from f group by vod""")
def g07(spark, sf):
    return select.adaptive_cut(windows(spark, sf), V, "reactions", (F.max("end") - F.min("start")) / 3600.0)


@query("g08_detect_anchors", SAL + """, a as (select *, avg(reactions) filter (reactions > 0) over p as mean from sal window p as (partition by vod, chapter))
 select vod, win, coalesce(reactions > 0 and reactions >= mean, false) as anchor from a
 where exists (select 1 from a b where b.vod = a.vod and b.chapter = a.chapter and b.reactions > 0)""")
def g08(spark, sf):
    d = salient(spark, sf).withColumn("_any", F.max("reactions").over(Window.partitionBy(*VC))).where("_any > 0")
    return select.detect_anchors(d, VC, "reactions", "salience", F.lit(True)).select("vod", "win", "anchor")


RATED = BASE + """, ra as (select id, vod, start, "end" - start as duration, 100 * (0.5 * least(1.0, burst / 8) + 0.3 * least(1.0, z / 6) + 0.2 * least(1.0, reactions / 30.0::double)) as hype,
 10 * confidence as c10, 10 * (win % 7) as n10 from scored), rt as (select *, greatest(hype, c10, n10) as rating from ra)
"""


def rated(spark, sf):
    x = select.arc_rating(F.col("burst"), F.col("z"), F.col("reactions"), F.col("confidence"), F.col("win") % 7)
    return scored(spark, sf).withColumn("x", x).select("id", "vod", "start", "end", (F.col("end") - F.col("start")).alias("duration"),
                                                       F.col("x.hype").alias("hype"), F.col("x.rating").alias("rating"), "win")


@query("g09_arc_rating", RATED + "select id, round(hype, 5) as hype, round(rating, 5) as rating from rt")
def g09(spark, sf):
    return rated(spark, sf).select("id", F.round("hype", 5).alias("hype"), F.round("rating", 5).alias("rating"))


@query("g10_rank_arcs", RATED + "select id, row_number() over (partition by vod order by round(rating, 6) desc, start) as rank from rt")
def g10(spark, sf):
    d = rated(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("vod").orderBy(F.desc(r6("rating")), "start")))
    return d.select("id", F.col("rank").cast("long").alias("rank"))


@query("g11_select_arcs", RATED + "select id, rank from (select id, row_number() over (partition by vod order by rating desc, start) as rank from (select id, vod, start, round(rating, 6) as rating from rt) where rating >= 20) where rank <= 5")
def g11(spark, sf):
    d = rated(spark, sf).withColumn("rating", r6("rating"))
    return select.select_arcs(d, V, 0.0, 1e9, 20.0, 5).select("id", "rank")


@query("g12_filter_arcs", RATED + "select id from rt where duration between 300 and 5400 and rating >= 25 and hype >= 10")
def g12(spark, sf):
    return rated(spark, sf).where("duration between 300 and 5400 and rating >= 25 and hype >= 10").select("id")


@query("g13_dedup_arcs", ONE + """, o as (select vod, list({'s': start, 'e': "end", 'r': event_id % 2 = 0, 'c': score} order by start, "end", event_id % 2 = 0, score) as l from one group by vod),
 k as (select vod, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: case when list_position(list_transform(a, lambda y: abs(y.s - x[1].s) < 120 or
    least(y.e, x[1].e) - greatest(y.s, x[1].s) > 0.5 * least(y.e - y.s, x[1].e - x[1].s)), true) is null or list_position(list_transform(a, lambda y: abs(y.s - x[1].s) < 120 or
    least(y.e, x[1].e) - greatest(y.s, x[1].s) > 0.5 * least(y.e - y.s, x[1].e - x[1].s)), true) = 0 then list_concat(a, x)
   else list_transform(a, lambda y, i: case when i = list_position(list_transform(a, lambda q: abs(q.s - x[1].s) < 120 or least(q.e, x[1].e) - greatest(q.s, x[1].s) > 0.5 * least(q.e - q.s, x[1].e - x[1].s)), true)
     and ((x[1].r and not y.r) or (x[1].r = y.r and x[1].c > y.c)) then x[1] else y end) end) as r from o),
 u as (select vod, unnest(r) as r from k) select vod, r.s as start, r.e as "end", r.r as resolved, r.c as confidence from u""")
def g13(spark, sf):
    d = ranges(spark, sf).withColumns({"resolved": F.col("event_id") % 2 == 0, "confidence": F.col("score")})
    return select.dedup_arcs(d, V)


@query("g14_anchor_center", BASE + """select vod, topic, arg_max((start + "end") / 2, reactions * 1000 - win) as centre from win group by all""")
def g14(spark, sf):
    return windows(spark, sf).groupBy("vod", "topic").agg(
        F.max_by((F.col("start") + F.col("end")) / 2, F.struct("reactions", -F.col("win"))).alias("centre"))


@query("g18_topn", BASE + "select event_id, value from chat order by value desc, event_id limit 25")
def g18(spark, sf):
    return chat(spark, sf).orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "value")


# --- H: grouping -----------------------------------------------------------------------------------------------------------------

@query("h01_build_reaction_arcs", BASE + """, l as (select vod, list({'s': start, 'e': "end", 'r': reactions, 'n': 1::bigint} order by start) as l from win where reactions > 0 group by vod),
 k as (select vod, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: case when x[1].s - a[len(a)].e <= 40 and x[1].e - a[len(a)].s <= 9000
  then list_append(a[1:len(a)-1], {'s': a[len(a)].s, 'e': x[1].e, 'r': a[len(a)].r + x[1].r, 'n': a[len(a)].n + 1}) else list_concat(a, x) end) as r from l),
 u as (select vod, unnest(r) as r from k) select vod, r.s as start, r.e as "end", r.r as reactions, r.n as n from u""")
def h01(spark, sf):
    d = windows(spark, sf).where("reactions > 0")
    return grouping.reaction_arcs(d, V, 40.0, 9000.0).select("vod", "start", "end", "reactions", "n")


THREAD = BASE + """, sp as (select *, coalesce(topic = lag(topic) over (partition by vod order by win), false) as same_prev from scored),
 th as (select *, (sum(case when same_prev then 0 else 1 end) over (partition by vod order by win))::bigint as thread from sp)
"""


def threaded(spark, sf):
    d = scored(spark, sf).withColumn("same_prev", F.coalesce(F.col("topic") == F.lag("topic").over(Window.partitionBy("vod").orderBy("win")), F.lit(False)))
    return grouping.topic_thread(d, V, "win", F.col("same_prev"))


@query("h02_extend_by_thread", THREAD + """select t.vod, t.win, min(o.start) as lo, max(o."end") as hi from th t join th o on t.vod = o.vod and t.thread = o.thread where t.energy = 'high' group by all""")
def h02(spark, sf):
    d = threaded(spark, sf)
    seeds = d.where("energy = 'high'").select("vod", "win")
    return grouping.extend_by_thread(d, seeds, V, "win", "thread", "same_prev")


@query("h06_merge_chunk", THREAD + """select vod, thread, min(start) as start, max("end") as "end", case max(case energy when 'high' then 2 when 'low' then 0 else 1 end) when 2 then 'high' when 0 then 'low' else 'medium' end as energy,
 sum(reactions)::bigint as reactions, round(max(z), 6) as z, count(*) as n, substr(string_agg(topic, ' ' order by start), 1, 140) as summary, any_value(topic) as topic from th group by vod, thread""")
def h06(spark, sf):
    d = threaded(spark, sf).withColumn("summary", F.col("topic"))
    return grouping.merge_chunk(d, ["vod", "thread"]).select("vod", "thread", "start", "end", "energy", F.col("reactions").cast("long").alias("reactions"),
                                                            r6("z").alias("z"), "n", "summary", "topic")


@query("h07_keep_gameplay", BASE + "select vod, win, reactions >= 4 or role in ('peak', 'conflict', 'resolution') as keep from scored")
def h07(spark, sf):
    return scored(spark, sf).select("vod", "win", grouping.keep_gameplay(F.col("reactions") >= 4, F.col("role")).alias("keep"))


@query("h08_keep_jc", BASE + """select vod, win, case when win % 3 = 0 then 'afk' else '' end not in ('afk', 'tech_issue') or z > 0.3 or reactions > 3 or energy = 'high' as keep from scored""")
def h08(spark, sf):
    role = F.when(F.col("win") % 3 == 0, "afk").otherwise("")
    return scored(spark, sf).select("vod", "win", grouping.keep_talk(role, F.col("z"), F.lit(0.0), F.greatest(F.lit(0), F.col("reactions") - 3), F.col("energy")).alias("keep"))


KEEP = THREAD + """, kp as (select *, energy = 'high' as keep, max("end") over (partition by vod) as fin from th)
"""


def kept(spark, sf):
    return threaded(spark, sf).withColumn("keep", F.col("energy") == "high")


@query("h11_context_wrap", KEEP + """, a as (select *, keep or coalesce(lead(keep) over w and lead(same_prev) over w, false) as k from kp window w as (partition by vod order by win))
 select vod, win, max(k) over (partition by vod, thread order by win rows between unbounded preceding and current row) as keep from a""")
def h11(spark, sf):
    return grouping.context_wrap(kept(spark, sf), V, "win", "keep", "role", "same_prev").select("vod", "win", "keep")


@query("h15_salience_guard", KEEP + "select vod, win, keep from kp")
def h15(spark, sf):
    return grouping.salience_guard(kept(spark, sf), "keep").select("vod", "win", "keep")


@query("h16_drop_loners", KEEP + """, l as (select vod, list_sort(list(burst)) as v from kp group by vod),
 a as (select k.*, v[floor(0.5 * (len(v) - 1))::int + 1] as m, not coalesce(lag(keep) over w, false) and not coalesce(lead(keep) over w, false) as alone from kp k join l using (vod) window w as (partition by vod order by win))
 select vod, win, keep and not (alone and reactions = 0 and burst < m) as keep from a""")
def h16(spark, sf):
    d = kept(spark, sf).withColumn("imp", F.lit(False))
    return grouping.drop_loners(d, V, "win", "keep", "imp", "reactions", "burst", 1800.0).select("vod", "win", "keep")


BLOCK = KEEP + """, m as (select *, case when start - lag("end") over (partition by vod, keep order by start) > 3600 or lag("end") over (partition by vod, keep order by start) is null then 1 else 0 end as b from kp),
 pb as (select *, case when keep then printf('PB-%03d', sum(b) over (partition by vod, keep order by start)) end as block from m)
"""


@query("h17_peak_blocks", BLOCK + "select vod, win, block from pb")
def h17(spark, sf):
    return grouping.peak_blocks(kept(spark, sf), V, F.col("keep"), F.lit(3600.0)).select("vod", "win", "block")


@query("h19_peak_blocks_fallback", KEEP + """, m as (select *, case when keep and not coalesce(lag(keep) over (partition by vod order by start), false) then 1 else 0 end as b from kp)
 select vod, win, case when keep then printf('PB-%03d', sum(b) over (partition by vod order by start)) end as block from m""")
def h19(spark, sf):
    return grouping.kept_runs(kept(spark, sf), V, "keep").select("vod", "win", "block")


@query("h20_flatten_manifest", BLOCK + """, k as (select * from pb where keep), r as (select *, case when block = lag(block) over w and start - lag("end") over w <= 1800 then 0 else 1 end as nb from k window w as (partition by vod order by start)),
 s as (select *, sum(nb) over (partition by vod order by start) as range from r)
 select vod, min(start) as start, max("end") as "end", count(*) as n from s group by vod, range""")
def h20(spark, sf):
    d = grouping.peak_blocks(kept(spark, sf), V, F.col("keep"), F.lit(3600.0))
    return grouping.flatten(d, V, "keep", 1800.0, True).select("vod", "start", "end", F.size("burst_ids").cast("long").alias("n"))


@query("h22_range_stats", BASE + """select r.event_id, round(avg(greatest(0.0, z)), 6) as avg_z, coalesce(bool_or(role = 'peak'), false) as has_peak, coalesce(bool_or(role = 'conflict'), false) as has_conflict
 from rng r join scored w on r.vod = w.vod and w.start < r."end" and w."end" > r.start group by r.event_id""")
def h22(spark, sf):
    d = ranges(spark, sf)
    s = grouping.range_stats(d, scored(spark, sf), V, 1800.0)
    return d.select("event_id", "vod", "start", "end").join(s, ["vod", "start", "end"]).select("event_id", r6("avg_z").alias("avg_z"), "has_peak", "has_conflict")


@query("h23_buildup_start", ONE + """select o.event_id, coalesce(least(min(w.start) filter (w.z <= 0.35 * 1.0), min(w.start) filter (w.role in ('build_up', 'conflict'))), o.start) as buildup
 from one o left join scored w on w.vod = o.vod and w.start < o.start and w.start >= o.start - 7200 group by o.event_id, o.start""")
def h23(spark, sf):
    d = ranges(spark, sf).withColumn("peak_z", F.lit(1.0))
    return grouping.buildup_start(d, scored(spark, sf), V, 7200.0).select("event_id", "buildup")


@query("h25_group_by_chapter", BASE + "select vod, chapter, count(*) as n, min(win) as first from win group by all")
def h25(spark, sf):
    return windows(spark, sf).groupBy(*VC).agg(F.count("*").alias("n"), F.min("win").alias("first"))


@query("h26_lead_in", BASE + """, d as (select vod, win, sum("end" - start) over (partition by vod order by start desc) as used from win where start < 43200) select vod, win from d where used <= 9000""")
def h26(spark, sf):
    return grouping.lead_in(windows(spark, sf), V, "start", F.lit(43200.0), F.lit(9000.0)).select("vod", "win")


@query("h27_auto_window", BASE + """, l as (select vod, list_sort(list("end" - start)) as v from rng group by vod) select vod, v[floor(0.5 * (len(v) - 1))::int + 1] as before, v[floor(0.75 * (len(v) - 1))::int + 1] as after from l""")
def h27(spark, sf):
    d = ranges(spark, sf).withColumn("d", F.col("end") - F.col("start"))
    return d.groupBy("vod").agg(series.floor_quantile("d", 0.5).alias("before"), series.floor_quantile("d", 0.75).alias("after"))


@query("h28_title_sequence", ONE + """, m as (select *, case when start - lag("end") over (partition by vod order by start, event_id) <= 600 then 0 else 1 end as b from one),
 r as (select *, sum(b) over (partition by vod order by start, event_id) as run from m), n as (select *, row_number() over g as n, first_value(topic) over g as first from r window g as (partition by vod, run order by start, event_id))
 select event_id, case when n = 1 then topic else first || ' ' || n end as title from n""")
def h28(spark, sf):
    return grouping.title_numbers(ranges(spark, sf).withColumn("title", F.col("topic")), V, 600.0, ("start", "event_id")).select("event_id", "title")


@query("h29_topic_thread", """with c as (select conv_id, turn, role, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as b from conversations
 where conv_id is not null and turn is not null qualify count(*) over (partition by conv_id, turn) = 1) select conv_id, turn, sum(b) over (partition by conv_id order by turn)::bigint as thread from c""")
def h29(spark, sf):
    c = table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    c = c.withColumn("_n", F.count("*").over(Window.partitionBy("conv_id", "turn")))
    c = c.withColumn("same", F.col("role") == F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))).where("_n = 1")
    return grouping.topic_thread(c, ["conv_id"], "turn", F.col("same")).select("conv_id", "turn", "thread")


@query("h31_recent_keys")
def h31(spark, sf):
    return windows(spark, sf).select("vod", "win", F.array_join(grouping.recent_keys("topic", VC, "win"), ",").alias("recent"))


@query("h34_median_box", "with b as (select conv_id % 20 as g, turn as x, length(text) as y from conversations), l as (select g, list_sort(list(x)) as x, list_sort(list(y)) as y from b group by g) select g, x[len(x) // 2 + 1] as x, y[len(y) // 2 + 1]::bigint as y from l")
def h34(spark, sf):
    b = table(spark, sf, "conversations").select((F.col("conv_id") % 20).alias("g"), F.col("turn").alias("x"), F.length("text").cast("long").alias("y"),
                                                 F.lit(1).alias("w"), F.lit(1).alias("h"))
    return grouping.median_box(b, ["g"]).select("g", "x", "y")


# --- I: vectors ------------------------------------------------------------------------------------------------------------------

def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("chapter"))


@query("i02_cosine_pairs", """select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim
 from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id and b.vec_id - a.vec_id <= 60""")
def i02(spark, sf):
    """Rows of a chapter at most 60 places apart, so pairs grow with the rows and not with their square."""
    d = _vectors(spark, sf).withColumn("t", F.col("id").cast("double"))
    return vectors.pairs(d, ["chapter"], "t", 60.0).select("a", "b", r6("sim").alias("sim"))


@query("i05_metadata_filter", BASE + """select id from win where mode = 'game' and start between 20000 and 60000 and vod = '2024-01-05'""")
def i05(spark, sf):
    d = windows(spark, sf).withColumn("excluded", F.lit(False))
    return d.where(vectors.matches({"mode": "game", "vod": "2024-01-05", "start_in": (20000, 60000)})).select("id")


@query("i06_advanced_filter", BASE + """select event_id from rng where "end" > 30000 and start < 40000 and "end" - start between 120 and 900 and event_id % 4 <> 0""")
def i06(spark, sf):
    d = ranges(spark, sf).withColumn("excluded", F.col("event_id") % 4 == 0)
    return d.where(vectors.matches({"overlaps": (30000, 40000), "min_len": 120, "max_len": 900})).select("event_id")


@query("i11_engagement_score", """select doc_id, round(least(1.0, case when n > 10 then 0.3 when n > 5 then 0.2 else 0.1 end + case when c between 30 and 300 then 0.2 when c between 10 and 600 then 0.1 else 0.0 end
 + case when lang = 'en' then 0.1 else 0.0 end)::double, 6) as score from (select doc_id, lang, n_chars as c, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) as n from documents)""")
def i11(spark, sf):
    mode = F.when(F.col("lang") == "en", "jc").otherwise("game")
    return table(spark, sf, "documents").select("doc_id", r6(text.engagement_score(F.col("text"), F.col("n_chars"), mode)).alias("score"))


@query("i08_rerank_score")
def i08(spark, sf):
    d = table(spark, sf, "documents").withColumn("keys", text.extract_keywords(F.col("text")))
    s = vectors.rerank(F.lit(0.5), "the boss fight", F.col("text"), F.col("keys"), F.col("text"), F.col("n_chars"), F.lit("jc"))
    return d.select("doc_id", r6(s).alias("score"))


LINKED = 0.3


def linked(spark, sf):
    """The pairs of a chapter's rows whose cosine reaches the threshold."""
    return similar.links(_vectors(spark, sf), ["chapter"], LINKED)


@query("i13_pairwise_matrix", f"""with p as (select a.label as chapter, a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as sim
  from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id)
 select label as chapter, vec_id as id, count(b) as n_links, round(max(sim), 6) as best from embeddings left join p on p.a = vec_id and sim >= {LINKED} group by all""")
def i13(spark, sf):
    """The matrix of whole chapters above the threshold, told per row: its links and the nearest of them."""
    d = _vectors(spark, sf)
    return similar.degrees(d, linked(spark, sf), ["chapter"]).select("chapter", "id", "n_links", r6("best").alias("best"))


CLUSTER = f"""with recursive ls as (select label, list(vec_id order by vec_id) as ids, list(embedding::double[] order by vec_id) as vs, count(*) as n from embeddings group by all),
 f as (select label, 0::bigint as i, cast([] as bigint[]) as cs from ls union all
  select label, i + 1, list_append(cs, coalesce(list_min(list_filter(cs, lambda c, j: list_cosine_similarity(vs[j], vs[i + 1]) >= {LINKED})), list_max(cs) + 1, 0)) from f join ls using (label) where i < n),
 cl as (select label as chapter, unnest(ids) as id, unnest(cs) as cluster from f join ls using (label) where i = n)
"""


def clusters(spark, sf):
    return similar.first_fit(_vectors(spark, sf), linked(spark, sf), ["chapter"])


@query("i14_cluster_threshold", CLUSTER + "select chapter, id, cluster from cl")
def i14(spark, sf):
    return clusters(spark, sf)


@query("i16_coherence", CLUSTER + """select chapter, count(*) filter (n >= 3) / count(*) as coherence from (select chapter, cluster, count(*) as n from cl group by all having count(*) >= 2) group by all""")
def i16(spark, sf):
    return vectors.coherence(clusters(spark, sf), ["chapter"])


@query("i20_topic_sim", BASE + """select vod, win, case when p is null then 0.0 when p = topic then 1.0 else 0.0 end::double as sim from (select vod, win, topic, lag(topic) over (partition by vod order by win) as p from win)""")
def i20(spark, sf):
    d = windows(spark, sf).withColumn("p", F.lag("topic").over(Window.partitionBy("vod").orderBy("win")))
    return d.select("vod", "win", F.when(F.col("p").isNull(), 0.0).otherwise(text.topic_sim(F.col("p"), F.col("topic"))).alias("sim"))


@query("i26_index_stats", "select count(*) as n, max(len(embedding))::bigint as dim, count(distinct label) as chapters from embeddings")
def i26(spark, sf):
    return _vectors(spark, sf).agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"), F.countDistinct("chapter").alias("chapters"))


# --- J: arcs ---------------------------------------------------------------------------------------------------------------------

@query("j03_thread_arcs", THREAD + """, a as (select vod, thread, min(start) as start, max("end") as "end", count(*) as n from th group by all) select vod, thread::bigint as thread, start, "end", n from a where "end" - start >= 0.8 * 3600 and "end" - start <= 1.3 * 9000""")
def j03(spark, sf):
    return arcs.thread_arcs(threaded(spark, sf), V, "thread", 3600.0, 9000.0).select("vod", "thread", "start", "end", "n")


@query("j04_chapter_round_arcs", BASE + """, a as (select vod, chapter, min(start) as start, max("end") as "end", bool_or(role = 'peak' or (z >= 0.6 and energy = 'high')) as p, bool_or(role = 'conflict' or energy = 'low') as c from scored group by all)
 select vod, chapter, start, "end" from a where p and c and "end" - start >= 0.7 * 7200 and "end" - start <= 1.5 * 21600""")
def j04(spark, sf):
    peak = arcs.is_peak_like(F.col("role"), F.col("z"), F.col("energy"))
    return arcs.chapter_arcs(scored(spark, sf), V, "chapter", 7200.0, 21600.0, peak, (F.col("role") == "conflict") | (F.col("energy") == "low")).select("vod", "chapter", "start", "end")


@query("j05_peak_like", BASE + "select vod, win, role = 'peak' or (z >= 0.6 and energy = 'high') as peak from scored")
def j05(spark, sf):
    return scored(spark, sf).select("vod", "win", arcs.is_peak_like(F.col("role"), F.col("z"), F.col("energy")).alias("peak"))


@query("j06_role_nearby", BASE + "select vod, win, coalesce(bool_or(role in ('peak', 'conflict')) over (partition by vod order by win rows between 2 preceding and 3 following), false) as near from scored")
def j06(spark, sf):
    return scored(spark, sf).select("vod", "win", arcs.role_nearby("role", ["peak", "conflict"], V, "win", -2, 3).alias("near"))


@query("j11_switch_penalty", BASE + """, s as (select vod, case when topic <> lag(topic) over (partition by vod order by start) then 1 else 0 end as s from win)
 select vod, round(least(0.4, sum(s) / greatest(1, count(*) - 1)), 6) as penalty from s group by vod""")
def j11(spark, sf):
    return arcs.switch_penalty(windows(spark, sf), V, "topic", "start").select("vod", r6("penalty").alias("penalty"))


MEASURES = THREAD + """, n as (select vod, chapter, count(*) as n, max("end") - min(start) as span, sum("end" - start) as total, coalesce(bool_or(role = 'peak' or (z >= 0.6 and energy = 'high')), false) as peak,
 coalesce(bool_or(role in ('resolution', 'conflict')), false) as closing, max(z) as max_z, bool_or(energy = 'high') as high from th group by all),
 t as (select vod, chapter, max(k) as top_thread from (select vod, chapter, thread, count(*) as k from th group by all) group by all),
 sw as (select vod, chapter, least(0.4, sum(s) / greatest(1, count(*) - 1)) as penalty from (select vod, chapter, case when topic <> lag(topic) over (partition by vod, chapter order by start) then 1 else 0 end as s from th) group by all),
 ms as (select n.*, penalty, greatest(0.0, least(1.0, total / span)) as contiguity, case when peak and closing then 1.0 when top_thread >= 0.7 * n then 0.7 else 0.6 end as structure,
  greatest(0.0, least(1.0, max_z)) + case when high then 0.1 else 0.0 end as signal from n join t using (vod, chapter) join sw using (vod, chapter))
"""


def measured(spark, sf):
    return arcs.arc_measures(threaded(spark, sf).withColumn("chapter_", F.col("chapter")), VC)


@query("j07_contiguity", MEASURES + "select vod, chapter, round(contiguity, 6) as contiguity from ms")
def j07(spark, sf):
    return measured(spark, sf).select("vod", "chapter", r6("contiguity").alias("contiguity"))


@query("j08_structure", MEASURES + "select vod, chapter, structure::double as structure from ms")
def j08(spark, sf):
    return measured(spark, sf).select("vod", "chapter", "structure")


@query("j09_signal", MEASURES + "select vod, chapter, round(signal, 6) as signal from ms")
def j09(spark, sf):
    return measured(spark, sf).select("vod", "chapter", r6("signal").alias("signal"))


@query("j14_span_total_gap", BASE + """, g as (select vod, chapter, start, "end", greatest(0.0, lead(start) over (partition by vod, chapter order by start) - "end") as gap from win)
 select vod, chapter, max("end") - min(start) as span, sum("end" - start) as total, coalesce(max(gap), 0.0) as max_gap from g group by all""")
def j14(spark, sf):
    return intervals.shape_stats(windows(spark, sf), VC).select("vod", "chapter", "span", "total", "max_gap")


TOKENS = ("gg", "lol", "ez", "om", "unknown")


def resolutions(spark, sf):
    c = chat(spark, sf).withColumn("win", F.floor(F.col("sec") / 1800))
    token = F.element_at(F.array(*map(F.lit, TOKENS)), (F.col("event_id") % 5 + 1).cast("int"))
    hits = c.groupBy("vod", "win", token.alias("t")).count().groupBy("vod", "win").agg(
        F.map_from_entries(F.collect_list(F.struct("t", F.col("count").cast("int")))).alias("hits"))
    return arcs.resolution_candidates(scored(spark, sf).join(hits, ["vod", "win"]), VC, "hits", "z", "burst")


RES = BASE + """, tk as (select vod, sec // 1800 as win, ['gg', 'lol', 'ez', 'om', 'unknown'][event_id % 5 + 1] as t, count(*) as c from chat group by all),
 cf as (select *, case t when 'gg' then 0.95 when 'ez' then 0.75 when 'om' then 0.75 when 'lol' then 0.01 else 0.5 end as k from tk),
 sm as (select vod, win, sum(k * least(3.0, c)) as s, bool_or(k >= 0.75) as sure from cf group by all),
 rc as (select s.vod, s.chapter, s."end" as ts, (m.s + case when z >= 0.6 then 0.2 else 0 end + case when burst >= 1.3 then 0.2 else 0 end)::double as score, sure from scored s join sm m using (vod, win)),
 rs as (select vod, chapter, ts, score from rc where score > 0 and (sure or score >= 1.2))
"""


@query("j16_resolution_events", RES + "select vod, chapter, ts, round(score, 6) as score from rs")
def j16(spark, sf):
    return resolutions(spark, sf).select("vod", "chapter", "ts", r6("score").alias("score"))


@query("j15_token_confidence", "select unnest(['gg', 'lol', 'ez', 'om', 'unknown']) as token, unnest([0.95, 0.01, 0.75, 0.75, 0.5])::double as confidence")
def j15(spark, sf):
    d = spark.createDataFrame([(t,) for t in TOKENS], "token string")
    return d.select("token", text.token_confidence(F.col("token")).alias("confidence"))


@query("j17_apply_resolution", RES + """, j as (select r.event_id, r.start, r."end", max(struct_pack(s := round(e.score, 9), t := ts)) as b from rng r join rs e on e.vod = r.vod and ts <= r."end" and ts >= r.start
  and ts >= r."end" - greatest(120.0, 0.5 * (r."end" - r.start)) and ts >= r.start + 0.6 * (r."end" - r.start) group by all) select event_id, b.t as resolution_ts from j""")
def j17(spark, sf):
    e = resolutions(spark, sf).withColumn("score", F.round("score", 9))
    d = arcs.apply_resolution(ranges(spark, sf), e, V)
    return d.where("has_resolution").select("event_id", "resolution_ts")


@query("j18_reason_score", RES + """select vod, win, round(sum(case t when 'gg' then 0.95 when 'ez' then 0.75 when 'om' then 0.45 else 0.0 end)::double, 6) as score from (select distinct vod, win, t from tk) group by all""")
def j18(spark, sf):
    c = chat(spark, sf).withColumn("win", F.floor(F.col("sec") / 1800))
    token = F.element_at(F.array(*map(F.lit, TOKENS)), (F.col("event_id") % 5 + 1).cast("int"))
    return c.groupBy("vod", "win").agg(F.collect_set(token).alias("r")).select("vod", "win", r6(text.reason_score(F.col("r"))).alias("score"))


@query("j19_resolution_quality", RES + """, g as (select *, ts - lag(ts) over (partition by vod, chapter order by ts) as gap from rs where round(score, 9) >= 2), a as (select vod, chapter, count(*) as n, avg(gap) as gap, min(gap) as least from g group by all)
 select vod, chapter, n, case when gap < 180 and least < 90 then greatest(2, ceil(n / 2.0)) else n end::bigint as kept, case when gap < 180 and least < 90 then greatest(2, ceil(n / 2.0)) else n end >= 2 as round_based from a""")
def j19(spark, sf):
    return arcs.resolution_quality(resolutions(spark, sf).withColumn("score", F.round("score", 9)), VC)


@query("j20_segment_rounds")
def j20(spark, sf):
    b = arcs.merge_resolutions(resolutions(spark, sf).where("score >= 2"), VC, 5400.0)
    w = windows(spark, sf).select("vod", "chapter", "start", "end")
    return arcs.assign_rounds(w, b.select("vod", "chapter", "ts"), VC).groupBy("vod", "chapter", "round").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


@query("j21_round_confidence")
def j21(spark, sf):
    return arcs.round_confidence(j20(spark, sf), VC).select("vod", "chapter", "round", r6("confidence").alias("confidence"))


@query("j22_cluster_rounds")
def j22(spark, sf):
    return arcs.cluster_rounds(arcs.round_confidence(j20(spark, sf), VC), VC, 10800.0, 0.3).select("vod", "chapter", "start", "end", "n")


@query("j01_cluster_ranges")
def j01(spark, sf):
    return arcs.cluster_ranges(ranges(spark, sf), V, 1800.0, 5400.0, 0.55).select("vod", "start", "end", "n")


@query("j23_climax_enhance", ONE + """, j as (select o.event_id, w.start, z, reactions, round(0.4 * z + 0.3 * burst + 0.3 * reactions, 9) as pick, 0.4 * z + 0.3 * burst + 0.1 * reactions as told from one o join scored w on w.vod = o.vod and w.start <= o."end" + 30 and w."end" >= o.start - 30)
 select event_id as arc, first(start order by pick desc, start) as climax_start, round(first(told order by pick desc, start), 5) as climax_score, round(max(z), 6) as peak_z, sum(reactions)::bigint as reactions from j group by event_id""")
def j23(spark, sf):
    a = ranges(spark, sf).select("vod", F.col("event_id").alias("arc"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    d = arcs.climax(a, scored(spark, sf), V)
    return d.select("arc", "climax_start", F.round("climax_score", 5).alias("climax_score"), r6("peak_z").alias("peak_z"), F.col("reactions").cast("long").alias("reactions"))


@query("j24_arc_manifest_stats", BASE + """select topic as arc_type, count(*) as n, sum("end" - start) as total, round(avg("end" - start), 6) as mean from rng group by topic""")
def j24(spark, sf):
    d = ranges(spark, sf).withColumn("d", F.col("end") - F.col("start"))
    return d.groupBy(F.col("topic").alias("arc_type")).agg(F.count("*").alias("n"), F.sum("d").alias("total"), r6(F.avg("d")).alias("mean"))


@query("j26_is_jc_chapter", BASE + """, m as (select vod, chapter, count(*) filter (mode = 'jc') * 2 >= count(*) as jc from win group by all) select vod, chapter, jc from m""")
def j26(spark, sf):
    d = windows(spark, sf).groupBy(*VC).agg(F.when(F.count_if(F.col("mode") == "jc") * 2 >= F.count("*"), "jc").otherwise("game").alias("m"))
    return d.select("vod", "chapter", arcs.is_talk(F.lit(None).cast("boolean"), F.col("m"), F.lit("")).alias("jc"))


@query("j27_is_jc_arc", MERGED.format(gap=120) + """, j as (select m.vod, m.start, count(distinct w.chapter) as n, min(w.mode) as mode from mg m join win w on w.vod = m.vod and w.start < m."end" and w."end" > m.start group by all) select vod, start, n = 1 and mode = 'jc' as jc from j""")
def j27(spark, sf):
    m = intervals.merge_gap(ranges(spark, sf), V, 120.0)
    w = windows(spark, sf).select("vod", "chapter", "mode", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    d = intervals.overlap_join(m, w, V, 3600.0).groupBy("vod", "start").agg(F.countDistinct("chapter").alias("n"), F.min("mode").alias("m"))
    return d.select("vod", "start", ((F.col("n") == 1) & (F.col("m") == "jc")).alias("jc"))


@query("k03_quality_score", BASE + """select r.event_id, round(0.75 * avg(greatest(0.0, z)) + 0.25 * max(greatest(0.0, z)), 5) as score, sum(reactions)::bigint as reactions from rng r join scored w on r.vod = w.vod and w.start < r."end" and w."end" > r.start group by r.event_id""")
def k03(spark, sf):
    w = scored(spark, sf).select("vod", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "z", "reactions")
    z = F.greatest(F.lit(0.0), F.col("z"))
    return intervals.overlap_join(ranges(spark, sf).select("vod", "event_id", "start", "end"), w, V, 1800.0).groupBy("event_id").agg(
        F.round(0.75 * F.avg(z) + 0.25 * F.max(z), 5).alias("score"), F.sum("reactions").cast("long").alias("reactions"))


@query("k04_low_energy_reject", BASE + """select r.event_id, avg(case when energy = 'high' then 1.0 else 0.0 end) < 0.2 and round(0.75 * avg(greatest(0.0, z)) + 0.25 * max(greatest(0.0, z)), 9) < 0.35 and sum(reactions) < 5 as reject
 from rng r join scored w on r.vod = w.vod and w.start < r."end" and w."end" > r.start group by r.event_id""")
def k04(spark, sf):
    w = scored(spark, sf).select("vod", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "z", "reactions", "energy")
    z = F.greatest(F.lit(0.0), F.col("z"))
    d = intervals.overlap_join(ranges(spark, sf).select("vod", "event_id", "start", "end"), w, V, 1800.0).groupBy("event_id").agg(
        F.avg(F.when(F.col("energy") == "high", 1.0).otherwise(0.0)).alias("h"), F.round(0.75 * F.avg(z) + 0.25 * F.max(z), 9).alias("q"), F.sum("reactions").alias("r"))
    return d.select("event_id", ((F.col("h") < 0.2) & (F.col("q") < 0.35) & (F.col("r") < 5)).alias("reject"))


@query("k09_majority", BASE + """, c as (select vod, topic, count(*) as n, min(win) as first from win group by all) select vod, topic from c qualify row_number() over (partition by vod order by n desc, first) = 1""")
def k09(spark, sf):
    return windows(spark, sf).groupBy("vod").agg(grouping.majority("topic", "win").alias("topic"))


@query("k10_max_rank", BASE + "select vod, chapter, case max(case energy when 'high' then 2 when 'low' then 0 else 1 end) when 2 then 'high' when 0 then 'low' else 'medium' end as energy from scored group by all")
def k10(spark, sf):
    return scored(spark, sf).groupBy(*VC).agg(grouping.energy_name(F.max(grouping.energy_rank(F.col("energy")))).alias("energy"))


@query("k11_ordered_join", BASE + "select vod, chapter, string_agg(topic, ' ' order by win) as topics from win group by all")
def k11(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("win", "topic")))
    return windows(spark, sf).groupBy(*VC).agg(F.array_join(F.transform(rows, lambda r: r["topic"]), " ").alias("topics"))


@query("flagship_clips", GATE.replace(BASE, BASE + TOPK) + """, seeds as (select vod, r.s as start from tu), ex as (select s.vod, w.start, w."end" from seeds s join win w on w.vod = s.vod and w.start between s.start - 1800 and s.start + 1800),
 od as (select distinct * from ex), p as (select *, max("end") over (partition by vod order by start rows between unbounded preceding and 1 preceding) as reach from od),
 b2 as (select *, sum(case when reach is null or start - reach > 40 then 1 else 0 end) over (partition by vod order by start) as run from p),
 cl as (select vod, min(start) as start, max("end") as "end" from b2 group by vod, run)
 select c.vod, c.start, c."end", round(0.75 * avg(greatest(0.0, z)) + 0.25 * max(greatest(0.0, z)), 5) as score, sum(reactions)::bigint as reactions
 from cl c join scored s on s.vod = c.vod and s.start < c."end" and s."end" > c.start group by all""".replace(" cl as (select vod, min(start)", " clip as (select vod, min(start)").replace("from cl c join", "from clip c join"))
def flagship(spark, sf):
    """Activity to windows, robust z, spaced seeds, extended and merged, scored over the windows they overlap."""
    s = scored(spark, sf)
    seeds = select.topk_spaced(s, V, "reactions", "start", 8, 2, 5400.0, []).select("vod", F.col("start").alias("seed"))
    near = s.select("vod", "start", "end").withColumn("seed", F.explode(F.array(F.col("start") - 1800, F.col("start"), F.col("start") + 1800)))
    clips = intervals.merge_gap(near.join(seeds, ["vod", "seed"]).select("vod", "start", "end").distinct(), V, 40.0)
    w = s.select("vod", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "z", "reactions")
    z = F.greatest(F.lit(0.0), F.col("z"))
    return intervals.overlap_join(clips, w, V, 1800.0).groupBy("vod", "start", "end").agg(
        F.round(0.75 * F.avg(z) + 0.25 * F.max(z), 5).alias("score"), F.sum("reactions").cast("long").alias("reactions"))


