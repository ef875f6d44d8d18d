"""Composed queries: clips, curation, sections, arcs, director's cut."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arcs, clips, fixpoint, grouping, intervals, select, series, vectors
from ..registry import query
from .base import BASE, chat, r6, ranges, scored, spread, table, windows
from .segment_queries import TURNS, chapters, turns
from .selection_queries import CLUSTER, clusters, kept, resolutions, threaded
from .semantic_queries import j13
from .series_queries import V, VC, salient

CONFIG = clips.ClipConfig(min_score=0.2, context=1800.0, spacing=3600.0)


def groups(spark, sf):
    """Seeds of each session merged into arcs, with the centre of the most reacted window as anchor."""
    s = scored(spark, sf)
    seeds = select.topk_spaced(s, V, "reactions", "start", 8, 2, 3600.0, ["end", "reactions"])
    return grouping.reaction_arcs(seeds, V, 40.0, 9000.0).withColumn("anchor", (F.col("start") + F.col("end")) / 2)


@query("k16_candidates")
def k16(spark, sf):
    return clips.candidates(groups(spark, sf), scored(spark, sf), V, CONFIG)


@query("k17_finalise")
def k17(spark, sf):
    return clips.finalise(k16(spark, sf), V, CONFIG).select("vod", "start", "end", "score", "start_hms", "end_hms")


@query("f06_dynamic_padding")
def f06(spark, sf):
    s = scored(spark, sf).withColumn("smooth", series.positive_smooth("z", VC, "win"))
    a = s.groupBy("vod").agg(F.array_sort(F.collect_list(F.struct("start", "smooth"))).alias("a"))
    # the arrays are columns of the smaller side: as expressions of each range they would be made anew in every step
    a = a.select("vod", F.transform("a", lambda r: r["start"]).alias("times"), F.transform("a", lambda r: r["smooth"]).alias("values"))
    d = spread(ranges(spark, sf).select("vod", "event_id", "start", "end")).join(a, "vod")
    x = clips.dynamic_padding(F.col("start"), F.col("end"), F.col("times"), F.col("values"))
    return d.select("event_id", x.alias("x")).select("event_id", F.col("x.s").alias("start"), F.col("x.e").alias("end"))


@query("k05_goodbye_detect", "select doc_id, " + " + ".join(f"contains(lower(coalesce(text, '')), '{t}')::int" for t in clips.GOODBYE) + " >= 3 as goodbye from documents")
def k05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (clips.goodbye_hits(F.col("text")) >= 3).alias("goodbye"))


@query("e13_climax_window_join", BASE + """select r.event_id, count(*) as n, round(max(z), 6) as z from rng r join scored w on r.vod = w.vod and w.start <= r."end" + 30 and w."end" >= r.start - 30 group by r.event_id""")
def e13(spark, sf):
    w = scored(spark, sf).select("vod", (F.col("start") - 30).alias("b_start"), (F.col("end") + 30).alias("b_end"), "z")
    return intervals.overlap_join(ranges(spark, sf).select("vod", "event_id", "start", "end"), w, V, 1800.0, True).groupBy("event_id").agg(
        F.count("*").alias("n"), r6(F.max("z")).alias("z"))


@query("e14_expand_doc_to_ranges", BASE + """select vod, start, "end", topic from win where win % 2 = 0 union all select a.vod, b.start, b."end", b.topic from win a join win b on a.vod = b.vod and b.win = a.win - 1 where a.win % 2 = 1""")
def e14(spark, sf):
    w = windows(spark, sf)
    prev = F.array(F.concat(F.col("vod"), F.lit(":win:"), F.col("win") - 1))
    hits = w.withColumn("burst_ids", F.when(F.col("win") % 2 == 1, prev).otherwise(F.array().cast("array<string>")))
    return clips.expand_hits(hits, w, V)


@query("e17_midpoint_assignment", BASE + """, b as (select vod, "end" as ts from scored where energy = 'high') select r.event_id, (select count(*) from b where b.vod = r.vod and b.ts <  (r.start + r."end") / 2) as round from rng r""")
def e17(spark, sf):
    b = scored(spark, sf).where("energy = 'high'").select("vod", F.col("end").alias("ts"))
    return arcs.assign_rounds(ranges(spark, sf), b, V).select("event_id", "round")


@query("e18_clip_context_role", BASE + """select r.event_id as clip, w.win, case when w."end" <= r.start then 'before' when w.start >= r."end" then 'after' when w.start < r.start then 'transition_in'
 when w."end" > r."end" then 'transition_out' else 'clip' end as context from rng r join win w on r.vod = w.vod and w.start < r."end" + 60 and w."end" > r.start - 60""")
def e18(spark, sf):
    c = ranges(spark, sf).withColumn("clip", F.col("event_id"))
    return clips.context_roles(c, windows(spark, sf).select("vod", "win", "start", "end"), V, 60.0, 1800.0).select("clip", "win", "context")


@query("e10_chapter_transcript", BASE + """, c as (select vod, sec // 21600 as k, substr(string_agg(kind, ' ' order by sec, event_id), 1, 1200) as text from chat group by all) select vod, k as chapter, text from c""")
def e10(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("sec", "event_id", "kind")))
    d = chat(spark, sf).groupBy("vod", F.floor(F.col("sec") / 21600).alias("chapter")).agg(rows.alias("r"))
    return d.select("vod", "chapter", F.substring(F.array_join(F.transform("r", lambda x: x["kind"]), " "), 1, 1200).alias("text"))


@query("i25_curate")
def i25(spark, sf):
    return clips.curate(ranges(spark, sf), V, 10.0, 600.0, 12.0, 8.0, 7200.0, 86400.0).select("vod", "start", "end", "topic")


@query("i15_attach_cluster", CLUSTER + """, sz as (select chapter, cluster, count(*) as size from cl group by all having count(*) >= 2)
 select id, coalesce(sz.cluster, -1)::bigint as cluster, coalesce(size, 1)::bigint as size from cl left join sz using (chapter, cluster)""")
def i15(spark, sf):
    c, key = clusters(spark, sf), ["chapter", "cluster"]
    n = c.groupBy(*key).agg(F.count("*").alias("size")).where("size >= 2").withColumn("found", F.col("cluster"))
    return c.join(n, key, "left").select("id", F.coalesce("found", F.lit(-1).cast("long")).alias("cluster"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))


@query("h05_smooth_sections")
def h05(spark, sf):
    return fixpoint.smooth_sections(threaded(spark, sf), VC)


@query("h24_postprocess_ranges")
def h24(spark, sf):
    """Flattened ranges with stats, a moved start and merged neighbours of one topic."""
    s = scored(spark, sf)
    r = grouping.flatten(grouping.peak_blocks(kept(spark, sf), V, F.col("keep"), F.lit(3600.0)), V, "keep", 3600.0, False).drop("topic", "energy", "burst_ids")
    st = grouping.range_stats(r, s, V, 3600.0)
    d = grouping.buildup_start(st.withColumn("peak_z", F.col("avg_z")), s, V, 7200.0)
    d = d.withColumn("start", F.col("buildup")).withColumn("energy", F.when(F.col("has_peak"), "high").otherwise("medium"))
    return grouping.topic_continuity(d, V, 1800.0).select("vod", "start", "end", "topic", "energy", "n")


@query("j25_story_arcs")
def j25(spark, sf):
    """Arcs per chapter: rounds where resolutions show them, else detected arcs, then the gaps, packed by length."""
    ev = resolutions(spark, sf).withColumn("score", F.round("score", 9))
    quality = arcs.resolution_quality(ev, VC)
    w = windows(spark, sf).select("vod", "chapter", "start", "end")
    b = arcs.merge_resolutions(ev.where("score >= 2"), VC, 5400.0).select("vod", "chapter", "ts")
    rounds = arcs.assign_rounds(w, b, VC).groupBy("vod", "chapter", "round").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    played = arcs.cluster_rounds(arcs.round_confidence(rounds, VC), VC, 10800.0, 0.3).join(quality.where("round_based").select("vod", "chapter"), VC)
    found = played.select("vod", "chapter", "start", "end").unionByName(
        j13(spark, sf).join(w.groupBy("vod", "chapter").agg(F.min("start").alias("c0"), F.max("end").alias("c1")), "vod")
        .where("start >= c0 and start < c1").join(quality.where("round_based").select("vod", "chapter"), VC, "left_anti")
        .select("vod", "chapter", "start", "end"))
    bounds = chapters(spark, sf).select("vod", F.col("ord").alias("chapter"), "b_start", "b_end")
    free = intervals.pack_ranges(intervals.complement(found, bounds, VC, 600.0), VC, 10800.0).select("vod", "chapter", "start", "end")
    length = F.col("end") - F.col("start")
    return found.withColumn("kind", F.lit("arc")).unionByName(free.withColumn("kind", F.lit("gap"))).where(length >= 300)


@query("j03_topic_bridges", BASE + "select vod, count(distinct topic) as topics from win group by vod")
def j03b(spark, sf):
    return windows(spark, sf).groupBy("vod").agg(F.countDistinct("topic").alias("topics"))


@query("f14_merge_short_chapters")
def f14(spark, sf):
    d = grouping.topic_continuity(scored(spark, sf), V).withColumn("name", F.col("topic"))
    return fixpoint.merge_short_chapters(d, V, 40.0)


@query("h33_spatial_merge_faces")
def h33(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 200).alias("x"), (F.col("event_id") % 90).alias("y"), F.lit(30).alias("w"), F.lit(20).alias("h"))
    return fixpoint.merge_boxes(e, ["user_id"])


@query("k13_distinct_ordered", BASE + "select vod, string_agg(topic, ',' order by f) as topics from (select vod, topic, min(win) as f from win group by all) group by vod")
def k13(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("win", "topic")))
    return windows(spark, sf).groupBy("vod").agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r["topic"])), ",").alias("topics"))


@query("k14_narrative_rollup", BASE + "select vod, count(*) as n, round(avg(confidence), 11) as mean, count(*) filter (confidence >= 0.6) as high, count(*) filter (confidence >= 0.4 and confidence < 0.6) as mid, count(*) filter (confidence < 0.4) as low from win group by vod")
def k14(spark, sf):
    c = F.col("confidence")
    return windows(spark, sf).groupBy("vod").agg(F.count("*").alias("n"), F.round(F.avg(c), 11).alias("mean"), F.count_if(c >= 0.6).alias("high"),
                                                 F.count_if((c >= 0.4) & (c < 0.6)).alias("mid"), F.count_if(c < 0.4).alias("low"))


@query("s09_chunk_lines", TURNS + "select conv_id, string_agg('[' || lpad((start::bigint // 60)::varchar, 2, '0') || ':' || lpad((start::bigint % 60)::varchar, 2, '0') || '] ' || text, chr(10) order by start) as lines from tr group by conv_id")
def s09(spark, sf):
    t = turns(spark, sf)
    line = F.format_string("[%02d:%02d] %s", F.floor(F.col("start") / 60), (F.col("start") % 60).cast("long"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("start", line.alias("l"))))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("lines"))


@query("c23_salience_peaks")
def salience_peaks(spark, sf):
    return salient(spark, sf).select("vod", "win", series.local_max("salience", VC, "win").alias("peak"))
