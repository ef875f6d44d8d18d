"""Queries of the remaining inventory: variants, exports, helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, timecode
from ..operators import grouping, intervals, segments, select, series, vectors
from ..registry import query
from ..sources import files, sinks
from ..streaming import sessions
from .base import BASE, chat, r6, ranges, scored, table, windows
from .segment_queries import CHAPTERS, TURNS, chapters, turns
from .selection_queries import THREAD, _vectors, threaded
from .series_queries import V, VC
from .source_queries import chat_json


@query("a04_scan_chapters_merged", BASE + CHAPTERS + "select vod, count(*) as n, max(b_end) as last from chaps group by vod")
def a04(spark, sf):
    return chapters(spark, sf).groupBy("vod").agg(F.count("*").alias("n"), F.max("b_end").alias("last"))


@query("a07_scan_bursts_unfiltered", BASE + """select id, start, "end", reactions from win union all select vod || ':mom:' || event_id, start, "end", score from rng""")
def a07(spark, sf):
    m = ranges(spark, sf).select(F.concat_ws(":", "vod", F.lit("mom"), "event_id").alias("id"), "start", "end", F.col("score").alias("reactions"))
    return windows(spark, sf).select("id", "start", "end", "reactions").unionByName(m)


@query("a11_scan_vectors", "select vec_id, len(embedding)::bigint as dim from embeddings")
def a11(spark, sf):
    return _vectors(spark, sf).select(F.col("id").alias("vec_id"), F.size("embedding").cast("long").alias("dim"))


@query("a15_scan_enhanced_ranges", BASE + """select vod, start, "end" from rng where "end" > start""")
def a15(spark, sf):
    r = F.struct("start", "end")
    d = ranges(spark, sf).groupBy("vod").agg(F.to_json(F.struct(F.collect_list(r).alias("ranges"))).alias("value"))
    return files.parse_manifest(d, keep=("vod",)).select("vod", "start", "end")


@query("a33_downloader_chat_clean", BASE + "select vod, count(*) as n from chat where not regexp_matches(kind, 'is gifting|gifted') group by vod")
def a33(spark, sf):
    d = files.parse_chat(chat_json(spark, sf), keep=("vod",))
    return d.where(~text.is_sub_message(F.col("content"), True)).groupBy("vod").agg(F.count("*").alias("n"))


@query("d17_block_by_span_docs", BASE + """, l as (select vod, list({'s': start, 'e': "end", 'n': 1::bigint} order by start) as l from win group by vod),
 r as (select vod, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: case when x[1].e - a[len(a)].s <= 7200 then list_append(a[1:len(a)-1], {'s': a[len(a)].s, 'e': x[1].e, 'n': a[len(a)].n + 1}) else list_concat(a, x) end) as r from l),
 u as (select vod, unnest(r) as r from r) select vod, r.s as start, r.e as "end" from u""")
def d17(spark, sf):
    return segments.text_blocks(windows(spark, sf).withColumn("text", F.col("topic")), V, 7200.0).select("vod", "start", "end")


@query("e06_game_at_timestamp", BASE + CHAPTERS + "select event_id, chapter from chat e join chaps c on e.vod = c.vod and sec >= b_start and sec < b_end")
def e06(spark, sf):
    return intervals.range_join(chat(spark, sf).select("vod", "event_id", "sec"), chapters(spark, sf), V, F.col("sec").cast("double"), F.col("b_start"),
                                F.col("b_end"), 21600.0, False).select("event_id", "chapter")


@query("g16_title_rerank", BASE + "select event_id, row_number() over (partition by vod order by score desc, event_id) as place from rng")
def g16(spark, sf):
    n = F.row_number().over(Window.partitionBy("vod").orderBy(F.desc("score"), "event_id"))
    return ranges(spark, sf).select("event_id", n.cast("long").alias("place"))


@query("h04_extend_groups", THREAD + """select distinct t.vod, min(o.start) over p as lo, max(o."end") over p as hi from th t join th o on t.vod = o.vod and t.thread = o.thread where t.reactions >= 5 window p as (partition by t.vod, t.win)""")
def h04(spark, sf):
    d = threaded(spark, sf)
    return grouping.extend_by_thread(d, d.where("reactions >= 5").select("vod", "win"), V, "win", "thread", "same_prev").select("vod", "lo", "hi").distinct()


@query("h32_manifest_sort", BASE + "select vod, row_number() over (partition by vod order by topic, start, event_id) as n, event_id from rng")
def h32(spark, sf):
    n = F.row_number().over(Window.partitionBy("vod").orderBy("topic", "start", "event_id"))
    return ranges(spark, sf).select("vod", n.cast("long").alias("n"), "event_id")


@query("i01_normalise", "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm from embeddings")
def i01(spark, sf):
    n = vectors.normalise(F.col("embedding"))
    return _vectors(spark, sf).select(F.col("id").alias("vec_id"), r6(F.sqrt(vectors.dot(n, n))).alias("norm"))


@query("l16_timestamp_lines", BASE + "select event_id, lpad((sec // 3600)::varchar, 2, '0') || ':' || lpad((sec // 60 % 60)::varchar, 2, '0') || ':' || lpad((sec % 60)::varchar, 2, '0') || ' ' || kind as line from chat")
def l16(spark, sf):
    line = F.concat(timecode.format_short(F.col("sec")), F.lit(" - "), F.col("kind"))
    stamp = timecode.format_hms(timecode.strict_seconds(F.regexp_extract(line, r"^(\d*(?::\d+)+)", 1)))
    label = F.regexp_replace(line, r"^\d*(?::\d+)+\s*(?:-\s*)?", "")
    return chat(spark, sf).select("event_id", F.concat_ws(" ", stamp, label).alias("line"))


@query("o01_sliding_windows", """select w as start, count(*) as messages from (select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as w from events) group by w""")
def o01_sliding(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions.activity(e, "ts", [], "2 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "messages")


@query("s05_group_bounds", TURNS + """select conv_id, min(start) as start, max("end") as "end" from tr group by conv_id""")
def s05(spark, sf):
    return turns(spark, sf).groupBy("conv_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


@query("s07_transcript_hms_range", TURNS + """select conv_id, turn from tr where start < 90 and "end" > 30""")
def s07(spark, sf):
    lo, hi = timecode.hms_seconds(F.lit("00:00:30")), timecode.hms_seconds(F.lit("00:01:30"))
    return turns(spark, sf).where((F.col("start") < hi) & (F.col("end") > lo)).select("conv_id", "turn")


@query("s10_chunk_links", BASE + "select vod, win, coalesce(lag(topic) over (partition by vod order by win), '') || ' > ' || topic as link from win")
def s10(spark, sf):
    prev = F.lag("topic").over(Window.partitionBy("vod").orderBy("win"))
    return windows(spark, sf).select("vod", "win", F.concat(F.coalesce(prev, F.lit("")), F.lit(" > "), F.col("topic")).alias("link"))


@query("s13_pending_by_vod", BASE + "select vod, count(*) as pending from chat where kind = 'error' group by vod")
def s13(spark, sf):
    return chat(spark, sf).where("kind = 'error'").groupBy("vod").agg(F.count("*").alias("pending"))


@query("s14_queued_scan", BASE + "select event_id from chat where kind = 'view'")
def s14(spark, sf):
    return chat(spark, sf).where("kind = 'view'").select("event_id")


@query("s16_manifest_clips", BASE + """select vod, start, "end", topic as title from rng where "end" > start""")
def s16(spark, sf):
    clip = F.struct(F.col("start"), F.col("end"), F.col("topic").alias("title"))
    d = ranges(spark, sf).groupBy("vod").agg(F.to_json(F.struct(F.collect_list(clip).alias("clips"))).alias("j"))
    c = d.select("vod", F.explode(F.from_json("j", "clips array<struct<start:double,end:double,title:string>>")["clips"]).alias("c"))
    return c.select("vod", "c.start", "c.end", "c.title")


@query("s18_emote_totals", BASE + "select kind, sum(n_emotes)::bigint as emotes from chat group by kind")
def s18(spark, sf):
    return chat(spark, sf).groupBy("kind").agg(F.sum("n_emotes").cast("long").alias("emotes"))


@query("s19_filtered_again", BASE + """select vod, count(*) as n from rng where start >= 20000 and "end" <= 60000 group by vod""")
def s19(spark, sf):
    return ranges(spark, sf).where((F.col("start") >= 20000) & (F.col("end") <= 60000)).groupBy("vod").agg(F.count("*").alias("n"))


@query("s21_chapter_names", BASE + CHAPTERS + "select id, coalesce(replace(upper(substr(c.chapter, 1, 1)) || substr(c.chapter, 2), '_', ' '), 'Unknown') as name from win w left join chaps c on c.vod = w.vod and c.k = w.chapter")
def s21(spark, sf):
    c = chapters(spark, sf).select("vod", F.col("ord").alias("chapter"), F.col("chapter").alias("n"))
    name = F.initcap(F.translate("n", "_", " "))
    return windows(spark, sf).join(c, ["vod", "chapter"], "left").select("id", F.coalesce(name, F.lit("Unknown")).alias("name"))


@query("s22_arc_midpoint", BASE + """select event_id, (start + "end") / 2 as mid from rng""")
def s22(spark, sf):
    return ranges(spark, sf).select("event_id", F.coalesce((F.col("start") + F.col("end")) / 2, F.col("start")).alias("mid"))


@query("s23_arc_struct", BASE + """select event_id, start, "end" - start as duration from rng""")
def s23(spark, sf):
    a = F.struct(F.col("event_id"), F.struct("start", (F.col("end") - F.col("start")).alias("duration")).alias("bounds"))
    return ranges(spark, sf).select(a.alias("a")).select("a.event_id", "a.bounds.start", "a.bounds.duration")


@query("s26_chunk_lengths", TURNS + "select conv_id, count(*) as segments, sum(length(text))::bigint as chars from tr group by conv_id")
def s26(spark, sf):
    return turns(spark, sf).groupBy("conv_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("s27_category_map", BASE + "select regexp_replace(lower(kind), '[^a-z0-9]', '', 'g') as label, min(kind) as display from chat group by 1")
def s27(spark, sf):
    return chat(spark, sf).groupBy(text.normalize_label(F.col("kind")).alias("label")).agg(F.min("kind").alias("display"))


@query("s28_range_adapters", BASE + "select event_id, score::double as score, topic <> '' as named from rng")
def s28(spark, sf):
    j = F.to_json(F.struct("event_id", F.col("score").cast("string").alias("score"), "topic"))
    d = ranges(spark, sf).select(F.from_json(j, "event_id long, score string, topic string").alias("x"))
    return d.select("x.event_id", timecode.ensure_float(F.col("x.score")).alias("score"), (F.col("x.topic") != "").alias("named"))


@query("s31_stale_sessions", "select user_id from events group by user_id having max(ts) < timestamp '2024-01-29 00:00:00'")
def s31(spark, sf):
    d = sessions.last_seen(table(spark, sf, "events"), "ts", ["user_id"])
    return d.where(F.col("last_ts") < F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).select("user_id")


@query("k05_c_unit_scores", BASE + "select vod, win, round(reactions / max(reactions) over (partition by vod)::double, 6) as u from win qualify max(reactions) over (partition by vod) > 0")
def k05c(spark, sf):
    return windows(spark, sf).select("vod", "win", r6(series.max_normalise("reactions", V)).alias("u"))


@query("a25_upserted_labels", BASE + "select vod, count(*) as n from win group by vod")
def a25b(spark, sf):
    w = windows(spark, sf).select("id", "vod")
    return sinks.upsert(w, w, ["id"]).groupBy("vod").agg(F.count("*").alias("n"))
