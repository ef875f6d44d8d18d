"""Queries of sections A, O and P: sources, sinks, state, and relational features over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals
from ..registry import query
from ..sources import files, sinks
from ..streaming import sessions
from .base import BASE, chat, r6, ranges, scored, table, windows
from .segment_queries import CHAPTERS, TURNS, chapters, turns

V = ["vod"]


def chat_json(spark, sf):
    """One JSON text per session in the nested layout."""
    emote = F.when(F.col("n_emotes") == 1, F.struct(F.col("kind").alias("emoticon_id")))
    comment = F.struct(
        F.col("sec").cast("double").alias("content_offset_seconds"), F.struct(F.col("user_id").cast("string").alias("display_name")).alias("commenter"),
        F.struct(F.col("kind").alias("body"), F.array(F.struct(F.col("kind").alias("text"), emote.alias("emoticon"))).alias("fragments"),
                 F.array().cast("array<struct<emoticon_id:string>>").alias("emoticons")).alias("message"))
    return chat(spark, sf).groupBy("vod").agg(F.to_json(F.struct(F.collect_list(comment).alias("comments"))).alias("value"))


@query("a01_scan_chat_json", BASE + "select vod, sec as second, kind as content, user_id::varchar as username, n_emotes::bigint as emotes from chat")
def a01(spark, sf):
    d = files.parse_chat(chat_json(spark, sf), keep=("vod",))
    return d.select("vod", "second", "content", "username", F.size("emotes").cast("long").alias("emotes"))


@query("b01_parse_chat", BASE + "select vod, count(*) as n, sum(sec)::double as total, sum(n_emotes)::bigint as emotes from chat group by vod")
def b01(spark, sf):
    item = F.struct(F.col("sec").cast("string").alias("timestamp"), F.col("kind").alias("content"), F.col("user_id").cast("string").alias("username"),
                    F.when(F.col("n_emotes") == 1, F.array("kind")).alias("emotes"))
    d = chat(spark, sf).groupBy("vod").agg(F.to_json(F.collect_list(item)).alias("value"))
    return files.parse_chat(d, keep=("vod",)).groupBy("vod").agg(F.count("*").alias("n"), F.sum("timestamp").alias("total"),
                                                               F.sum(F.size("emotes")).cast("long").alias("emotes"))


@query("b02_extract_emotes", BASE + "select vod, kind as emote, count(*) as n from chat where n_emotes = 1 group by all")
def b02(spark, sf):
    d = files.parse_chat(chat_json(spark, sf), keep=("vod",))
    return d.select("vod", F.explode("emotes").alias("emote")).groupBy("vod", "emote").agg(F.count("*").alias("n"))


@query("b06_clean_chat", BASE + "select vod, count(*) as n from chat where not regexp_matches(kind, 'raid|purchase') group by vod")
def b06(spark, sf):
    d = files.parse_chat(chat_json(spark, sf), keep=("vod",))
    return d.where(~F.col("content").rlike("raid|purchase")).groupBy("vod").agg(F.count("*").alias("n"))


@query("a02_scan_segments", TURNS + """select conv_id, turn, start, "end", text from tr""")
def a02(spark, sf):
    s = F.struct(F.col("turn").cast("string").alias("segment_id"), F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("text").alias("transcript"))
    d = turns(spark, sf).groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(s).alias("segments"))).alias("value"))
    return files.parse_segments(d, keep=("conv_id",)).select("conv_id", F.col("segment_id").cast("long").alias("turn"), "start", "end", "text")


@query("a03_scan_chapters", BASE + CHAPTERS + """select vod, k::bigint as ord, chapter as id, b_start as start, b_end as "end" from chaps""")
def a03(spark, sf):
    c = F.struct(F.col("chapter").alias("id"), F.col("b_start").alias("start_time"), F.col("b_end").alias("end_time"))
    d = chapters(spark, sf).groupBy("vod").agg(F.array_sort(F.collect_list(F.struct("ord", c.alias("c")))).alias("r"))
    d = d.select("vod", F.to_json(F.struct(F.transform("r", lambda x: x["c"]).alias("chapters"))).alias("value"))
    return files.parse_chapters(d, keep=("vod",)).select("vod", F.col("ord").cast("long").alias("ord"), "id", "start", "end")


@query("a05_scan_windows", BASE + """select id, vod, start, "end", mode, 'chapter_001' as chapter_id, '' as section_context from win""")
def a05(spark, sf):
    return files.with_optional(windows(spark, sf), chapter_id="chapter_001", section_context="").select(
        "id", "vod", "start", "end", "mode", "chapter_id", "section_context")


@query("a06_scan_bursts", BASE + "select id, lower(topic) as topic_key, energy from scored where not contains(id, ':mom:')")
def a06(spark, sf):
    return scored(spark, sf).where(~F.col("id").contains(":mom:")).select("id", F.lower("topic").alias("topic_key"), "energy")


@query("a08_scan_time_slice", BASE + "select id, start, reactions from win where start >= 20000 and start < 60000")
def a08(spark, sf):
    return windows(spark, sf).where("start >= 20000 and start < 60000").select("id", "start", "reactions")


@query("a09_scan_quality_cols", BASE + """select vod, start, "end", round(z, 6) as z from scored""")
def a09(spark, sf):
    return scored(spark, sf).select("vod", "start", "end", r6("z").alias("z"))


@query("a10_scan_vod_ordered", BASE + "select vod, chapter, start, row_number() over (partition by vod order by chapter, start) as n from win")
def a10(spark, sf):
    n = F.row_number().over(Window.partitionBy("vod").orderBy("chapter", "start"))
    return windows(spark, sf).select("vod", "chapter", "start", n.cast("long").alias("n"))


@query("a12_scan_transcript_range", TURNS + """select conv_id, string_agg(trim(text), ' ' order by start, "end", text) as text from tr where start < 100 and "end" > 20 group by conv_id""")
def a12(spark, sf):
    return files.transcript_range(turns(spark, sf), ["conv_id"], F.lit(30.0), F.lit(90.0), 10.0)


@query("a13_scan_segments_range", TURNS + """select conv_id, turn from tr where start < 90 and "end" > 30""")
def a13(spark, sf):
    return turns(spark, sf).where((F.col("start") < 90) & (F.col("end") > 30)).select("conv_id", "turn")


@query("a14_scan_manifest", BASE + """select vod, start, "end", topic as topic_key from rng where "end" > start""")
def a14(spark, sf):
    r = F.struct("start", "end", F.col("topic").alias("topic_key"))
    d = ranges(spark, sf).groupBy("vod").agg(F.to_json(F.struct(F.collect_list(r).alias("ranges"))).alias("value"))
    return files.parse_manifest(d, keep=("vod",)).select("vod", "start", "end", "topic_key")


@query("a16_scan_sponsor_spans", BASE + CHAPTERS + "select vod, b_start + 90 as start, b_start + 150 as \"end\" from chaps")
def a16(spark, sf):
    seg = F.array(F.struct(F.lit("1:30").alias("start"), F.lit("2:30").alias("end")))
    c = F.struct(F.col("b_start").alias("start_time"), seg.alias("sponsor_segments"))
    d = chapters(spark, sf).groupBy("vod").agg(F.to_json(F.struct(F.collect_list(c).alias("chunks"))).alias("value"))
    return files.parse_sponsor_spans(d, keep=("vod",))


@query("a17_chapter_clips_union", BASE + """select vod, start, "end", kind from (select vod, start, "end", 'seed' as kind from win where reactions > 5 union all select vod, start, "end", 'range' from rng)""")
def a17(spark, sf):
    a = windows(spark, sf).where("reactions > 5").select("vod", "start", "end", F.lit("seed").alias("kind"))
    return a.unionByName(ranges(spark, sf).select("vod", "start", "end", F.lit("range").alias("kind")))


@query("a19_sink_upsert", BASE + "select id, case when energy = 'high' then 'updated' else mode end as mode from scored")
def a19(spark, sf):
    s = scored(spark, sf).select("id", "mode", "energy")
    return sinks.upsert(s.select("id", "mode"), s.where("energy = 'high'").select("id", F.lit("updated").alias("mode")), ["id"])


@query("a20_sink_vector_upsert", "select vec_id, case when vec_id % 2 = 0 then 1 else 2 end as version from embeddings")
def a20(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    return sinks.upsert(e.withColumn("version", F.lit(1)), e.where("vec_id % 2 = 1").withColumn("version", F.lit(2)), ["vec_id"])


@query("a21_sink_labels", BASE + "select id, case when role <> '' then role else topic end as topic from scored")
def a21(spark, sf):
    s = scored(spark, sf)
    return sinks.update_columns(s.select("id", "topic"), s.where("role <> ''").select("id", F.col("role").alias("topic")), ["id"], ["topic"])


@query("a22_sink_sections", BASE + "select vod, chapter, printf('%s:%d:sec:%03d', vod, chapter, row_number() over (partition by vod, chapter order by min(start))) as section_id, topic from win group by vod, chapter, topic")
def a22(spark, sf):
    d = windows(spark, sf).groupBy("vod", "chapter", "topic").agg(F.min("start").alias("start"))
    return sinks.section_ids(d, ["vod", "chapter"], "start", F.concat_ws(":", "vod", "chapter")).select("vod", "chapter", "section_id", "topic")


@query("a24_sink_keep_blocks", BASE + "select id, energy = 'high' as keep_flag from scored")
def a24(spark, sf):
    s = scored(spark, sf)
    return sinks.update_columns(s.select("id"), s.select("id", (F.col("energy") == "high").alias("keep_flag")), ["id"], ["keep_flag"])


@query("a25_sink_clips_manifest")
def a25(spark, sf):
    d = ranges(spark, sf).withColumn("title", F.concat(F.col("topic"), F.lit(" "), F.col("event_id")))
    return sinks.clips_manifest(d, V)


@query("a28_export_all", BASE + CHAPTERS + "select w.id, c.chapter as category, w.mode from win w left join chaps c on c.vod = w.vod and c.k = w.chapter")
def a28(spark, sf):
    c = chapters(spark, sf).select("vod", F.col("ord").alias("k"), F.col("chapter").alias("category"))
    w = windows(spark, sf)
    return w.join(c, (w.vod == c.vod) & (w.chapter == c.k), "left").select("id", "category", "mode")


@query("a31_sink_ranked", BASE + "select event_id, row_number() over (partition by vod order by score desc, event_id) as rank from rng")
def a31(spark, sf):
    n = F.row_number().over(Window.partitionBy("vod").orderBy(F.desc("score"), "event_id"))
    return ranges(spark, sf).select("event_id", n.cast("long").alias("rank"))


@query("a32_chat_subset", BASE + "select vod, sec as second, kind as content from chat where sec between 3590 and 7200")
def a32(spark, sf):
    return sinks.chat_subset(files.parse_chat(chat_json(spark, sf), keep=("vod",)), 3600.0, 7200.0, 10.0).select("vod", "second", "content")


@query("a34_parse_console_table", BASE + "select event_id, kind as category, sec::double as start from chat")
def a34(spark, sf):
    from ..functions.timecode import format_hms

    line = F.concat(F.lit("│ "), F.col("kind"), F.lit(" │ "), format_hms(F.col("sec").cast("double")), F.lit(" │ 23:59:59 │"))
    return chat(spark, sf).select("event_id", files.parse_console_row(line).alias("x")).select("event_id", F.col("x.category").alias("category"), F.col("x.start").alias("start"))


@query("a35_object_key", BASE + "select event_id, (1000000 + event_id)::varchar as vod, 'chat_log' as kind from chat")
def a35(spark, sf):
    v = (F.lit(1000000) + F.col("event_id")).cast("string")
    key = F.concat(F.lit("data/"), v, F.lit("/"), v, F.lit("_chat_log.json"))
    return chat(spark, sf).select("event_id", files.parse_object_key(key).alias("x")).select("event_id", F.col("x.vod").alias("vod"), F.col("x.kind").alias("kind"))


# --- O: state --------------------------------------------------------------------------------------------------------------------

@query("o01_session_windows", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as b from events),
 s as (select user_id, ts, sum(b) over (partition by user_id order by ts) as n from g) select user_id, min(ts) as start, max(ts) + interval 12 hours as "end", count(*) as messages from s group by user_id, n""")
def o01(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = sessions.sessions(e, "ts", ["user_id"], "12 hours")
    return d.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "messages")


@query("o01_tumbling_windows", "select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as messages from events group by all")
def o01b(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = sessions.activity(e, "ts", ["event_type"], "1 hour")
    return d.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "messages")


@query("o03_requeue_rules", BASE + "select event_id, case when kind in ('purchase', 'view') then 'skip' when value > 90 then 'skip' when kind = 'error' and value < 20 then 'skip' when kind = 'error' and value > 70 then 'fail' else 'process' end as action from chat")
def o03(spark, sf):
    status = F.when(F.col("kind") == "purchase", "completed").when(F.col("kind") == "view", "running").when(F.col("kind") == "error", "queued").otherwise("failed")
    age = F.when(F.col("value") < 20, 1).when(F.col("value") > 70, 50).otherwise(24)
    return chat(spark, sf).select("event_id", sessions.should_process(status, age, F.when(F.col("value") > 90, 8).otherwise(1)).alias("action"))


@query("o04_backfill_missing", BASE + ", i as (select vod, min(value) / 10 as age from chat group by vod), l as (select * from i order by age, vod limit 20) select vod from l where vod not in (select vod from chat where value > 99.9 and vod is not null) and age <= 7 order by age, vod limit 10")
def o04(spark, sf):
    c = chat(spark, sf)
    items = c.groupBy("vod").agg((F.min("value") / 10).alias("age"))
    return sessions.missing_items(items, c.where("value > 99.9").select("vod").distinct(), "vod", "age").select("vod")


@query("o08_latest_job_row", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def o08(spark, sf):
    return sessions.latest_per_key(table(spark, sf, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("o07_job_status_scan", BASE + "select event_id from chat where kind = 'error'")
def o07(spark, sf):
    return chat(spark, sf).where("kind = 'error'").select("event_id")


@query("o09_retry_queue_upsert", "select user_id, count(*) - 1 as retry_count, arg_max(event_type, event_id) as reason, max(event_id) as failed_at from events where event_type = 'error' group by user_id")
def o09(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("reason", F.col("event_type"))
    return sessions.retry_queue(e, ["user_id"], "event_id")


@query("o10_ready_to_retry", "select event_id from events where event_id % 5 < 3 and ts <= timestamp '2024-01-15 00:00:00'")
def o10(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 5).alias("retry_count"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("retry_after"))
    return sessions.ready_to_retry(e, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


@query("o11_retention", "select event_id from events order by event_id desc limit 100")
def o11(spark, sf):
    return sessions.retain(table(spark, sf, "events").select("event_id"), "event_id")


# --- P: relational features that come with the engine ----------------------------------------------------------------------------

@query("p_cube", "select coalesce(l_returnflag, '-') as flag, coalesce(l_linestatus, '-') as status, count(*) as n, round(sum(l_quantity), 2)::double as qty from lineitem group by cube (l_returnflag, l_linestatus)")
def p_cube(spark, sf):
    d = table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).cast("double").alias("qty"))
    return d.select(F.coalesce("l_returnflag", F.lit("-")).alias("flag"), F.coalesce("l_linestatus", F.lit("-")).alias("status"), "n", "qty")


@query("p_join_agg", """select n_name as nation, count(*) as orders, round(sum(o_totalprice), 2)::double as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def p_join(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    d = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return d.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).cast("double").alias("total"))


@query("p_semi_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def p_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("p_setops", "select c_custkey as k from customer intersect select o_custkey from orders")
def p_set(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "orders").select("o_custkey"))


@query("b13_chapter_overlap_stats", BASE + CHAPTERS + """select c.vod, c.chapter, count(*) as n, sum(least(r."end", b_end) - greatest(r.start, b_start)) as seconds from chaps c join rng r on r.vod = c.vod and r."end" > b_start and r.start < b_end group by all""")
def overlap_stats(spark, sf):
    d = intervals.overlap_join(ranges(spark, sf), chapters(spark, sf), V, 21600.0)
    return d.groupBy("vod", "chapter").agg(F.count("*").alias("n"), F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("seconds"))


@query("adjust_chat_z_metrics", BASE + "select vod, round(avg(z), 6) + 0.0 as mean_z, count(*) filter (energy = 'high') as high from scored group by vod")
def adjust(spark, sf):
    return scored(spark, sf).groupBy("vod").agg((F.round(F.avg("z"), 6) + 0.0).alias("mean_z"), F.count_if(F.col("energy") == "high").alias("high"))


