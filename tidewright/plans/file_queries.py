"""Queries that write files from the tables, read them back and count what is there; picture choice; the session machine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pictures, segments
from ..registry import query
from ..sources import arc_files, clip_files, store
from ..streaming import machine
from .base import BASE, chat, ranges, table
from .series_queries import V

# --- clip lists of chapters ------------------------------------------------------------------------------------------------------

LISTS = BASE + """, k as (select *, 'ch' || (sec // 21600) as chapter, sec::double as s, case when event_id % 13 = 0 then sec - 1 else sec + 60 + (event_id % 17) * 90 end::double as e from chat),
 fl as (select vod, chapter, count(*) as n, count(*) filter (kind = 'error') as bad, count(*) % 7 = 0 as broken from k group by all),
 cl as (select k.*, e > s as fit from k join fl using (vod, chapter) where kind = 'purchase' and not broken)
"""


def clip_lists(spark, sf):
    """One list per session and quarter of a day; where the number of messages is divisible by 7 the text is no JSON."""
    c = chat(spark, sf).withColumn("chapter", F.concat(F.lit("ch"), F.floor(F.col("sec") / 21600)))
    end = F.when(F.col("event_id") % 13 == 0, F.col("sec") - 1).otherwise(F.col("sec") + 60 + (F.col("event_id") % 17) * 90)
    clip = F.when(F.col("kind") == "purchase", F.struct(F.col("sec").cast("double").alias("start_time"), end.cast("double").alias("end_time"),
                                                        F.col("event_id").cast("string").alias("title"), F.col("value").alias("score")))
    d = c.groupBy("vod", "chapter").agg(F.array_sort(F.collect_list(clip)).alias("missed_highlights"), F.count("*").alias("total_evaluated"), F.count_if(F.col("kind") == "error").alias("bad"))
    said = F.when(F.col("bad") % 3 != 0, F.concat("bad", F.lit(" rejected"))).otherwise("").alias("rejection_summary")
    body = F.to_json(F.struct("missed_highlights", "total_evaluated", said))
    return d.select("vod", "chapter", F.when(F.col("total_evaluated") % 7 == 0, "cut off [").otherwise(body).alias("json"))


def clip_store(spark, sf):
    path = store.folder(spark, "clips")
    clip_files.write(clip_lists(spark, sf), path)
    return clip_files.read(spark, path)


@query("a17_unified_clips", LISTS + """, t as (select vod, sum(case when broken then 0 else n end)::bigint as total_evaluated, string_agg(chapter, ',' order by chapter) as source_chapters, count(*) as files,
  string_agg(case when not broken and bad % 3 <> 0 then chapter || ': ' || bad || ' rejected' end, ' | ' order by chapter) as said from fl group by vod),
 c as (select vod, count(*) filter (fit) as n, arg_min(event_id::varchar, s * 10 + chapter[3:]::int) filter (fit) as first, sum(e - s) filter (fit) as seconds from cl group by vod)
 select vod, total_evaluated, coalesce(n, 0)::bigint as clips_selected, seconds, coalesce(said, 'Combined from ' || files || ' chapters') as rejection_summary, source_chapters from t left join c using (vod)""")
def a17_unified(spark, sf):
    """The files of all chapters, written, read with their paths and united per session."""
    u = clip_files.unified(clip_store(spark, sf))
    seconds = F.aggregate("missed_highlights", F.lit(0.0), lambda a, c: a + c["end_time"] - c["start_time"])
    return u.select("vod", "total_evaluated", "clips_selected", F.when(F.col("clips_selected") > 0, seconds).alias("seconds"), "rejection_summary",
                    F.array_join("source_chapters", ",").alias("source_chapters"))


@query("a17_rejected_clips", LISTS + """select vod, chapter, 'no JSON object' as reason, 1::bigint as n from fl where broken union all
 select vod, chapter, 'ends before it begins', count(*) from cl where not fit group by all""")
def a17_rejected(spark, sf):
    return clip_files.rejected(clip_store(spark, sf)).groupBy("vod", "chapter", "reason").agg(F.count("*").alias("n"))


@query("s12_clip_provenance", LISTS + """select vod, chapter as source_chapter, 'vod=' || vod || '/chapter=' || chapter as file, event_id::varchar as title from cl where fit""")
def s12(spark, sf):
    """Every clip with the chapter and the folder of the file that it came from."""
    c = clip_files.clips(clip_store(spark, sf))
    return c.select("vod", "source_chapter", F.regexp_extract("file", "(vod=[^/]*/chapter=[^/]*)/", 1).alias("file"), "title")


# --- arc manifests ---------------------------------------------------------------------------------------------------------------

HMS = "lpad(({0}::bigint // 3600)::varchar, 2, '0') || ':' || lpad(({0}::bigint // 60 % 60)::varchar, 2, '0') || ':' || lpad(({0}::bigint % 60)::varchar, 2, '0')"
ARCS = BASE + f""", ro as (select *, max("end") over (partition by vod order by start, event_id rows between unbounded preceding and 1 preceding) as reach from rng),
 ra as (select *, sum(case when reach is null or start - reach > 120 then 1 else 0 end) over (partition by vod order by start, event_id) as arc from ro),
 rg as (select *, greatest(0.0, lead(start) over (partition by vod, arc order by start, event_id) - "end") as gap from ra),
 aa as (select vod, arc, count(*) as total_ranges, sum("end" - start) as total, min(start) as start_abs, arg_max("end", start * 1e7 + event_id) as end_abs, coalesce(max(gap), 0.0) as gap from rg group by all),
 ab as (select *, row_number() over (partition by vod order by start_abs) as arc_index, end_abs - start_abs as span, {HMS.format('start_abs')} as start_hms, {HMS.format('end_abs')} as end_hms from aa)
"""


@query("a26_sink_arc_manifests", ARCS + """select vod, arc_index, total_ranges, total as total_duration_seconds, start_hms, end_hms, span as span_seconds, round(total / span, 3) as contiguity_ratio,
 gap as max_internal_gap, round((span - total) / span, 3) as gap_fraction, 'vod=' || vod || '/item=arc_' || lpad(arc_index::varchar, 3, '0') as manifest, count(*) over (partition by vod) as num_arcs,
 'Arc ' || lpad(arc_index::varchar, 3, '0') || ': ' || start_hms || ' -> ' || end_hms as line from ab""")
def a26(spark, sf):
    """One file per arc, the summary and the index are written; the rows are the index as it is read back."""
    reach = F.max("end").over(Window.partitionBy("vod").orderBy("start", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    d = segments.islands(ranges(spark, sf), V, ["start", "event_id"], F.col("start") - reach > 120, "arc")
    path = store.folder(spark, "arcs")
    arc_files.write_arcs(d, "arc", "event_id", path)
    index = arc_files.read_index(spark, path, f"num_arcs long, arcs array<struct<{arc_files.SPAN.replace(' ', ':').replace(',:', ',')},manifest:string>>")
    one = index.select("vod", "parsed.num_arcs", "lines", F.posexplode("parsed.arcs").alias("at", "a"))
    line = F.regexp_extract(F.get("lines", "at"), r"^(.*?)  \(span=", 1)
    return one.select("vod", *[f"a.{n}" for n in ("arc_index", "total_ranges", "total_duration_seconds", "start_hms", "end_hms", "span_seconds", "contiguity_ratio", "max_internal_gap", "gap_fraction", "manifest")],
                      "num_arcs", line.alias("line"))


SHOWN = """case when {0} < 60 then {0}::bigint || 's' when {0} < 3600 then ({0}::bigint // 60) || 'm' || case when {0}::bigint % 60 > 0 then ' ' || ({0}::bigint % 60) || 's' else '' end
 else ({0}::bigint // 3600) || 'h' || case when {0}::bigint % 3600 // 60 > 0 then ' ' || ({0}::bigint % 3600 // 60) || 'm' else '' end end"""


@query("a27_sink_llm_arc_manifest", BASE + f""", t as (select *, row_number() over (partition by vod order by start, event_id) - 1 as arc_index, "end" - start as duration, repeat(topic || ' ', (event_id % 30)::int) as summary from rng where score >= 60),
 d as (select *, {SHOWN.format('duration')} as duration_display, {HMS.format('start')} as start_hms, {HMS.format('"end"')} as end_hms from t)
 select vod, arc_index, start, "end", duration, duration_display, topic as arc_type, score / 100.0::double as confidence, case when length(summary) > 100 then summary[1:100] || '...' else summary end as summary,
  'vod=' || vod || '/item=arc_' || lpad(arc_index::varchar, greatest(3, length(arc_index::varchar))::int, '0') as manifest, sum(duration) over (partition by vod) as total_duration,
  'Arc ' || lpad(arc_index::varchar, greatest(3, length(arc_index::varchar))::int, ' ') || ': ' || start_hms || ' -> ' || end_hms || ' (' || lpad(duration_display, 10, ' ') || ') [' || topic || ']' as line from d""")
def a27(spark, sf):
    r = ranges(spark, sf).where("score >= 60")
    arcs = r.select("vod", "start", "end", F.col("topic").alias("arc_type"), F.lit(None).cast("string").alias("chapter"), (F.col("score") / 100).alias("confidence"), (F.col("score") / 10).alias("rating"),
                    F.expr("repeat(topic || ' ', cast(event_id % 30 as int))").alias("summary"), "event_id")
    path = store.folder(spark, "told")
    arc_files.write_told(arcs, ["start", "event_id"], path)
    index = arc_files.read_index(spark, path, f"total_duration double, arcs array<struct<{arc_files.TOLD.replace(' ', ':').replace(',:', ',')},manifest:string>>")
    one = index.select("vod", "parsed.total_duration", "lines", F.posexplode("parsed.arcs").alias("at", "a"))
    return one.select("vod", *[f"a.{n}" for n in ("arc_index", "start", "end", "duration", "duration_display", "arc_type", "confidence", "summary", "manifest")], "total_duration",
                      F.get("lines", "at").alias("line"))


@query("s24_raw_arcs", BASE + """, c as (select vod, sec // 21600 as chunk_index, count(*) as n from chat group by all), a as (select *, start::bigint // 21600 as chunk_index from rng),
 x as (select vod, chunk_index, count(*) filter (score >= 80) as arcs, count(*) filter (score < 5) as filler from a group by all)
 select vod, chunk_index, arcs as arc_count, filler as filler_count, n || ' messages' as chunk_summary, sum(arcs) over (partition by vod)::bigint as total_arcs, sum(filler) over (partition by vod)::bigint as total_filler_segments
 from c join x using (vod, chunk_index)""")
def s24(spark, sf):
    """Raw arcs, filler and chunks as one text per session, written and read back."""
    r = ranges(spark, sf).withColumn("chunk_index", F.floor(F.col("start") / 21600))
    chunks = chat(spark, sf).groupBy("vod", F.floor(F.col("sec") / 21600).alias("chunk_index")).agg(F.concat(F.count("*"), F.lit(" messages")).alias("chunk_summary")).withColumn("incomplete_arc", F.lit(False))
    told = arc_files.chunk_results(chunks, r.where("score >= 80").withColumn("arc_type", F.col("topic")), r.where("score < 5").withColumn("reason", F.col("topic")))
    path = store.folder(spark, "chunks")
    told.select("vod", F.col("json").alias("value")).write.partitionBy("vod").text(path)
    d = spark.read.text(path).select(F.from_json("value", arc_files.CHUNKS).alias("j"))
    d = d.select("j.vod_id", F.size("j.arcs").cast("long").alias("total_arcs"), F.size("j.filler_segments").cast("long").alias("total_filler_segments"), F.explode("j.chunks").alias("c"))
    return d.select(F.col("vod_id").alias("vod"), "c.chunk_index", "c.arc_count", "c.filler_count", "c.chunk_summary", "total_arcs", "total_filler_segments")


@query("a31_ranked_files", BASE + "select vod, row_number() over (partition by vod order by score desc, event_id) as rank, event_id, score, count(*) over (partition by vod) as items from rng")
def a31_files(spark, sf):
    path = store.folder(spark, "ranked")
    arc_files.write_ranked(ranges(spark, sf).select("vod", "event_id", "score"), "vod", "score", "event_id", path)
    rows = spark.read.schema("rank long, event_id long, score long, vod string").option("header", True).csv(f"{path}/csv")
    items = spark.read.text(f"{path}/json").select(F.from_json("value", "vod_id string, items array<struct<rank:long>>").alias("j"))
    return rows.join(items.select(F.col("j.vod_id").alias("vod"), F.size("j.items").cast("long").alias("items")), "vod")


# --- picture choice --------------------------------------------------------------------------------------------------------------

@query("g15_select_cam", BASE.replace("with chat", "with recursive chat") + """, ar as (select vod, list_sort(list(distinct sec // 7200)) as arcs from chat group by vod),
 pc as (select vod, list({'name': 'p' || event_id, 'source': case when event_id % 9 <> 0 then sec // 7200 end, 'score': value} order by value desc, 'p' || event_id) as ps from chat where kind in ('click', 'error') and event_id % 3 = 0 group by vod),
 f as (select vod, 0::bigint as i, cast([] as struct(arc bigint, name varchar, source bigint, score double)[]) as got from ar join pc using (vod) union all
  select vod, i + 1, case when best is null then got else list_append(got, {'arc': arc, 'name': best.name, 'source': best.source, 'score': best.score}) end from (
   select vod, i, got, arc, coalesce(list_filter(rest, lambda p: abs(p.source - arc) <= 1)[1],
     list_filter(rest, lambda p: p.source is null or not list_contains(list_transform(got, lambda g: g.source), p.source))[1], rest[1]) as best from (
    select vod, i, got, arcs[i + 1] as arc, list_filter(ps, lambda p: not list_contains(list_transform(got, lambda g: g.name), p.name)) as rest from f join ar using (vod) join pc using (vod) where i < len(arcs)))),
 l as (select vod, unnest(got) as g from f join ar using (vod) where i = len(arcs))
 select vod, g.arc as arc, g.name as name, g.source as source, g.score as score from l""")
def g15(spark, sf):
    """Arcs are the two-hour blocks of a day, pictures a third of its clicks and errors, some without a source."""
    c = chat(spark, sf).withColumn("arc", F.floor(F.col("sec") / 7200))
    p = c.where("kind in ('click', 'error') and event_id % 3 = 0").select("vod", F.concat(F.lit("p"), "event_id").alias("name"), F.when(F.col("event_id") % 9 != 0, F.col("arc")).alias("source"), F.col("value").alias("score"))
    return pictures.select(c.select("vod", "arc").distinct(), p, V)


# --- the session machine ---------------------------------------------------------------------------------------------------------

GRACE, WATCHDOG = 43200, 86400


@query("o01_stream_sessions", f"""with recursive c as (select user_id as stream, floor(epoch(ts))::bigint as sec, event_type in ('view', 'click', 'purchase') as live, (floor(epoch(ts))::bigint // 129600) * 100 as length from events),
 n as (select *, row_number() over (partition by stream order by sec, live, length) as i from c),
 f as (select distinct stream, 0::bigint as i, null::varchar as st, 0::bigint as began, 0::bigint as len, 0::bigint as stab, 0::bigint as last, 0::bigint as since,
   null::varchar as reason, 0::bigint as t_began, 0::bigint as t_at, 0::bigint as t_len from c union all
  select stream, i, case when live then 'RECORDING' when s0 is null then null when length > len then 'RECORDING' when done is not null then null else 'FINALIZING' end,
   case when live and s0 is null then sec else began end, case when live and s0 is null then greatest(0, length) else greatest(len, length) end,
   case when live then case when s0 is null or length > len then 0 else stab end when length > len then 0 else stab + 1 end,
   case when live then sec else last end, case when live then 0 when s0 = 'RECORDING' then sec else since end,
   case when w then 'watchdog' else done end, began, case when w then since + {WATCHDOG} else sec end, len from (
    select *, case when not live and s0 is not null and length <= len then case when stab + 1 >= 2 then 'stable' when sec - last >= {GRACE} then 'grace' end end as done from (
     select n.stream, n.i, n.sec, n.live, n.length, f.began, f.len, f.stab, f.last, f.since, f.st = 'FINALIZING' and n.sec >= f.since + {WATCHDOG} as w,
      case when f.st = 'FINALIZING' and n.sec >= f.since + {WATCHDOG} then null else f.st end as s0 from f join n on n.stream = f.stream and n.i = f.i + 1))),
 e as (select * from f qualify row_number() over (partition by stream order by i desc) = 1)
 select stream, t_began as began, t_at as "at", t_len as length, reason from f where reason is not null union all
 select stream, began, since + {WATCHDOG}, len, 'watchdog' from e where st = 'FINALIZING' and since + {WATCHDOG} < (select max(epoch(ts)) - 3600 from events)""")
def o01_sessions(spark, sf):
    """The checks of every user as a stream in three spans of time, with a restart after each."""
    e = table(spark, sf, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    checks = e.select(F.col("user_id").cast("long").alias("stream"), "ts", F.col("event_type").isin("view", "click", "purchase").alias("live"), (F.floor(at / 129600) * 100).alias("length"))
    return machine.replay(checks, "1 hour", grace=GRACE, watchdog=WATCHDOG)
