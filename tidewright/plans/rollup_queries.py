"""Sketches, reconciliations, lateral joins, recursion, pivots, exact decimals, moments of all kinds, full exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reconcile, sketches
from ..registry import query
from ..sources import moments, store
from .base import BASE, chat, ranges, table, windows
from .series_queries import V

# --- sketches --------------------------------------------------------------------------------------------------------------------


@query("p_sketch_rollup", BASE + """select vod, count(*) as n, count(distinct user_id) as exact_distinct, true as distinct_held, true as q10_held, true as q50_held, true as q90_held from chat group by vod""")
def p_sketch(spark, sf):
    """Hourly sketches, kept as a table, merged to days and held against an exact pass."""
    c = chat(spark, sf)
    hours = store.keep(sketches.hourly(c, V, F.floor(F.col("sec") / 3600), "user_id", "value"), "sketches")
    told = sketches.read(sketches.rolled(hours, V), [0.1, 0.5, 0.9])
    return sketches.held(c, told, V, "user_id", "value", [0.1, 0.5, 0.9])


@query("p_sketch_whole", BASE + "select count(*) as n, count(distinct user_id) as exact_distinct, true as distinct_held, true as q50_held from chat")
def p_sketch_whole(spark, sf):
    """The same hourly sketches merged once more, over all days."""
    c = chat(spark, sf).withColumn("whole", F.lit("all"))
    days = sketches.rolled(sketches.hourly(c, ["vod", "whole"], F.floor(F.col("sec") / 3600), "user_id", "value"), ["vod", "whole"])
    told = sketches.read(sketches.rolled(days, ["whole"]), [0.5])
    return sketches.held(c, told, ["whole"], "user_id", "value", [0.5]).drop("whole")


# --- two versions of a manifest --------------------------------------------------------------------------------------------------

VERSIONS = BASE + """, va as (select event_id, start, "end", score, topic from rng where event_id % 10 <> 0),
 vb as (select event_id, start, case when event_id % 7 = 0 then "end" + 30 else "end" end as "end", case when event_id % 11 = 0 then null else score end as score, topic from rng where event_id % 10 <> 1)
"""


@query("p_manifest_reconcile", VERSIONS + """select coalesce(a.event_id, b.event_id) as event_id, case when a.event_id is null then 'added' when b.event_id is null then 'removed'
  when a."end" is distinct from b."end" or a.score is distinct from b.score then 'changed' else 'same' end as state,
  case when a.event_id is null or b.event_id is null then '' else array_to_string(list_filter([case when a."end" is distinct from b."end" then 'end' end, case when a.score is distinct from b.score then 'score' end], lambda x: x is not null), ',') end as changes
 from va a full join vb b on a.event_id = b.event_id""")
def p_reconcile(spark, sf):
    r, e = ranges(spark, sf), F.col("event_id")
    new = r.where(e % 10 != 1).withColumns({"end": F.when(e % 7 == 0, F.col("end") + 30).otherwise(F.col("end")), "score": F.when(e % 11 != 0, F.col("score"))})
    out = reconcile.by_key(r.where(e % 10 != 0), new, ["event_id"], ["start", "end", "score", "topic"])
    return out.select("event_id", "state", F.array_join("changes", ",").alias("changes"))


@query("p_overlap_reconcile", BASE + """, va as (select vod, 'a' || win as id, start, "end" from win where win % 7 <> 3),
 vb as (select vod, 'b' || win as id, start + (win % 5) * 200 as start, "end" + (win % 5) * 200 as "end" from win where win % 7 <> 5),
 o as (select a.vod, a.id as a, b.id as b, a.start as sa, b.start as sb, a."end" as ea, b."end" as eb, (least(a."end", b."end") - greatest(a.start, b.start)) / greatest(a."end" - a.start, b."end" - b.start) as share
  from va a join vb b on a.vod = b.vod and b.start < a."end" and b."end" > a.start),
 m as (select *, row_number() over (partition by vod, a order by share desc, sb, b) as ra, row_number() over (partition by vod, b order by share desc, sa, a) as rb from o),
 p as (select * from m where ra = 1 and rb = 1 and share >= 0.5)
 select vod, a as old_id, b as new_id, round(share, 6) as share, case when sa = sb and ea = eb then 'same' else 'moved' end as state from p union all
 select vod, id, null, null, 'removed' from va where (vod, id) not in (select (vod, a) from p) union all select vod, null, id, null, 'added' from vb where (vod, id) not in (select (vod, b) from p)""")
def p_overlap(spark, sf):
    w, n = windows(spark, sf), F.col("win")
    old = w.where(n % 7 != 3).select("vod", F.concat(F.lit("a"), n).alias("id"), "start", "end")
    new = w.where(n % 7 != 5).select("vod", F.concat(F.lit("b"), n).alias("id"), *[(F.col(c) + n % 5 * 200).alias(c) for c in ("start", "end")])
    return reconcile.by_overlap(old, new, V, "id", 1800.0).withColumn("share", F.round("share", 6))


# --- lateral, recursion, pivot, decimals -----------------------------------------------------------------------------------------


@query("p_lateral_topk", BASE + """select id, event_id, value, place from (select w.id, c.event_id, c.value, row_number() over (partition by w.id order by c.value desc, c.event_id) as place
 from win w join chat c on c.vod = w.vod and c.sec // 1800 = w.win) where place <= 3""")
def p_lateral(spark, sf):
    """For each window a subquery that sees it: its three messages of the highest value."""
    c = chat(spark, sf).withColumn("slot", F.floor(F.col("sec") / 1800))
    w = windows(spark, sf).select("id", "vod", "win").alias("w")
    mine = c.where((F.col("vod") == F.col("w.vod").outer()) & (F.col("slot") == F.col("w.win").outer())).orderBy(F.desc("value"), "event_id").limit(3)
    got = w.lateralJoin(mine.select("event_id", "value"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("value"), "event_id"))
    return got.select("id", "event_id", "value", place.cast("long").alias("place"))


@query("p_recursive_chains", BASE.replace("with chat", "with recursive chat") + """, c(vod, first, win, topic, length) as (select vod, win, win, topic, 1::bigint from (select *, lag(topic) over (partition by vod order by win) as p from win) where p is distinct from topic
 union all select c.vod, c.first, w.win, w.topic, length + 1 from c join win w on w.vod = c.vod and w.win = c.win + 1 and w.topic = c.topic)
 select vod, first, max(length) as length, any_value(topic) as topic from c group by vod, first""")
def p_chains(spark, sf):
    """Chains of chunks that take up their predecessor's topic, followed from their heads by recursion."""
    name = f"links_{uuid.uuid4().hex}"
    windows(spark, sf).select("vod", "win", "topic").createOrReplaceTempView(name)
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # a row per window, however many there are
    try:
        d = spark.sql(f"""with recursive heads as (select vod, win, topic from (select *, lag(topic) over (partition by vod order by win) as p from {name}) where p is distinct from topic),
 c(vod, first, win, topic, length) as (select vod, win, win, topic, cast(1 as bigint) from heads
  union all select c.vod, c.first, w.win, w.topic, c.length + 1 from c join {name} w on w.vod = c.vod and w.win = c.win + 1 and w.topic = c.topic)
 select vod, first, max(length) as length, any_value(topic) as topic from c group by vod, first""")
        return store.keep(d, "chains")  # the limit holds while it runs
    finally:
        spark.catalog.dropTempView(name)
        if before is None:
            spark.conf.unset("spark.sql.cteRecursionRowLimit")
        else:
            spark.conf.set("spark.sql.cteRecursionRowLimit", before)


TOPICS = ["click", "error", "purchase", "signup", "view"]


@query("p_pivot_counts", BASE + "select vod, " + ", ".join(f"count(*) filter (topic = '{t}') as {t}" for t in TOPICS) + ", count(*) as total from win group by vod")
def p_pivot(spark, sf):
    d = windows(spark, sf).groupBy("vod").pivot("topic", TOPICS).agg(F.count(F.lit(1)))
    counts = [F.coalesce(t, F.lit(0)).cast("long").alias(t) for t in TOPICS]
    return d.select("vod", *counts, sum((F.coalesce(t, F.lit(0)) for t in TOPICS[1:]), F.coalesce(TOPICS[0], F.lit(0))).cast("long").alias("total"))


@query("s17_colour_exact", """select event_type as kind, ((('0x' || md5(lower(event_type))[1:16])::ubigint::uhugeint * 18446744073709551616::uhugeint + ('0x' || md5(lower(event_type))[17:32])::ubigint::uhugeint) % 12)::int as colour
 from (select distinct event_type from events)""")
def s17_exact(spark, sf):
    """The whole 128-bit number modulo 12, by its halves in decimals of 20 digits (it has up to 39)."""
    d = table(spark, sf, "events").select(F.col("event_type").alias("kind")).distinct()
    high, low = (F.conv(F.substring(F.md5(F.lower("kind")), at, 16), 16, 10).cast("decimal(20,0)") % 12 for at in (1, 17))
    return d.select("kind", ((high * (2**64 % 12) + low) % 12).cast("int").alias("colour"))


# --- moments of all kinds --------------------------------------------------------------------------------------------------------

KINDS = [(name, kind, fields) for name, (kind, fields) in moments.LISTS.items()]
TEXTS = "case k " + " ".join(f"when {i} then '" + ". ".join(f"{f} ' || event_id || '" for f in fields if f not in ("to", "events")) + "'" for i, (_, _, fields) in enumerate(KINDS)) + " end"
TYPES = "case k " + " ".join(f"when {i} then '{kind}'" for i, (_, kind, _) in enumerate(KINDS)) + " end"


@query("l20_moment_documents", BASE + f""", i as (select vod, event_id, sec, event_id % {len(KINDS)} as k, sec // 21600 as c, (sec // 21600) * 21600 as o from chat where event_id % 17 <> 0),
 t as (select *, case when event_id % 3 = 0 then sec - o when event_id % 3 = 1 then sec else sec - o end::double as s, case when event_id % 3 = 1 then sec + 90 when event_id % 3 = 2 then sec - o + 45 end::double as e from i),
 f as (select *, case when s < 7200 and o > 0 then o else 0 end as shift from t),
 d as (select vod, case when k = 10 and event_id % 2 = 0 then 'round_end' else {TYPES} end as type, s + shift as start, coalesce(e, s + 30) + shift as "end",
  case when k = 10 and event_id % 2 = 0 then 'Round ' || event_id || '. we win' else {TEXTS} end as text, c::varchar as chapter_id from f)
 select vod, vod || ':mom:' || type || ':' || start::bigint as id, type, start, "end", text, chapter_id from d""")
def l20(spark, sf):
    """Analyses with all eleven lists, written as JSON from the messages: a time as text, as two numbers or as two texts, some with none."""
    c = chat(spark, sf).withColumns({"k": F.col("event_id") % len(KINDS), "c": F.floor(F.col("sec") / 21600)})
    e, local = F.col("event_id"), F.col("sec") - F.col("c") * 21600
    fields = sorted({f for _, _, fs in KINDS for f in fs} - {"to", "events"})
    texts = {f: F.when(F.array_contains(F.array(*[F.lit(i) for i, (_, _, fs) in enumerate(KINDS) if f in fs]), F.col("k").cast("int")), F.concat(F.lit(f + " "), e)) for f in fields}
    won = (F.col("k") == 10) & (e % 2 == 0)
    texts["description"] = F.when(won, F.concat(F.lit("Round "), e)).otherwise(texts["description"])
    texts["event"] = F.when(won, "we win").otherwise(texts["event"])
    stamp = lambda s: F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    item = F.to_json(F.struct(*[t.alias(f) for f, t in texts.items()], F.when((e % 17 != 0) & (e % 3 == 0), stamp(local)).alias("timestamp")))
    numbers = F.concat(F.lit(',"start":'), F.col("sec"), F.lit(',"end":'), (F.col("sec") + 90).cast("double"), F.lit("}"))
    words = F.concat(F.lit(',"start":"'), stamp(local), F.lit('","end":"'), stamp(local + 45), F.lit('"}'))
    ended = F.when(e % 17 == 0, item).when(e % 3 == 1, F.concat(F.substring(item, 1, F.length(item) - 1), numbers)).when(
        e % 3 == 2, F.concat(F.substring(item, 1, F.length(item) - 1), words)).otherwise(item)
    lists = [F.concat(F.lit(f'"{name}":['), F.array_join(F.collect_list(F.when(F.col("k") == i, ended)), ","), F.lit("]")) for i, (name, _, _) in enumerate(KINDS)]
    # one text for at most a thousand messages of a chunk: a session's analysis may come in any number of texts
    chunk = c.groupBy("vod", "c", F.floor(e / 1000)).agg(F.concat(F.lit('{"chunk_index":'), F.first("c"), F.lit(',"start_time":'), F.first("c") * 21600, F.lit(","), F.concat_ws(",", *lists), F.lit("}")).alias("chunk"))
    whole = chunk.select("vod", F.concat(F.lit('{"chunks":['), F.col("chunk"), F.lit("]}")).alias("value"))
    # texts are small and long to read: they go over all cores, where their bytes alone would give them one task
    return moments.documents(whole.repartition(4 * spark.sparkContext.defaultParallelism), V)
