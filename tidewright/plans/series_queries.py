"""Queries of sections C and K: activity, baselines, salience, gates, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from ..registry import query
from .base import BASE, chat, r6, ranges, scored, table, windows

V = ["vod"]
VC = ["vod", "chapter"]
ACT = BASE + """, per as (select vod, sec // 3600 as bucket, count(*) as messages, sum(n_emotes)::bigint as emotes from chat group by all),
grid as (select vod, unnest(generate_series(min(bucket), max(bucket))) as bucket from per group by vod),
act as (select g.vod, g.bucket, coalesce(messages, 0) as messages, coalesce(emotes, 0) as emotes, coalesce(messages, 0) + coalesce(emotes, 0) as total
        from grid g left join per using (vod, bucket))
"""


def _activity(spark, sf):
    return series.chat_activity(chat(spark, sf), 3600)


@query("c01_chat_activity", ACT + "select vod, bucket, messages, emotes, total from act")
def c01(spark, sf):
    return _activity(spark, sf)


@query("c02_densify", ACT + "select vod, count(*) as buckets, count(*) filter (total = 0) as empty from act group by vod")
def c02(spark, sf):
    return _activity(spark, sf).groupBy("vod").agg(F.count("*").alias("buckets"), F.count_if(F.col("total") == 0).alias("empty"))


@query("c03_rolling_mean", ACT + """select vod, bucket, round(avg(total) over (partition by vod order by bucket rows between 2 preceding and 2 following), 6)
 as smooth from act""")
def c03(spark, sf):
    return _activity(spark, sf).select("vod", "bucket", r6(series.rolling_mean("total", V, "bucket", 5)).alias("smooth"))


@query("c04_local_z", ACT + """select vod, bucket, round(case when count(*) over (partition by vod) < 6 then 0.0 else
 (total - avg(total) over f) / case when stddev_samp(total) over f is null or stddev_samp(total) over f = 0 then 1.0 else stddev_samp(total) over f end end, 6) as z
 from act window f as (partition by vod order by bucket rows between 3 preceding and 2 following)""")
def c04(spark, sf):
    return _activity(spark, sf).select("vod", "bucket", r6(series.local_zscore("total", V, "bucket", 6)).alias("z"))


@query("c05_max_normalise", ACT + "select vod, bucket, round(total / max(total) over (partition by vod)::double, 6) as x from act")
def c05(spark, sf):
    return _activity(spark, sf).select("vod", "bucket", r6(series.max_normalise("total", V)).alias("x"))


@query("c06_composite", ACT + """select vod, bucket, round(0.6 * messages / max(messages) over p + case when max(emotes) over p <= 0 then 0 else
 0.4 * emotes / max(emotes) over p end, 6) as score from act window p as (partition by vod)""")
def c06(spark, sf):
    return _activity(spark, sf).select("vod", "bucket", r6(series.composite_score("messages", "emotes", V)).alias("score"))


@query("c07_chat_baseline", ACT + "select vod, round(avg(total), 6) as baseline from act group by vod")
def c07(spark, sf):
    return _activity(spark, sf).groupBy("vod").agg(r6(F.avg("total")).alias("baseline"))


@query("c08_moving_average", BASE + """select vod, win, round(avg(rate * 1000) over (partition by vod order by win rows between 5 preceding and 5 following), 6)
 as ma from win""")
def c08(spark, sf):
    return windows(spark, sf).select("vod", "win", r6(series.moving_average(F.col("rate") * 1000, V, "win", 5)).alias("ma"))


@query("c09_positive_smooth", BASE + """select vod, win, round(avg(greatest(0.0, z)) over (partition by vod, chapter order by win
 rows between 3 preceding and 3 following), 6) as smooth from scored""")
def c09(spark, sf):
    return scored(spark, sf).select("vod", "win", r6(series.positive_smooth("z", VC, "win")).alias("smooth"))


@query("c10_unitize", BASE + """select vod, win, round(case when max(rate) over p - min(rate) over p < 1e-9 then 1.0 else
 (rate - min(rate) over p) / (max(rate) over p - min(rate) over p) end, 6) as u from win window p as (partition by vod)""")
def c10(spark, sf):
    return windows(spark, sf).select("vod", "win", r6(series.unitize("rate", V)).alias("u"))


@query("c11_chat_rate", BASE + "select vod, win, messages, reactions, round(rate, 6) as rate from win")
def c11(spark, sf):
    return windows(spark, sf).select("vod", "win", "messages", "reactions", r6("rate").alias("rate"))


@query("c12_mean_std", BASE + """select vod, chapter, round(avg(rate) * 1000, 6) as mean, round(case when stddev_samp(rate) is null or stddev_samp(rate) = 0 then 1.0
 else stddev_samp(rate) end * 1000, 6) as std from win group by all""")
def c12(spark, sf):
    m, s = series.mean_std(F.col("rate"))
    return windows(spark, sf).groupBy(*VC).agg(r6(m * 1000).alias("mean"), r6(s * 1000).alias("std"))


@query("c13_robust_baseline", BASE + "select vod, chapter, round(mean * 1000, 6) as mean, round(std * 1000, 6) as std from rob")
def c13(spark, sf):
    d = series.robust_baseline(windows(spark, sf), "rate", VC)
    return d.select("vod", "chapter", r6(F.col("mean") * 1000).alias("mean"), r6(F.col("std") * 1000).alias("std"))


@query("c14_time_aware_baseline", BASE + """, late as (select *, count(*) filter (start >= 7200) over (partition by vod) as n_late, count(*) over (partition by vod) as n from win),
 used as (select vod, rate from late where start >= 7200 or n_late < greatest(3, n // 4)),
 a as (select vod, list_sort(list(rate)) as v from used group by vod), b as (select vod, v, v[len(v)//4 + 1] as q1, v[3*len(v)//4 + 1] as q3 from a),
 c as (select vod, v, list_filter(v, lambda e: e >= q1 - 1.5*(q3-q1) and e <= q3 + 1.5*(q3-q1)) as k from b),
 d as (select vod, unnest(case when len(k) < greatest(1, len(v)//2) then v else k end) as e from c)
 select vod, round(avg(e) * 1000, 6) as mean, round(case when stddev_samp(e) is null or stddev_samp(e) = 0 then 1.0 else stddev_samp(e) end * 1000, 6) as std from d group by vod""")
def c14(spark, sf):
    d = series.time_aware_baseline(windows(spark, sf), "rate", V, "start", 7200.0)
    return d.select("vod", r6(F.col("mean") * 1000).alias("mean"), r6(F.col("std") * 1000).alias("std"))


@query("c15_chat_z", BASE + "select vod, win, round(rate, 6) as rate, round(z, 6) as z from scored")
def c15(spark, sf):
    return scored(spark, sf).select("vod", "win", r6("rate").alias("rate"), r6("z").alias("z"))


@query("c16_burst", BASE + "select vod, win, round(burst, 6) as burst from scored")
def c16(spark, sf):
    return windows(spark, sf).select("vod", "win", r6(series.burst_score("rate", V, "win")).alias("burst"))


@query("c17_mode_z", BASE + """select vod, win, round(case when stddev_samp(z) over p is null or stddev_samp(z) over p = 0 then z else
 (z - avg(z) over p) / stddev_samp(z) over p end, 5) + 0.0 as mz from scored window p as (partition by vod, mode)""")
def c17(spark, sf):
    return scored(spark, sf).select("vod", "win", (F.round(series.mode_z("z", ["vod", "mode"]), 5) + 0.0).alias("mz"))


@query("c18_intro_z_adjust", BASE + """, r as (select *, case when win % 12 < 3 then 'intro' else 'body' end as part from scored),
 s as (select *, sum(case when part <> 'intro' then 1 else 0 end) over (partition by vod, chapter order by win) as seen from r),
 t as (select *, avg(z) filter (part <> 'intro' and seen <= 5) over (partition by vod, chapter) as target from s)
 select vod, win, round(case when seen = 0 then coalesce(target, 0.0) else z end, 6) as z, round(z, 6) as z_raw, seen = 0 as z_adjusted from t""")
def c18(spark, sf):
    d = scored(spark, sf).withColumn("part", F.when(F.col("win") % 12 < 3, "intro").otherwise("body"))
    return series.intro_adjust(d, "z", "part", VC, "win").select("vod", "win", r6("z").alias("z"), r6("z_raw").alias("z_raw"), "z_adjusted")


@query("c19_gaps", BASE + """select vod, event_id, round(lead(start) over (partition by vod order by start, event_id) - "end", 6) as gap from rng""")
def c19(spark, sf):
    d = ranges(spark, sf).withColumn("gap", series.gap_after("start", "end", V, tie=("event_id",)))
    return d.select("vod", "event_id", r6("gap").alias("gap"))


@query("c20_gaps_clamped", BASE + """select vod, win, greatest(0.0, lead(start) over (partition by vod order by start) - "end") as gap from win""")
def c20(spark, sf):
    return windows(spark, sf).select("vod", "win", series.gap_after("start", "end", V, True).alias("gap"))


Q = "v[floor({q} * (len(v) - 1))::int + 1]"


@query("c21_chapter_stats", BASE + f""", r as (select vod, "end" - start as dur, greatest(0.0, lead(start) over (partition by vod order by start) - "end") as gap from win),
 l as (select vod, list_sort(list(dur)) as v, list_sort(list(gap) filter (gap is not null)) as g from r group by vod)
 select vod, {', '.join(f"{Q.format(q=q)} as dur_q{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.95))},
 {', '.join(f"{Q.format(q=q).replace('v[', 'g[').replace('len(v)', 'len(g)')} as gap_q{int(q * 100)}" for q in (0.75, 0.9, 0.95))} from l""")
def c21(spark, sf):
    return series.chapter_stats(windows(spark, sf), V)


@query("c22_rank_unit", BASE + """, r as (select vod, win, dense_rank() over (partition by vod order by reactions) as d from win)
 select vod, win, round((d - 1) / greatest(1, max(d) over (partition by vod) - 1)::double, 6) as r from r""")
def c22(spark, sf):
    return windows(spark, sf).select("vod", "win", r6(series.rank_to_unit("reactions", V)).alias("r"))


SAL = BASE + """, rk as (select *, dense_rank() over (p order by burst) as d1, dense_rank() over (p order by greatest(0.0, z)) as d2,
 dense_rank() over (p order by reactions) as d3, dense_rank() over (p order by confidence) as d4 from scored window p as (partition by vod, chapter)),
 sal as (select *, 0.45 * (d1 - 1) / greatest(1, max(d1) over p - 1) + 0.25 * (d2 - 1) / greatest(1, max(d2) over p - 1)
 + 0.20 * (d3 - 1) / greatest(1, max(d3) over p - 1) + 0.10 * (d4 - 1) / greatest(1, max(d4) over p - 1) as salience from rk window p as (partition by vod, chapter))
"""


def salient(spark, sf):
    return series.salience(scored(spark, sf), VC, "burst", "z", "reactions", "confidence")


@query("c23_salience", SAL + "select vod, win, round(salience, 5) as salience from sal")
def c23(spark, sf):
    return salient(spark, sf).select("vod", "win", F.round("salience", 5).alias("salience"))


@query("c24_local_max", BASE + """, n as (select vod, win, reactions as x, coalesce(lag(reactions) over v, -1) as a, coalesce(lead(reactions) over v, -1) as b from win
 window v as (partition by vod order by win)) select vod, win, x >= a and x >= b and (x > a or x > b) as peak from n""")
def c24(spark, sf):
    return windows(spark, sf).select("vod", "win", series.local_max("reactions", V, "win").alias("peak"))


GATE = BASE + """, h as (select *, z > 1.2 as hot, sum(case when z > 1.2 then 0 else 1 end) over (partition by vod order by start) as run from scored),
 c as (select vod, run, sum("end" - start) as len from h where hot group by all), cl as (select vod, count(*) filter (len >= 30) as n from c group by vod),
 b as (select vod, list_sort(list(greatest(0.0, z))) as v, (max("end") - min(start)) / 3600.0 as hours, coalesce(sum("end" - start) filter (z > 1.0), 0.0) as hot from scored group by vod),
 g as (select vod, v[floor(0.95 * (len(v) - 1))::int + 1] as p95, hot / 60.0 / hours as hot_minutes, coalesce(n, 0) / hours as clusters from b left join cl using (vod))
"""


@query("c25_hot_minutes", GATE + "select vod, round(hot_minutes, 6) as hot_minutes from g")
def c25(spark, sf):
    return series.quality_gate(scored(spark, sf), V).select("vod", r6("hot_minutes").alias("hot_minutes"))


@query("c26_spike_clusters", GATE + "select vod, round(clusters, 6) as clusters from g")
def c26(spark, sf):
    return series.quality_gate(scored(spark, sf), V).select("vod", r6("clusters").alias("clusters"))


@query("c27_p95_z", GATE + "select vod, round(p95, 6) as p95 from g")
def c27(spark, sf):
    return series.quality_gate(scored(spark, sf), V).select("vod", r6("p95").alias("p95"))


@query("c28_gate", GATE + """select vod, p95 >= 1 as q1, hot_minutes >= 3 as q2, clusters >= 2 as q3, p95 >= 1 or (hot_minutes >= 3 and clusters >= 2) as passed from g""")
def c28(spark, sf):
    return series.quality_gate(scored(spark, sf), V).select("vod", "q1", "q2", "q3", "passed")


@query("c29_talkiness_mode", BASE + """, t as (select vod, chapter, messages / 1800.0::double as wps from win), p as (select vod, quantile_cont(wps, 0.7) as p70 from t group by vod)
 select t.vod, chapter, round(median(wps), 6) as median, case when median(wps) >= p70 then 'jc' else 'game' end as mode from t join p using (vod) group by t.vod, chapter, p70""")
def c29(spark, sf):
    return series.talkiness_mode(windows(spark, sf), V, "chapter", "messages").select("vod", "chapter", r6("median").alias("median"), "mode")


@query("c30_top_chat_peaks", BASE + "select vod, win, messages from win where messages > 3 qualify row_number() over (partition by vod order by messages desc, win) <= 15")
def c30(spark, sf):
    d = windows(spark, sf).where("messages > 3")
    return series.top_peaks(d, V, "messages", "win").select("vod", "win", "messages")


@query("c31_hour_cap", BASE + """select event_id, sec // 3600 as hour, row_number() over (partition by vod, sec // 3600 order by value desc, event_id) as rn from chat
 qualify rn <= 5""")
def c31(spark, sf):
    d = series.hour_cap(chat(spark, sf), V, "sec", "value", "event_id")
    return d.select("event_id", F.floor(F.col("sec") / 3600).alias("hour"), F.col("rn").cast("long").alias("rn"))


@query("k01_by_second", BASE + """select vod, count(*) as n, sum(n_emotes)::bigint as emotes, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean from chat group by vod""")
def k01(spark, sf):
    return chat(spark, sf).groupBy("vod").agg(F.count("*").alias("n"), F.sum("n_emotes").cast("long").alias("emotes"), F.min("value").alias("lo"),
                                              F.max("value").alias("hi"), r6(F.avg("value")).alias("mean"))


@query("k02_reaction_total", BASE + "select vod, sec // 1800 as win, count(*) filter (n_emotes = 1) as total from chat group by all")
def k02(spark, sf):
    c = chat(spark, sf).withColumn("win", F.floor(F.col("sec") / 1800)).groupBy("vod", "win", "kind").agg(F.sum("n_emotes").alias("n"))
    m = c.groupBy("vod", "win").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("hits"))
    return m.select("vod", "win", F.aggregate(F.map_values("hits"), F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("k07_floor_quantile", BASE + ", l as (select vod, list_sort(list(reactions)) as v from win group by vod) select vod, v[floor(0.85 * (len(v) - 1))::int + 1] as q from l")
def k07(spark, sf):
    return windows(spark, sf).groupBy("vod").agg(series.floor_quantile("reactions", 0.85).alias("q"))


@query("k08_percentile", BASE + "select vod, round(quantile_cont(messages, 0.75), 6) as p75, round(median(messages), 6) as median from win group by vod")
def k08(spark, sf):
    return windows(spark, sf).groupBy("vod").agg(r6(F.percentile("messages", F.lit(0.75))).alias("p75"), r6(F.percentile("messages", F.lit(0.5))).alias("median"))


@query("k12_grouped_counts", BASE + """select coalesce(mode, 'all') as mode, coalesce(topic, 'all') as topic, count(*) as n from win group by grouping sets ((mode), (topic), ())""")
def k12(spark, sf):
    d = windows(spark, sf).groupingSets([["mode"], ["topic"], []], "mode", "topic").agg(F.count("*").alias("n"))
    return d.select(F.coalesce("mode", F.lit("all")).alias("mode"), F.coalesce("topic", F.lit("all")).alias("topic"), "n")


@query("k15_variation", BASE + "select vod, round(stddev_samp(messages) / avg(messages), 6) as cv from win group by vod having count(*) > 1")
def k15(spark, sf):
    return windows(spark, sf).groupBy("vod").agg(r6(F.stddev_samp("messages") / F.avg("messages")).alias("cv"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("m_json_props", "select event_id, json_extract(props, '$.k')::bigint as k from events")
def m_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("o02_last_seen", "select user_id, max(ts) as last_ts from events group by user_id")
def o02(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
