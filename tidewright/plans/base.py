"""Bindings of the session entities to the test tables, in Spark and in SQL.

A session (``vod``) is a day of ``events``; a message is an event; a chapter is
a quarter of the day; a window is half an hour.  The SQL text of every oracle
starts with the same views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series

STEP = 1800


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a scan of few row groups would leave most of them idle; a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chat(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, vod, sec, user_id, kind, value, n_emotes."""
    e = table(spark, sf, "events")
    sec = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")
    return e.select("event_id", F.col("ts").cast("date").cast("string").alias("vod"), sec.alias("sec"), "user_id",
                    F.col("event_type").alias("kind"), "value", F.when(F.col("value") > 50, 1).otherwise(0).alias("n_emotes"), "props")


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per session and half hour with messages: id, bounds, chapter, mode, rate, reactions, topic, confidence."""
    c = chat(spark, sf).withColumn("win", F.floor(F.col("sec") / STEP))
    d = c.groupBy("vod", "win").agg(
        F.count("*").alias("messages"), F.sum("n_emotes").cast("long").alias("reactions"),
        F.max_by("kind", "event_id").alias("topic"), F.avg("value").alias("mean_value"), F.max("event_id").alias("last_event"))
    return d.select(
        F.concat(F.col("vod"), F.lit(":win:"), F.col("win")).alias("id"), "vod", "win", (F.col("win") * float(STEP)).alias("start"),
        ((F.col("win") + 1) * float(STEP)).alias("end"), F.floor(F.col("win") / 12).alias("chapter"),
        F.when(F.floor(F.col("win") / 12) % 2 == 0, "jc").otherwise("game").alias("mode"), "messages", "reactions", "topic",
        ((F.col("messages") + F.col("reactions")) / float(STEP)).alias("rate"), (F.col("mean_value") / 100).alias("confidence"), "last_event")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with the robust z of their chapter, burst score, energy and role."""
    from ..functions import text

    w = windows(spark, sf)
    d = series.zscore(w, "rate", ["vod", "chapter"], series.robust_baseline(w, "rate", ["vod", "chapter"]))
    d = d.withColumn("burst", series.burst_score("rate", ["vod"], "win"))
    d = d.withColumn("energy", text.energy_from_metrics(F.col("z"), F.col("burst")))
    return d.withColumn("role", text.infer_role(F.col("mode"), F.lit(None).cast("string"), F.col("z")))


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping ranges of uneven length: one per event, with a score."""
    c = chat(spark, sf)
    length = 60.0 + (F.col("event_id") % 17) * 90.0
    return c.select("event_id", "vod", F.col("sec").cast("double").alias("start"), (F.col("sec") + length).alias("end"),
                    F.floor(F.col("value")).cast("long").alias("score"), F.col("kind").alias("topic"))


def r6(c: Column | str) -> Column:
    """Six places as the SQL rounds doubles: the millionfold to a whole number.  Spark's own rounding of the decimal text differs where that is a half."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 1e6) / 1e6


BASE = f"""
with chat as (
  select event_id, cast(ts as date)::varchar as vod, (hour(ts)*3600 + minute(ts)*60 + second(ts))::bigint as sec, user_id,
         event_type as kind, value, case when value > 50 then 1 else 0 end as n_emotes, props from events),
win0 as (
  select vod, sec // {STEP} as win, count(*) as messages, sum(n_emotes)::bigint as reactions, arg_max(kind, event_id) as topic,
         avg(value) as mean_value, max(event_id) as last_event from chat group by all),
win as (
  select vod || ':win:' || win as id, vod, win, win * {STEP}.0::double as start, (win + 1) * {STEP}.0::double as "end", win // 12 as chapter,
         case when (win // 12) % 2 = 0 then 'jc' else 'game' end as mode, messages, reactions, topic,
         (messages + reactions) / {STEP}.0::double as rate, mean_value / 100 as confidence, last_event from win0),
rob0 as (select vod, chapter, list_sort(list(rate)) as v from win group by all),
rob1 as (select vod, chapter, v, v[len(v)//4 + 1] as q1, v[3*len(v)//4 + 1] as q3 from rob0),
rob2 as (select vod, chapter, v, list_filter(v, lambda e: e >= q1 - 1.5*(q3-q1) and e <= q3 + 1.5*(q3-q1)) as k from rob1),
rob3 as (select vod, chapter, unnest(case when len(k) < greatest(1, len(v)//2) then v else k end) as e from rob2),
rob as (select vod, chapter, avg(e) as mean, case when stddev_samp(e) is null or stddev_samp(e) = 0 then 1.0 else stddev_samp(e) end as std
        from rob3 group by all),
sc0 as (
  select w.*, (rate - mean) / std as z,
         rate / (0.5 * (coalesce(lag(rate) over v, rate) + coalesce(lead(rate) over v, rate)) + 1e-5) as burst
  from win w join rob using (vod, chapter) window v as (partition by vod order by win)),
scored as (
  select *, case when z > 1.0 or burst > 1.6 then 'high' when z < -0.5 and burst < 0.9 then 'low' else 'medium' end as energy,
         case when mode = 'game' then case when z >= 0.9 then 'peak' when z >= 0.75 then 'conflict' else 'filler' end else '' end as role from sc0),
rng as (
  select event_id, vod, sec::double as start, (sec + 60.0 + (event_id % 17) * 90.0)::double as "end", floor(value)::bigint as score, kind as topic
  from chat)
"""
