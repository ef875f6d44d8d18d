"""Ranking and greedy selection: spaced top-k, non-maximum suppression, arc rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import time_iou
from .fold import fold_runs, fold_select, ordered


def seed_budget(df: DataFrame, keys: list[str], mode: Column, reactions: Column) -> DataFrame:
    """Per session: number of seeds per mode and the least reactions of a seed per mode."""
    share = F.count_if(mode == "chat") / F.greatest(F.lit(1), F.count("*"))
    chat_r = F.array_sort(F.collect_list(F.when(mode == "chat", F.greatest(F.lit(0), reactions))))
    game_r = F.array_sort(F.collect_list(F.when(mode == "game", F.greatest(F.lit(0), reactions))))
    d = df.groupBy(*keys).agg(share.alias("share"), (F.max("end") - F.min("start")).alias("dur"), chat_r.alias("c"), game_r.alias("g"))
    length = F.col("share") * 55.0 + (1 - F.col("share")) * 75.0
    target = F.greatest(F.lit(3.0), F.bround(F.col("dur") * 0.12 / F.greatest(F.lit(30.0), length), 0))
    total = F.least(F.lit(24.0), F.greatest(F.lit(4.0), F.bround(target * 1.25, 0)))
    k_chat = F.greatest(F.lit(1.0), F.bround(total * F.col("share"), 0))

    def threshold(v: str, least: int) -> Column:
        n = F.size(v)
        q = F.when(n > 0, F.get(v, F.floor(0.85 * (n - 1)).cast("int")))
        return F.greatest(F.lit(least), F.coalesce(F.bround(q.cast("double"), 0), F.lit(0.0))).cast("long")

    return d.select(*keys, k_chat.cast("long").alias("k_chat"), F.greatest(F.lit(1.0), total - k_chat).cast("long").alias("k_game"),
                    threshold("c", 2).alias("min_chat"), threshold("g", 3).alias("min_game"))


def topk_spaced(df: DataFrame, keys: list[str], score: str, start: str, k: int, least: float, spacing: float, carry: list[str]) -> DataFrame:
    """The best ``k`` rows of at least ``least``, none starting within ``spacing`` of a better one; ties by start."""
    fields = {"start": F.col(start), **{c: F.col(c) for c in carry if c != "start"}}
    return fold_select(df.where(F.col(score) >= least), keys, [-F.col(score), F.col(start)], fields,
                       lambda acc, r: (F.size(acc) < k) & ~F.exists(acc, lambda a: F.abs(a["start"] - r["start"]) < spacing))


def dedup_select(df: DataFrame, keys: list[str], score: str, iou: float, spacing: float, top: int, carry: list[str]) -> DataFrame:
    """Non-maximum suppression by overlap and by distance of centres, best score first."""
    fields = {"start": F.col("start"), "end": F.col("end"), **{c: F.col(c) for c in carry}}

    def clash(a: Column, r: Column) -> Column:
        return (time_iou(a["start"], a["end"], r["start"], r["end"]) >= iou) | (
            F.abs((a["start"] + a["end"]) * 0.5 - (r["start"] + r["end"]) * 0.5) < spacing)

    free = F.lit(True) if not top else None
    return fold_select(df, keys, [-F.col(score), F.col("start"), F.col("end")], fields, lambda acc, r: (
        free if free is not None else F.size(acc) < top) & ~F.exists(acc, lambda a: clash(a, r)))


def nms_start_order(df: DataFrame, keys: list[str], score: str, iou: float = 0.0, by: str = "start") -> DataFrame:
    """Ranges that overlap none taken before, scanned by start; ``by='score'`` scans by score instead."""
    order = [F.col("start"), -F.col(score)] if by == "start" else [-F.col(score), F.col("start")]
    fields = {"start": F.col("start"), "end": F.col("end"), score: F.col(score)}
    return fold_select(df, keys, order, fields,
                       lambda acc, r: ~F.exists(acc, lambda a: time_iou(a["start"], a["end"], r["start"], r["end"]) > iou))


def suppress_dense(df: DataFrame, keys: list[str], start: str, end: str, salience: str, separation: float) -> DataFrame:
    """Anchors scanned in time; one closer than ``separation`` to the last replaces it if it is more salient."""
    fields = {"start": F.col(start), "end": F.col(end), "salience": F.col(salience)}

    def better(a: Column, r: Column, f: str) -> Column:
        return F.when(r["salience"] > a["salience"], r[f]).otherwise(a[f])

    return fold_runs(df, keys, [F.col(start)], fields, lambda a, r: r["start"] - a["end"] < separation,
                     lambda a, r: {f: better(a, r, f) for f in fields}).drop("run")


def event_nms(df: DataFrame, keys: list[str], ts: str, score: str, carry: list[str], least: float = 1.4, reach: float = 90.0,
              tie: float = 0.15) -> DataFrame:
    """Events by score; within ``reach`` of a kept one an event goes, or takes its place if about as good and later."""
    fields = {"ts": F.col(ts), "score": F.col(score), **{c: F.col(c) for c in carry}}
    grouped = df.where(F.col(score) >= least).groupBy(*keys).agg(ordered([-F.col(score), F.col(ts)], fields).alias("rows"))
    kind = grouped.schema["rows"].dataType

    def step(acc: Column, r: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: F.abs(a["ts"] - r["ts"]) <= reach), F.lit(True))
        near = F.get(acc, (at - 1).cast("int"))
        wins = (r["score"] > near["score"] + tie) | ((F.abs(r["score"] - near["score"]) <= tie) & (r["ts"] > near["ts"]))
        replaced = F.transform(acc, lambda a, i: F.when(i == at - 1, r).otherwise(a))
        return F.when(at == 0, F.concat(acc, F.array(r))).when(wins, replaced).otherwise(acc)

    kept = F.aggregate("rows", F.array().cast(kind), step)
    out = grouped.select(*keys, F.explode(kept).alias("r"))
    return out.select(*keys, *[F.col(f"r.{n}").alias(n) for n in fields])


def adaptive_cut(df: DataFrame, keys: list[str], x: str, minutes: Column, cuts=(0.70, 0.75, 0.80, 0.85, 0.90)) -> DataFrame:
    """(keys, cut): the first quantile that leaves between one and three candidates per five minutes, else the 80th."""
    v = df.groupBy(*keys).agg(F.array_sort(F.collect_list(x)).alias("v"), minutes.alias("m"))
    d = v.select(*keys, "v", "m", F.explode(F.array(*map(F.lit, cuts))).alias("q"))
    at = F.get("v", F.floor(F.col("q") * (F.size("v") - 1)).cast("int"))
    d = d.withColumn("cut", at).withColumn("n", F.size(F.filter("v", lambda e: e >= F.col("cut"))))
    fits = (F.col("n") >= F.greatest(F.lit(1.0), F.col("m") / 5)) & (F.col("n") <= F.greatest(F.lit(1.0), 3 * F.col("m") / 5))
    return d.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(fits, F.col("cut")), F.when(fits, F.col("q"))),
                                           F.max(F.when(F.col("q") == 0.80, F.col("cut")))).alias("cut"))


def detect_anchors(df: DataFrame, keys: list[str], reactions: str, salience: str, is_peak: Column) -> DataFrame:
    """Rows with at least the mean of the positive reactions; without any, salient local maxima above the 85th percentile."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_mean", F.avg(F.when(F.col(reactions) > 0, F.col(reactions))).over(w))
    first = (F.col(reactions) > 0) & (F.col(reactions) >= F.col("_mean"))
    v = F.array_sort(F.collect_list(salience).over(w))
    d = d.withColumns({"_first": F.coalesce(first, F.lit(False)), "_cut": F.get(v, F.floor(0.85 * (F.size(v) - 1)).cast("int")), "_peak": is_peak})
    d = d.withColumn("_any", F.bool_or("_first").over(w))
    return d.withColumn("anchor", F.when(F.col("_any"), F.col("_first")).otherwise(
        F.col("_peak") & (F.col(salience) >= F.col("_cut")))).drop("_mean", "_first", "_cut", "_peak", "_any")


def arc_rating(climax: Column, z: Column, reactions: Column, controversy: Column, narrative: Column) -> Column:
    """struct<hype,rating>: the measured hype of a climax and the best of it and the two judged scores, 0 to 100."""
    hype = 100 * (0.5 * F.least(F.lit(1.0), climax / 8) + 0.3 * F.least(F.lit(1.0), z / 6) + 0.2 * F.least(F.lit(1.0), reactions / 30))
    return F.struct(hype.alias("hype"), F.greatest(hype, 10 * controversy, 10 * narrative).alias("rating"))


def select_arcs(df: DataFrame, keys: list[str], low: float, high: float, rating: float, top: int) -> DataFrame:
    d = df.where((F.col("duration").between(low, high)) & (F.col("rating") >= rating))
    w = Window.partitionBy(*keys).orderBy(F.desc("rating"), "start")
    d = d.withColumn("rank", F.row_number().over(w).cast("long"))
    return d.where(F.col("rank") <= top) if top else d


def dedup_arcs(df: DataFrame, keys: list[str], apart: float = 120.0) -> DataFrame:
    """Arcs by start; one that starts within ``apart`` of a kept arc, or shares over half of the shorter, is its duplicate.

    Of two duplicates the resolved one stays, then the more confident.
    """
    fields = {"start": F.col("start"), "end": F.col("end"), "resolved": F.col("resolved"), "confidence": F.col("confidence")}

    def dup(a: Column, r: Column) -> Column:
        shared = F.least(a["end"], r["end"]) - F.greatest(a["start"], r["start"])
        shorter = F.least(a["end"] - a["start"], r["end"] - r["start"])
        return (F.abs(a["start"] - r["start"]) < apart) | (shared > 0.5 * shorter)

    grouped = df.groupBy(*keys).agg(ordered([F.col("start"), F.col("end")], fields).alias("rows"))
    kind = grouped.schema["rows"].dataType

    def step(acc: Column, r: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: dup(a, r)), F.lit(True))
        near = F.get(acc, (at - 1).cast("int"))
        wins = (r["resolved"] & ~near["resolved"]) | ((r["resolved"] == near["resolved"]) & (r["confidence"] > near["confidence"]))
        return F.when(at == 0, F.concat(acc, F.array(r))).when(
            wins, F.transform(acc, lambda a, i: F.when(i == at - 1, r).otherwise(a))).otherwise(acc)

    out = grouped.select(*keys, F.explode(F.aggregate("rows", F.array().cast(kind), step)).alias("r"))
    return out.select(*keys, *[F.col(f"r.{n}").alias(n) for n in fields])
