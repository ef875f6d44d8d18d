"""Clip candidates: from groups of windows to padded, snapped, gated and deduplicated clips."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import format_hms
from . import intervals, select


@dataclass(frozen=True)
class ClipConfig:
    """Lengths in seconds, ratios, gates and spacings of clip selection."""

    clip_talk: float = 55.0
    clip_game: float = 75.0
    shortest: float = 30.0
    longest: float = 180.0
    signal_shorten: float = 15.0
    energy_shorten: float = 10.0
    reaction_shorten: float = 10.0
    talk_before: float = 0.35
    game_before: float = 0.25
    min_score: float = 4.0
    quiet_share: float = 0.2
    quiet_z: float = 0.35
    quiet_reactions: int = 5
    windup: float = 0.75
    iou: float = 0.5
    spacing: float = 45.0
    context: float = 120.0
    front: float = 10.0
    back: float = 1.0


# Words that say goodbye.
GOODBYE = ("goodbye", "good bye", "bye", "gn", "good night", "see you", "see ya", "signing off", "ending stream", "end of stream")


def goodbye_hits(text: Column) -> Column:
    """How many farewell terms a text has, each counted once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, GOODBYE)), lambda t: low.contains(t)))


def dynamic_padding(start: Column, end: Column, times: Column, smooth: Column, step: float = 5.0) -> Column:
    """struct<s,e>: the bounds moved out in steps until the smoothed activity falls below a share of its local maximum.

    ``times`` and ``smooth`` are parallel arrays of the chapter; at most 90 s to
    the left (10 to 120 s in all), 45 s to the right, 30 to 180 s long.
    """
    left, right = 90.0, 45.0

    def once(c: Column, f: Callable[[Column], Column]) -> Column:
        """``f`` of a value that is computed a single time, however often ``f`` names it."""
        return F.get(F.transform(F.array(c), f), F.lit(0))

    def nearest(near: Column, t: Column) -> Column:
        return F.array_min(F.transform(near, lambda w: F.struct(F.abs(w["t"] - t).alias("d"), w["i"].alias("i"))))["i"]

    def walk(near: Column, first: Column, reach: float, sign: int, most: Column) -> Column:
        n = int(reach / step)
        at = lambda k: first + sign * step * k
        quiet = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(smooth, nearest(near, at(k))) <= most)
        # what is nearest to the first step and to the last is so to all between
        k = once(F.struct(nearest(near, at(0)).alias("a"), nearest(near, at(n - 1)).alias("b")), lambda e: F.when(
            e["a"] == e["b"], F.when(F.get(smooth, e["a"]) <= most, 0).otherwise(n)).otherwise(F.coalesce(F.array_min(quiet), F.lit(n))))
        return at(k)

    def moved(near: Column, peak: Column) -> Column:
        s = F.greatest(start - 120.0, F.least(start - 10.0, walk(near, start, left, -1, 0.45 * peak)))
        e = F.least(walk(near, end, right, 1, 0.35 * peak), end + right)
        out = once(F.struct(s.alias("s"), e.alias("e")), lambda m: F.struct(m["s"].alias("s"), intervals.clamp_window(m["s"], m["e"]).alias("e")))
        return F.when((F.size(times) == 0) | (peak <= 0) | peak.isNull(), F.struct(start.alias("s"), end.alias("e"))).otherwise(out)

    def peak(near: Column) -> Column:
        return once(F.struct(nearest(near, start).alias("lo"), nearest(near, end).alias("hi")),
                    lambda at: F.array_max(F.slice(smooth, at["lo"] + 1, F.greatest(F.lit(1), at["hi"] + 10 - at["lo"]))))

    # of all times only those within reach, and the next on either side, can be nearest to a step
    low, high = F.least(start - left, end), F.greatest(end + right, start)
    edges = once(F.struct(low.alias("lo"), high.alias("hi")), lambda b: F.struct(
        F.array_max(F.filter(times, lambda x: x <= b["lo"])).alias("lo"), F.array_min(F.filter(times, lambda x: x >= b["hi"])).alias("hi")))
    every = F.transform(times, lambda x, i: F.struct(x.alias("t"), i.alias("i")))
    reached = once(edges, lambda b: F.filter(every, lambda w: (b["lo"].isNull() | (w["t"] >= b["lo"])) & (b["hi"].isNull() | (w["t"] <= b["hi"]))))
    return once(reached, lambda near: once(peak(near), lambda top: moved(near, top)))


def candidates(groups: DataFrame, windows: DataFrame, keys: list[str], cfg: ClipConfig = ClipConfig(), bucket: float = 3600.0) -> DataFrame:
    """Candidates from groups (start, end, anchor): a target length from the signals around, placed around the anchor,
    then gated by score, energy and wind-up.  ``windows`` has start, end, z, reactions, energy, mode.
    """
    g = groups.select(*keys, "start", "end", "anchor").withColumn("gid", F.xxhash64(*keys, "start", "end")).withColumns(
        {"lo": F.greatest(F.lit(0.0), F.col("start") - cfg.context), "hi": F.col("end") + cfg.context})
    w = windows.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"), "z", "reactions", "energy", "mode")
    around = intervals.overlap_join(g.select(*keys, "gid", F.col("lo").alias("start"), F.col("hi").alias("end")), w, keys, bucket)
    zp = F.greatest(F.lit(0.0), F.col("z"))
    seen = around.groupBy(*keys, "gid").agg(
        (F.count_if(F.col("mode") != "game") >= F.count_if(F.col("mode") == "game")).alias("talk"),
        F.avg(F.when(F.col("energy") == "high", 1.0).otherwise(0.0)).alias("high"), F.avg(zp).alias("mean_z"), F.max(zp).alias("max_z"),
        F.sum("reactions").alias("reactions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("b_start", "b_end"))))).alias("edges"))
    d = g.join(seen, [*keys, "gid"])
    length = (F.when(F.col("talk"), cfg.clip_talk).otherwise(cfg.clip_game)
              - F.when((F.col("mean_z") >= 1) & (F.col("max_z") >= 2), cfg.signal_shorten).otherwise(0.0)
              - F.when(F.col("high") >= 0.5, cfg.energy_shorten).otherwise(0.0) - F.when(F.col("reactions") >= 20, cfg.reaction_shorten).otherwise(0.0))
    d = d.withColumn("len", F.greatest(F.lit(35.0), F.least(F.lit(120.0), length)))
    before = F.when(F.col("talk"), cfg.talk_before).otherwise(cfg.game_before) * F.col("len")
    d = d.withColumn("v", F.greatest(F.col("lo"), F.least(F.col("anchor") - before, F.col("hi") - F.col("len"))))
    d = d.withColumn("x", intervals.snap(F.col("v"), F.col("v") + F.col("len"), F.col("edges"), F.col("lo"), F.col("hi"), F.col("anchor")))
    d = d.select(*keys, "gid", "anchor", F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    inner = intervals.overlap_join(d, w, keys, bucket).groupBy(*keys, "gid", "anchor", "start", "end").agg(
        (0.75 * F.avg(zp) + 0.25 * F.max(zp)).alias("score"), F.avg(F.when(F.col("energy") == "high", 1.0).otherwise(0.0)).alias("high"),
        F.sum("reactions").alias("reactions"))
    quiet = (F.col("high") < cfg.quiet_share) & (F.col("score") < cfg.quiet_z) & (F.col("reactions") < cfg.quiet_reactions)
    late = (F.col("anchor") - F.col("start")) / (F.col("end") - F.col("start")) > cfg.windup
    return inner.where((F.col("score") >= cfg.min_score) & ~quiet & ~late).select(
        *keys, "start", "end", "anchor", F.round("score", 4).alias("score"), "reactions")


def finalise(cands: DataFrame, keys: list[str], cfg: ClipConfig = ClipConfig(), top: int = 0) -> DataFrame:
    """The best non-overlapping candidates, padded, with times written out."""
    best = select.dedup_select(cands, keys, "score", cfg.iou, cfg.spacing, top, ["score", "anchor"])
    s, e = intervals.final_pad(F.col("start"), F.col("end"), cfg.front, cfg.back)
    return best.withColumns({"start": F.greatest(F.lit(0.0), s), "end": e}).withColumns(
        {"start_hms": format_hms(F.col("start")), "end_hms": format_hms(F.col("end"))})


def expand_hits(hits: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Search hits as ranges: their own bounds, or those of the windows that a moment lists in ``burst_ids``."""
    own = hits.where(F.size("burst_ids") <= 0).select(*keys, "start", "end", "topic")
    listed = hits.where(F.size("burst_ids") > 0).select(*keys, F.explode("burst_ids").alias("id"))
    return own.unionByName(listed.join(windows.select(*keys, "id", "start", "end", "topic"), [*keys, "id"]).drop("id"))


def curate(ranges: DataFrame, keys: list[str], gap: float, topic_gap: float, left: float, right: float, budget: float, length: float) -> DataFrame:
    """Merged by topic, padded, and cut to a total length."""
    m = intervals.merge_topic(ranges, keys, gap, topic_gap)
    s, e = intervals.pad(F.col("start"), F.col("end"), left, right, F.lit(length))
    return intervals.trim_to_budget(m.withColumns({"start": s, "end": e}), keys, budget)


def context_roles(clips: DataFrame, segments: DataFrame, keys: list[str], around: float = 60.0, bucket: float = 3600.0) -> DataFrame:
    """Segments around clips with their role: before, transition_in, clip, transition_out, after."""
    c = clips.select(*keys, F.col("clip"), F.col("start").alias("c_start"), F.col("end").alias("c_end"),
                     (F.col("start") - around).alias("b_start"), (F.col("end") + around).alias("b_end"))
    d = intervals.overlap_join(segments, c, keys, bucket)
    role = (F.when(F.col("end") <= F.col("c_start"), "before").when(F.col("start") >= F.col("c_end"), "after")
            .when(F.col("start") < F.col("c_start"), "transition_in").when(F.col("end") > F.col("c_end"), "transition_out").otherwise("clip"))
    return d.withColumn("context", role)
