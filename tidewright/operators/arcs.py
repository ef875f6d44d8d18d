"""Story arcs: resolution events, rounds, arc detection and arc scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .fold import fold_runs
from .segments import islands


def resolution_candidates(df: DataFrame, keys: list[str], hits: str, z: str, burst: str) -> DataFrame:
    """Windows whose reactions suggest an ending: score from token confidences and boosters, with the reasons."""
    entries = F.map_entries(hits)
    score = F.aggregate(entries, F.lit(0.0), lambda a, e: a + text.token_confidence(e["key"]) * F.least(F.lit(3.0), e["value"].cast("double")))
    sure = F.transform(F.filter(entries, lambda e: (e["value"] > 0) & (text.token_confidence(e["key"]) >= 0.75)), lambda e: e["key"])
    up_z, up_b = F.coalesce(F.col(z) >= 0.6, F.lit(False)), F.coalesce(F.col(burst) >= 1.3, F.lit(False))
    total = score + F.when(up_z, 0.2).otherwise(0.0) + F.when(up_b, 0.2).otherwise(0.0)
    none = F.array().cast("array<string>")
    reasons = F.concat(F.array_sort(sure), F.when(up_z, F.array(F.lit("chat_z"))).otherwise(none), F.when(up_b, F.array(F.lit("burst_score"))).otherwise(none))
    d = df.withColumns({"ts": F.col("end"), "score": total, "reasons": reasons, "_sure": F.size(sure) > 0})
    return d.where((F.col("score") > 0) & (F.col("_sure") | (F.col("score") >= 1.2))).select(*keys, "ts", "score", "reasons")


def apply_resolution(ranges: DataFrame, events: DataFrame, keys: list[str], tail: float = 120.0) -> DataFrame:
    """Each range with its best event in the last half (at least ``tail`` seconds) and past 60 % of its length."""
    r, e = ranges.select(*keys, "start", "end"), events.select(*keys, "ts", "score")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (r[k] == e[k])
    length = F.col("end") - F.col("start")
    window = F.greatest(F.lit(tail), 0.5 * length)
    ok = (F.col("ts") <= F.col("end")) & (F.col("ts") >= F.col("start")) & (F.col("ts") >= F.col("end") - window) & (
        F.col("ts") >= F.col("start") + 0.6 * length)
    hit = r.join(e, cond & ok).select(*[r[k] for k in keys], "start", "end", "ts", "score")
    best = hit.groupBy(*keys, "start", "end").agg(F.max_by("ts", F.struct("score", "ts")).alias("resolution_ts"))
    return ranges.join(best, [*keys, "start", "end"], "left").withColumn("has_resolution", F.col("resolution_ts").isNotNull())


def resolution_quality(events: DataFrame, keys: list[str], expected: float = 600.0) -> DataFrame:
    """Per chapter: whether it is played in rounds, judged from strong resolutions and their spacing."""
    w = Window.partitionBy(*keys).orderBy("ts")
    strong = events.where(F.col("score") >= 2).withColumn("_gap", F.col("ts") - F.lag("ts").over(w))
    d = strong.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_gap").alias("gap"), F.min("_gap").alias("least"))
    crowded = (F.col("gap") < max(180.0, 0.3 * expected)) & (F.col("least") < 90)
    kept = F.when(F.coalesce(crowded, F.lit(False)), F.greatest(F.lit(2), F.ceil(F.col("n") / 2))).otherwise(F.col("n")).cast("long")
    return d.select(*keys, "n", kept.alias("kept"), (kept >= 2).alias("round_based"))


def merge_resolutions(events: DataFrame, keys: list[str], apart: float = 300.0) -> DataFrame:
    """Resolutions closer than ``apart`` to the last kept one: the stronger stays."""
    fields = {"ts": F.col("ts"), "score": F.col("score")}

    def stronger(a: Column, r: Column, f: str) -> Column:
        return F.when(r["score"] > a["score"], r[f]).otherwise(a[f])

    return fold_runs(events, keys, [F.col("ts")], fields, lambda a, r: r["ts"] - a["ts"] < apart,
                     lambda a, r: {f: stronger(a, r, f) for f in fields})


def assign_rounds(ranges: DataFrame, boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges with the round of their midpoint: rounds end at the boundaries ``ts``, what follows the last is a round too."""
    a = ranges.withColumns({"_t": (F.col("start") + F.col("end")) / 2, "_k": F.lit(1)})
    b = boundaries.select(*keys, F.col("ts").alias("_t"), F.lit(0).alias("_k"))
    w = Window.partitionBy(*keys).orderBy("_t", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    d = a.unionByName(b, allowMissingColumns=True).withColumn("round", F.sum((F.col("_k") == 0).cast("long")).over(w))
    return d.where("_k = 1").drop("_t", "_k")


def round_confidence(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence in rounds from their lengths: outliers, long rounds and the first lose, evenness wins; 0 to 1."""
    w = Window.partitionBy(*keys)
    d = rounds.withColumn("_d", F.col("end") - F.col("start"))
    v = F.array_sort(F.collect_list("_d").over(w))
    n = F.size(v)
    median = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    cv = F.stddev_samp("_d").over(w) / F.avg("_d").over(w)
    first = F.row_number().over(w.orderBy("start")) == 1
    c = (1.0 - F.when(F.col("_d") > 2.5 * median, 0.3).otherwise(0.0) - F.when(first, 0.5).otherwise(0.0)
         - F.when(first & (F.col("_d") > 1800), 0.3).otherwise(0.0) - F.when(F.col("_d") > 2400, 0.3).otherwise(0.0)
         + F.when(F.coalesce(cv < 0.3, F.lit(False)), 0.2).otherwise(0.0))
    return d.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).drop("_d")


def cluster_rounds(rounds: DataFrame, keys: list[str], target: float, least: float = 0.5) -> DataFrame:
    """Neighbouring confident rounds packed to about ``target`` seconds."""
    fields = {"start": F.col("start"), "end": F.col("end"), "n": F.lit(1).cast("long")}
    return fold_runs(rounds.where(F.col("confidence") >= least), keys, [F.col("start")], fields,
                     lambda a, r: r["end"] - a["start"] <= target, lambda a, r: {"end": r["end"], "n": a["n"] + 1})


def cluster_ranges(df: DataFrame, keys: list[str], least: float, most: float, sim: float) -> DataFrame:
    """Ranges joined while shorter than ``least``, or while on one topic and not longer than ``most``."""
    fields = {"start": F.col("start"), "end": F.col("end"), "topic": F.col("topic"), "n": F.lit(1).cast("long")}

    def like(a: Column, r: Column) -> Column:
        dt = F.greatest(F.lit(0.0), r["start"] - a["end"])
        return 0.7 * 0.5 + 0.2 * F.exp(-dt / 600.0) + 0.1 * F.when(a["topic"] == r["topic"], 1.0).otherwise(0.0)

    return fold_runs(df, keys, [F.col("start"), F.col("end")], fields,
                     lambda a, r: (r["end"] - a["start"] <= most) & ((a["end"] - a["start"] < least) | (like(a, r) >= sim)),
                     lambda a, r: {"end": F.greatest(a["end"], r["end"]), "topic": r["topic"], "n": a["n"] + 1})


def thread_arcs(df: DataFrame, keys: list[str], thread: str, least: float, most: float) -> DataFrame:
    """Runs of one thread between 0.8 of the least and 1.3 of the greatest length."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    d = islands(df, keys, ["start", "end"], F.col(thread) != F.lag(thread).over(w), "run")
    out = d.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first(thread).alias(thread), F.count("*").alias("n"))
    length = F.col("end") - F.col("start")
    return out.where((length >= 0.8 * least) & (length <= 1.3 * most)).drop("run")


def chapter_arcs(df: DataFrame, keys: list[str], chapter: str, least: float, most: float, peak: Column, closing: Column) -> DataFrame:
    """Runs of one chapter, 0.7 to 1.5 of the bounds, with a peak and a resolution or conflict."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    d = islands(df.withColumns({"_p": peak, "_c": closing}), keys, ["start", "end"], F.col(chapter) != F.lag(chapter).over(w), "run")
    out = d.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first(chapter).alias(chapter),
                                      F.bool_or("_p").alias("_p"), F.bool_or("_c").alias("_c"))
    length = F.col("end") - F.col("start")
    return out.where((length >= 0.7 * least) & (length <= 1.5 * most) & F.col("_p") & F.col("_c")).drop("run", "_p", "_c")


def is_peak_like(role: Column, z: Column, energy: Column) -> Column:
    return F.coalesce((role == "peak") | ((z >= 0.6) & (energy == "high")), F.lit(False))


def role_nearby(role: str, wanted: list[str], keys: list[str], order: str, lo: int, hi: int) -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(lo, hi)
    return F.coalesce(F.bool_or(F.col(role).isin(*wanted)).over(w), F.lit(False))


def switch_penalty(df: DataFrame, keys: list[str], key: str, order: str, cap: float = 0.4) -> DataFrame:
    """Share of neighbours with different keys, at most ``cap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_s", (F.col(key) != F.lag(key).over(w)).cast("int"))
    share = F.sum("_s") / F.greatest(F.lit(1), F.count("*") - 1)
    return d.groupBy(*keys).agg(F.least(F.lit(cap), F.coalesce(share, F.lit(0.0))).alias("penalty"))


def arc_measures(df: DataFrame, keys: list[str]) -> DataFrame:
    """contiguity, structure, signal, switch and score of groups of windows (z, energy, role, thread, chapter)."""
    n = F.count("*")

    counts = {}
    for c in ("thread", "chapter"):
        counts[c] = df.groupBy(*keys, c).agg(n.alias("k")).groupBy(*keys).agg(F.max("k").alias(f"top_{c}"))
    d = df.groupBy(*keys).agg(
        n.alias("n"), (F.max("end") - F.min("start")).alias("span"), F.sum(F.col("end") - F.col("start")).alias("total"),
        F.bool_or(is_peak_like(F.col("role"), F.col("z"), F.col("energy"))).alias("peak"),
        F.bool_or(F.col("role").isin("resolution", "conflict")).alias("closing"),
        F.max("z").alias("max_z"), F.bool_or(F.col("energy") == "high").alias("high"))
    d = d.join(counts["thread"], keys).join(counts["chapter"], keys).join(switch_penalty(df, keys, "topic", "start"), keys)
    contiguity = F.when(F.col("span") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("total") / F.when(F.col("span") > 0, F.col("span")))))
    structure = (F.when(F.col("peak") & F.col("closing"), 1.0).when(F.col("top_thread") >= 0.7 * F.col("n"), 0.7)
                 .when(F.col("top_chapter") >= 0.7 * F.col("n"), 0.6).otherwise(0.0))
    signal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("max_z"))) + F.when(F.col("high"), 0.1).otherwise(0.0)
    out = d.withColumns({"contiguity": contiguity, "structure": structure, "signal": signal})
    return out.withColumn("score", 0.6 * 0.8 + 0.15 * F.col("contiguity") + 0.15 * F.col("structure") + 0.1 * F.col("signal") - 0.25 * F.col("penalty"))


def climax(arcs: DataFrame, windows: DataFrame, keys: list[str], reach: float = 30.0) -> DataFrame:
    """Per arc (id, b_start, b_end: its climax) the best window around it by 0.4 z, 0.3 burst, 0.3 reactions,
    reported with 0.1 of the reactions, and the sums over all windows there."""
    from .intervals import overlap_join

    around = arcs.select(*keys, "arc", (F.col("b_start") - reach).alias("b_start"), (F.col("b_end") + reach).alias("b_end"))
    d = overlap_join(windows.select(*keys, "start", "end", "z", "burst", "reactions"), around, keys, 3600.0, True)
    pick = 0.4 * F.col("z") + 0.3 * F.col("burst") + 0.3 * F.col("reactions")
    told = 0.4 * F.col("z") + 0.3 * F.col("burst") + 0.1 * F.col("reactions")
    return d.groupBy(*keys, "arc").agg(F.max_by("start", F.struct(pick, -F.col("start"))).alias("climax_start"),
                                       F.max_by(told, F.struct(pick, -F.col("start"))).alias("climax_score"),
                                       F.max("z").alias("peak_z"), F.sum("reactions").alias("reactions"))


def is_talk(metadata: Column, mode: Column, name: Column) -> Column:
    """Whether a chapter is talk: by its metadata, else its windows' mode, else its name."""
    by_name = F.lower(F.coalesce(name, F.lit(""))).rlike("just chatting|just_chatting|irl|talk")
    return F.coalesce(metadata, F.when(mode.isin("jc", "game"), mode == "jc"), by_name)
