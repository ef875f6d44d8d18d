"""Time-series operators: activity, rolling statistics, robust baselines, salience and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chat_activity(chat: DataFrame, step: int = 1, keys: tuple[str, ...] = ("vod",)) -> DataFrame:
    """Messages, emotes and their sum per time step, with zeros for empty steps between the first and the last.

    ``chat`` has ``sec`` and ``n_emotes``.  The grid is one row per key before it is exploded.
    """
    per = chat.groupBy(*keys, F.floor(F.col("sec") / step).alias("bucket")).agg(
        F.count("*").alias("messages"), F.sum("n_emotes").cast("long").alias("emotes"))
    grid = per.groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select(
        *keys, F.explode(F.sequence("lo", "hi")).alias("bucket"))
    out = grid.join(per, [*keys, "bucket"], "left").fillna(0, ["messages", "emotes"])
    return out.withColumn("total", F.col("messages") + F.col("emotes"))


def centred(keys: list[str], order: str, width: int) -> Window:
    """Frame of ``width`` rows around a row, one more before than after when even."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)


def rolling_mean(x: str, keys: list[str], order: str, width: int) -> Column:
    return F.avg(x).over(centred(keys, order, width))


def local_zscore(x: str, keys: list[str], order: str, width: int = 60) -> Column:
    """Deviation from the centred mean in sample deviations (none or 0: 1); 0 in series shorter than ``width``."""
    w = centred(keys, order, width)
    sd = F.stddev_samp(x).over(w)
    z = (F.col(x) - F.avg(x).over(w)) / F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd)
    return F.when(F.count("*").over(Window.partitionBy(*keys)) < width, 0.0).otherwise(z)


def max_normalise(x: str, keys: list[str]) -> Column:
    top = F.max(x).over(Window.partitionBy(*keys))
    return F.when(top <= 0, 0.0).otherwise(F.col(x) / F.when(top > 0, top))


def composite_score(count: str, reaction: str, keys: list[str]) -> Column:
    return 0.6 * max_normalise(count, keys) + 0.4 * max_normalise(reaction, keys)


def moving_average(x: Column, keys: list[str], order: str, reach: int) -> Column:
    return F.avg(x).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach))


def positive_smooth(z: str, keys: list[str], order: str) -> Column:
    return moving_average(F.greatest(F.lit(0.0), F.col(z)), keys, order, 3)


def unitize(x: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi - lo < 1e-9, 1.0).otherwise((F.col(x) - lo) / F.when(hi - lo >= 1e-9, hi - lo))


def floor_quantile(x: str, q: float) -> Column:
    """Aggregate: the element at index floor(q (n-1)) of the sorted values, nulls left out; null for none."""
    vals = F.array_sort(F.collect_list(x))
    return F.when(F.size(vals) > 0, F.element_at(vals, (F.floor(F.lit(q) * (F.size(vals) - 1)) + 1).cast("int")))


def mean_std(x: Column) -> tuple[Column, Column]:
    """Aggregates: mean, and sample deviation with 1 for a single value or none."""
    sd = F.stddev_samp(x)
    return F.avg(x), F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd)


def robust_baseline(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Mean and deviation of the values within 1.5 interquartile ranges; of all values when too few are."""
    arrays = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(x)).alias("v"))
    n = F.size("v")
    q1, q3 = F.get("v", F.floor(n / 4).cast("int")), F.get("v", F.floor(3 * n / 4).cast("int"))
    arrays = arrays.withColumns({"n": n, "lo": q1 - 1.5 * (q3 - q1), "hi": q3 + 1.5 * (q3 - q1)})
    inside = F.filter("v", lambda e: (e >= F.col("lo")) & (e <= F.col("hi")))
    arrays = arrays.withColumn("k", inside)
    used = F.when(F.size("k") < F.greatest(F.lit(1), F.floor(F.col("n") / 2)), F.col("v")).otherwise(F.col("k"))
    mean, std = mean_std(F.col("e"))
    return arrays.select(*keys, F.explode(used).alias("e")).groupBy(*keys).agg(mean.alias("mean"), std.alias("std"))


def time_aware_baseline(df: DataFrame, x: str, keys: list[str], start: str, warmup: float = 1800.0) -> DataFrame:
    """The robust baseline without the warm-up, where at least max(3, n // 4) rows are left without it."""
    w = Window.partitionBy(*keys)
    late, n = F.count_if(F.col(start) >= warmup).over(w), F.count("*").over(w)
    kept = df.withColumn("_all", late < F.greatest(F.lit(3), F.floor(n / 4))).where(F.col("_all") | (F.col(start) >= warmup))
    return robust_baseline(kept.drop("_all"), x, keys)


def zscore(df: DataFrame, x: str, keys: list[str], baseline: DataFrame, name: str = "z") -> DataFrame:
    """``df`` with deviations from a baseline of one row per key."""
    return df.join(baseline, keys).withColumn(name, (F.col(x) - F.col("mean")) / F.col("std")).drop("mean", "std")


def burst_score(x: str, keys: list[str], order: str, mirror: bool = False) -> Column:
    """A rate over the mean of its neighbours' rates; the ends use themselves.

    ``mirror`` takes the next rate as 0, as a scan that has not reached it does.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    c = F.col(x)
    after = F.when(F.lead(x).over(w).isNull(), c).otherwise(F.lit(0.0)) if mirror else F.coalesce(F.lead(x).over(w), c)
    return c / (0.5 * (F.coalesce(F.lag(x).over(w), c) + after) + 1e-5)


def mode_z(z: str, keys: list[str]) -> Column:
    """z again standardised within its mode; unchanged where there is nothing to compare."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(z).over(w)
    return F.when(sd.isNull() | (sd == 0), F.col(z)).otherwise((F.col(z) - F.avg(z).over(w)) / F.when(sd != 0, sd))


def intro_adjust(df: DataFrame, z: str, role: str, keys: list[str], order: str, ahead: int = 5) -> DataFrame:
    """Leading ``intro`` rows of a chapter get the mean z of the next ``ahead`` rows of another role, or 0.

    The raw value and a flag are kept.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    other = (F.coalesce(F.col(role), F.lit("")) != "intro").cast("int")
    seen = F.sum(other).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumns({"_seen": seen, "_other": other})
    target = F.avg(F.when((F.col("_other") == 1) & (F.col("_seen") <= ahead), F.col(z))).over(Window.partitionBy(*keys))
    d = d.withColumn("_target", target)
    lead = F.col("_seen") == 0
    return d.withColumns({f"{z}_raw": F.col(z), f"{z}_adjusted": lead, z: F.when(lead, F.coalesce("_target", F.lit(0.0))).otherwise(F.col(z))}
                         ).drop("_seen", "_other", "_target")


def gap_after(start: str, end: str, keys: list[str], clamp: bool = False, tie: tuple[str, ...] = ()) -> Column:
    """Seconds to the next row's start, null at the end of a group."""
    gap = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, *tie)) - F.col(end)
    return F.greatest(F.lit(0.0), gap) if clamp else gap


def chapter_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Floor quantiles of durations and of the gaps between windows."""
    d = df.withColumns({"_dur": F.col("end") - F.col("start"), "_gap": gap_after("start", "end", keys, True)})
    return d.groupBy(*keys).agg(
        *[floor_quantile("_dur", q).alias(f"dur_q{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.95)],
        *[floor_quantile("_gap", q).alias(f"gap_q{int(q * 100)}") for q in (0.75, 0.9, 0.95)])


def rank_to_unit(x: str, keys: list[str]) -> Column:
    """Rank of the distinct value from 0 to 1."""
    w = Window.partitionBy(*keys)
    r = F.dense_rank().over(w.orderBy(x))
    distinct = F.size(F.collect_set(x).over(w))
    return (r - 1) / F.greatest(F.lit(1), distinct - 1)


def salience(df: DataFrame, keys: list[str], burst: str, z: str, reactions: str, confidence: str) -> DataFrame:
    d = df.withColumn("_zp", F.greatest(F.lit(0.0), F.col(z)))
    out = (0.45 * rank_to_unit(burst, keys) + 0.25 * rank_to_unit("_zp", keys)
           + 0.20 * rank_to_unit(reactions, keys) + 0.10 * rank_to_unit(confidence, keys))
    return d.withColumn("salience", out).drop("_zp")


def local_max(x: str, keys: list[str], order: str) -> Column:
    """Not below either neighbour and above one of them; missing neighbours are -1."""
    w = Window.partitionBy(*keys).orderBy(order)
    a, b, c = F.coalesce(F.lag(x).over(w), F.lit(-1.0)), F.coalesce(F.lead(x).over(w), F.lit(-1.0)), F.col(x)
    return (c >= a) & (c >= b) & ((c > a) | (c > b))


def quality_gate(df: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """Indicators per session and the gate: q1, or q2 and q3.

    p95 of positive z; minutes with z > 1 per hour; runs of z > 1.2 of at least 30 s per hour.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    d = df.withColumns({"_dur": F.col("end") - F.col("start"), "_zp": F.greatest(F.lit(0.0), F.col(z)), "_hot": F.col(z) > 1.2})
    d = d.withColumn("_run", F.sum((~F.col("_hot")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.where("_hot").groupBy(*keys, "_run").agg(F.sum("_dur").alias("len")).groupBy(*keys).agg(
        F.count_if(F.col("len") >= 30).alias("spikes"))
    base = d.groupBy(*keys).agg(
        floor_quantile("_zp", 0.95).alias("p95"), (F.max("end") - F.min("start")).alias("span"),
        F.coalesce(F.sum(F.when(F.col(z) > 1.0, F.col("_dur"))), F.lit(0.0)).alias("hot"))
    hours = F.greatest(F.col("span") / 3600.0, F.lit(1e-9))
    out = base.join(runs, keys, "left").select(
        *keys, "p95", (F.col("hot") / 60.0 / hours).alias("hot_minutes"), (F.coalesce("spikes", F.lit(0)) / hours).alias("clusters"))
    q1, q2, q3 = F.col("p95") >= 1, F.col("hot_minutes") >= 3, F.col("clusters") >= 2
    return out.withColumns({"q1": q1, "q2": q2, "q3": q3, "passed": q1 | (q2 & q3)})


def talkiness_mode(df: DataFrame, keys: list[str], chapter: str, words: str) -> DataFrame:
    """Chapters whose median words per second reach the session's 70th percentile talk (``jc``), the others play."""
    d = df.withColumn("_wps", F.col(words) / F.greatest(F.col("end") - F.col("start"), F.lit(1e-9)))
    p70 = d.groupBy(*keys).agg(F.percentile("_wps", F.lit(0.7)).alias("p70"))
    med = d.groupBy(*keys, chapter).agg(F.percentile("_wps", F.lit(0.5)).alias("median"))
    return med.join(p70, keys).withColumn("mode", F.when(F.col("median") >= F.col("p70"), "jc").otherwise("game")).drop("p70")


def top_peaks(df: DataFrame, keys: list[str], activity: str, order: str, top: int = 15) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(activity), order)
    return df.where(F.col(activity) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def hour_cap(df: DataFrame, keys: list[str], start: str, score: str, tie: str, top: int = 5) -> DataFrame:
    """The best ``top`` rows of every clock hour."""
    hour = F.floor(F.col(start) / 3600)
    w = Window.partitionBy(*keys, hour).orderBy(F.desc(score), tie)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)


def long_windup(anchor: Column, start: Column, end: Column, most: float = 0.75) -> Column:
    """Whether the anchor comes late in a clip; true for an empty clip."""
    length = F.greatest(F.lit(0.0), end - start)
    return (length <= 0) | ((anchor - start) / F.when(length > 0, length) > most)


def numbered(df: DataFrame, order: str, name: str, width: int = 4096) -> DataFrame:
    """``df`` with the place of each row in the order of a whole-number column, from 0 on.

    Rows are counted by ranges of ``width`` values; only these counts, one row per range, are summed up in one task.
    Equal values take places in no set order.
    """
    d = df.withColumn("_b", F.floor(F.col(order) / width))
    sums = F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    before = d.groupBy("_b").agg(F.count("*").alias("n")).select("_b", F.coalesce(sums, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1 + F.col("_before")
    return d.join(before, "_b").withColumn(name, place.cast("long")).drop("_b", "_before")
