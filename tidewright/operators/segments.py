"""Segmentation of time: grids, gap sessions, thresholds, splits and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold_runs


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number runs of rows; a run begins where ``breaks`` holds (or is null, at the first row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("int"))
    return d.withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_b")


def tumbling(df: DataFrame, keys: list[str], step: float, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, win, n): a grid from the first start to the last end, members by overlap."""
    span = df.groupBy(*keys).agg(F.min(start).alias("lo"), F.max(end).alias("hi"))
    a = F.floor((F.col(start) - F.col("lo")) / step)
    b = F.ceil((F.col(end) - F.col("lo")) / step) - 1
    last = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / step) - 1, F.lit(0))
    d = df.join(span, keys)
    cells = d.select(*keys, "lo", F.explode(F.sequence(a, F.greatest(a, F.least(b, last)))).alias("win"))
    return cells.groupBy(*keys, "win").agg(F.count("*").alias("n"), (F.min("lo") + F.col("win") * step).alias("start"))


def gap_sessions(df: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Sessions of rows not more than ``gap`` seconds apart."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    d = islands(df, keys, [start, end], F.col(start) - F.lag(end).over(w) > gap, "session")
    return d.groupBy(*keys, "session").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def knee_point(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """(keys, knee): the sorted value at the largest second difference, the first of equals; of fewer than three values the last."""
    w = Window.partitionBy(*keys).orderBy(x)
    d = df.where(F.col(x).isNotNull()).withColumns({"_d": F.col(x) - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w), "_n": F.row_number().over(w)})
    bend = F.when(F.col("_d").isNotNull(), F.struct("_d", -F.col("_n")))
    return d.groupBy(*keys).agg(F.when(F.count("*") < 3, F.max(x)).otherwise(F.max_by(x, bend)).alias("knee"))


def otsu_threshold(df: DataFrame, x: str, keys: list[str], bins: int = 50) -> DataFrame:
    """(keys, otsu): the bin centre that separates the values best into two classes."""
    span = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_of = F.when(width == 0, bins // 2).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("lo")) / F.when(width != 0, width))))
    hist = df.join(span, keys).groupBy(*keys, bin_of.cast("int").alias("bin")).count()
    grid = span.select(*keys, "lo", "hi", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    centre = F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5 + (F.col("bin") + 0.5) / bins).otherwise(
        F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    d = grid.join(hist, [*keys, "bin"], "left").withColumns({"p": F.coalesce("count", F.lit(0)) / F.col("n"), "c": centre})
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*keys).orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({"w0": F.sum("p").over(before), "w1": F.sum("p").over(here),
                       "m0": F.sum(F.col("p") * F.col("c")).over(before), "m1": F.sum(F.col("p") * F.col("c")).over(here)})
    var = F.when((F.col("w0") > 0) & (F.col("w1") > 0), F.col("w0") * F.col("w1") * F.pow(
        F.col("m0") / F.when(F.col("w0") > 0, F.col("w0")) - F.col("m1") / F.when(F.col("w1") > 0, F.col("w1")), F.lit(2)))
    return d.withColumn("v", F.coalesce(F.round(var, 12), F.lit(0.0))).groupBy(*keys).agg(
        F.max_by("c", F.struct("v", -F.col("bin"))).alias("otsu"))


def pause_threshold(gaps: DataFrame, x: str, keys: list[str], default: float = 2.0) -> DataFrame:
    """(keys, threshold): the median of knee point, Otsu and 75th percentile of the positive gaps, 0.5 to 10 s."""
    pos = gaps.where(F.col(x) > 0)
    a = knee_point(pos, x, keys).join(pos.groupBy(*keys).agg(F.percentile(x, F.lit(0.75)).alias("p75")), keys)
    every = gaps.select(*keys).distinct()
    mid = F.get(F.array_sort(F.array("knee", "otsu", "p75")), F.lit(1))
    out = a.join(otsu_threshold(pos, x, keys), keys).select(*keys, F.greatest(F.lit(0.5), F.least(F.lit(10.0), mid)).alias("threshold"))
    return every.join(out, keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(default)))


def contiguous(df: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Runs of windows that touch."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return islands(df, keys, ["start", "end"], F.abs(F.col("start") - F.lag("end").over(w)) >= tolerance, "run")


def absorb_short(df: DataFrame, keys: list[str], least: float = 10.0) -> DataFrame:
    """Windows shorter than ``least`` merge into the one before; the first stays."""
    d = islands(df, keys, ["start", "end"], (F.col("end") - F.col("start") >= least) | (
        F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) == 1), "run")
    return d.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def merge_short(df: DataFrame, keys: list[str], short: float = 7.0, gap: float = 2.0) -> DataFrame:
    """A segment grows over the next ones while it is shorter than ``short`` and they follow within ``gap``; texts are joined."""
    fields = {"start": F.col("start"), "end": F.col("end"), "text": F.col("text")}
    return fold_runs(df, keys, [F.col("start"), F.col("end")], fields,
                     lambda a, r: (a["end"] - a["start"] < short) & (r["start"] - a["end"] < gap),
                     lambda a, r: {"end": r["end"], "text": F.concat_ws(" ", a["text"], r["text"])})


def bridge_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each end moves to one second before the next start, if that is later."""
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return df.withColumn("end", F.greatest("end", F.coalesce(after - 1, F.col("end"))))


def split_at(df: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Windows cut at every edge strictly inside them; ``edges`` has one array ``edges`` per key."""
    d = df.join(edges, keys, "left")
    inside = F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: (e > F.col("start")) & (e < F.col("end")))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("start", "end"), inside)))
    pairs = F.arrays_zip(F.slice(cuts, 1, F.size(cuts) - 1).alias("s"), F.slice(cuts, 2, F.size(cuts) - 1).alias("e"))
    return d.withColumn("_p", F.explode(pairs)).withColumns({"start": F.col("_p.s"), "end": F.col("_p.e")}).drop("_p", "edges")


def overlapping_chunks(df: DataFrame, t: Column, step: float, ahead: float) -> DataFrame:
    """Rows with each chunk they belong to: chunk k is [k step, (k+1) step + ahead)."""
    last = F.floor(t / step)
    first = F.greatest(F.lit(0), F.floor((t - ahead) / step))
    return df.withColumn("chunk", F.explode(F.sequence(first, last)))


def chunk_count(total: Column, step: float = 1800.0) -> Column:
    return F.greatest(F.lit(1), F.floor(total / step).cast("long") + 1)


def chunk_by_elapsed(df: DataFrame, keys: list[str], limit: float = 1200.0) -> DataFrame:
    """Chunks whose rows start less than ``limit`` seconds after the chunk's first row."""
    fields = {"start": F.col("start"), "last": F.col("start"), "n": F.lit(1).cast("long")}
    return fold_runs(df, keys, [F.col("start")], fields, lambda a, r: r["start"] - a["start"] < limit,
                     lambda a, r: {"last": r["start"], "n": a["n"] + 1})


def slice_range(start: Column, end: Column, longest: float, tail: float = 10.0) -> Column:
    """array<struct<s,e>> of slices of at most ``longest`` seconds; a tail below ``tail`` joins the slice before if that is short."""
    n = F.greatest(F.lit(1), F.ceil((end - start) / longest))
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(
        (start + i * longest).alias("s"), F.least(end, start + (i + 1) * longest).alias("e")))


def text_blocks(df: DataFrame, keys: list[str], span: float = 30.0) -> DataFrame:
    """Blocks of text: a block grows until a segment would end more than ``span`` seconds after its start."""
    fields = {"start": F.col("start"), "end": F.col("end"), "text": F.col("text")}
    out = fold_runs(df, keys, [F.col("start"), F.col("end")], fields, lambda a, r: r["end"] - a["start"] <= span,
                    lambda a, r: {"end": r["end"], "text": F.concat_ws(" ", a["text"], r["text"])})
    return out.withColumn("line", F.concat(F.lit("("), F.col("start").cast("long"), F.lit("s) "), F.col("text")))


def evenly_spaced(count: Column, lo: Column, hi: Column) -> Column:
    """``count`` sample times from ``lo`` to ``hi``."""
    gap = F.when(count > 1, (hi - lo) / (count - 1)).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: lo + i * gap)


def head_tail(total: Column) -> Column:
    """Length of the head and tail windows of a session; sessions below 300 s pass whole."""
    return F.when(total < 300, total).otherwise(F.least(F.lit(600.0), F.greatest(F.lit(300.0), total / 2)))
