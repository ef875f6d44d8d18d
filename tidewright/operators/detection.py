"""Story arcs detected, scored and gated: clutch, thread and chapter arcs with their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arcs, fixpoint, semantic
from .segments import islands
from .select import nms_start_order


def _runs(df: DataFrame, keys: list[str], by: str, fits: Column) -> DataFrame:
    """(keys, arc, id) of the runs of rows that agree in ``by``, where the aggregate ``fits`` holds; empty and null values make no run."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    d = islands(df, keys, ["start", "end"], ~F.col(by).eqNullSafe(F.lag(by).over(w)), "run").where(F.length(F.col(by).cast("string")) > 0)
    good = d.groupBy(*keys, "run").agg(fits.alias("fits")).where("fits").select(*keys, "run")
    return d.join(good, [*keys, "run"]).select(*keys, F.concat_ws(":", F.lit(by), "run").alias("arc"), "id")


def candidates(df: DataFrame, keys: list[str], least: float, most: float, like: float, **reach: float) -> DataFrame:
    """(keys, arc, id): the members of every candidate; a row may be in several."""
    clutch = fixpoint.clutch_arcs(df, keys, least, most, like, **reach)
    a = clutch.select(*keys, F.concat_ws(":", F.lit("clutch"), F.col("members")[0]).alias("arc"), F.explode("members").alias("id"))
    total = F.sum(F.col("end") - F.col("start"))
    peak, closing = F.coalesce(F.bool_or(F.col("role") == "peak"), F.lit(False)), F.coalesce(F.bool_or(F.col("role").isin("resolution", "conflict")), F.lit(False))
    b = _runs(df, keys, "thread", total.between(0.8 * least, 1.3 * most))
    c = _runs(df, keys, "chapter", total.between(0.7 * least, 1.5 * most) & peak & closing)
    return a.unionByName(b).unionByName(c)


def detect(df: DataFrame, keys: list[str], least: float, most: float, like: float = 0.55, min_score: float = 0.7, min_contiguity: float = 0.6,
           max_gap: float = 180.0, max_gap_share: float = 0.4, **reach: float) -> DataFrame:
    """(keys, pos, start, end, score): the arcs of a session that overlap no arc taken before them, scanned by start.

    A candidate's score weighs coherence, contiguity, structure, signal and thread switches.  It passes with ``min_score``,
    or a little below with a peak, a closing and few holes; arcs with long or many gaps do not pass.
    ``df`` has id, start, end, topic, thread, chapter, role, energy, z, avg_z and vector.
    """
    arc = [*keys, "arc"]
    m = candidates(df, keys, least, most, like, **reach).join(df, [*keys, "id"])
    gap = F.greatest(F.lit(0.0), F.lead("start").over(Window.partitionBy(*arc).orderBy("start", "end")) - F.col("end"))
    bounds = m.withColumn("gap", gap).groupBy(*arc).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))
    d = arcs.arc_measures(m, arc).drop("penalty", "score").join(arcs.switch_penalty(m, arc, "thread", "start"), arc).join(semantic.coherence(m, arc), arc).join(bounds, arc)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    score = unit(0.6 * F.col("coherence") + 0.15 * F.col("contiguity") + 0.15 * F.col("structure") + 0.1 * unit(F.col("signal")) - 0.25 * F.col("penalty"))
    d = d.withColumn("score", F.round(score, 6))
    sure = (F.col("score") >= min_score) | ((F.col("structure") >= 1.0) & (F.col("contiguity") >= max(0.85, min_contiguity)) & (F.col("score") >= max(0.55, min_score - 0.1)))
    whole = (F.col("span") > 0) & (F.col("contiguity") >= min_contiguity) & (F.col("gap") <= max_gap) & (unit((F.col("span") - F.col("total")) / F.col("span")) <= max_gap_share)
    return nms_start_order(d.where(sure & whole).select(*keys, "start", "end", "score").distinct(), keys, "score").select(*keys, "pos", "start", "end", "score")
