"""Rows around an anchor of their group, and threads counted anew in each chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import islands


def around(df: DataFrame, keys: list[str], order: str, anchor: str, side: str, k: int | None = None, least: Column | None = None, most: Column | None = None) -> DataFrame:
    """Rows before (``side`` left) or after (right) the row of each group where ``anchor`` holds, nearest first as ``place``.

    With ``k`` the k nearest; else as many as it takes to reach ``least`` seconds, the row that reaches it included, and
    none once ``most`` is reached.  Groups without an anchor have no rows; of several anchors the first counts.
    """
    at = F.min(F.when(F.col(anchor), F.col(order))).over(Window.partitionBy(*keys))
    d = df.withColumn("_at", at)
    d = d.where(F.col(order) < F.col("_at")) if side == "left" else d.where(F.col(order) > F.col("_at"))
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if side == "left" else F.asc(order))
    d = d.withColumn("place", F.row_number().over(w).cast("long"))
    if k is not None:
        return d.where(F.col("place") <= k).drop("_at")
    before = F.coalesce(F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return d.withColumn("_used", before).where((F.col("_used") < least) & (F.col("_used") < most)).drop("_at", "_used")


def between(df: DataFrame, keys: list[str], order: str, first: str, second: str) -> DataFrame:
    """Rows strictly between the last row of each group where ``first`` holds and the first one where ``second`` does."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"_a": F.max(F.when(F.col(first), F.col(order))).over(w), "_b": F.min(F.when(F.col(second), F.col(order))).over(w)})
    return d.where((F.col(order) > F.col("_a")) & (F.col(order) < F.col("_b"))).drop("_a", "_b")


def boundary(df: DataFrame, keys: list[str], chapter: str, order: str, n: int = 3) -> DataFrame:
    """The last n rows of each chapter (side left) and the first n of the one after it (right), by the chapter that ends."""
    last = F.row_number().over(Window.partitionBy(*keys, chapter).orderBy(F.desc(order)))
    first = F.row_number().over(Window.partitionBy(*keys, chapter).orderBy(order))
    ended = F.lag(chapter).over(Window.partitionBy(*keys).orderBy(chapter))
    names = df.select(*keys, chapter).distinct().withColumn("ended", ended)
    left = df.withColumn("_r", last).where(F.col("_r") <= n).select(*keys, F.col(chapter).alias("ended"), F.lit("left").alias("side"), order)
    right = df.withColumn("_r", first).where(F.col("_r") <= n).join(names.where("ended is not null"), [*keys, chapter]).select(*keys, "ended", F.lit("right").alias("side"), order)
    return left.unionByName(right)


def chapter_threads(df: DataFrame, keys: list[str], chapter: str, order: str, topic: str, hint: str) -> DataFrame:
    """``df`` with ``thread``: a counter that a row leaves as it is if it goes on with the topic before it, and raises if not.

    A row goes on if ``hint`` says so, or, where the hint is null, if one of the two topics holds the other.  A change of
    chapter forgets the topic and sets the counter to zero; the first row of a session has thread 1 whatever its hint.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = islands(df, keys, [order], ~F.col(chapter).eqNullSafe(F.lag(chapter).over(w)), "_run")
    inside = Window.partitionBy(*keys, "_run").orderBy(order)
    now, prev = F.coalesce(topic, F.lit("")), F.coalesce(F.lag(topic).over(inside), F.lit(""))
    alike = (now != "") & (prev != "") & (now.contains(prev) | prev.contains(now))
    step = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.coalesce(F.col(hint), alike)).cast("int"))
    d = d.withColumn("_step", step)
    return d.withColumn("thread", F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_run", "_step")
