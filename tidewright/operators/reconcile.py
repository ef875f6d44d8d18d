"""Two versions of a set of ranges reconciled: by key, and by overlap where keys changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join


def by_key(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, state, changes): a full outer join on ``keys``; state is added, removed, changed or same.

    ``changes`` names the values that differ (a null and a value differ, two nulls do not).  Keys are unique in a version;
    null keys match nothing and count as removed and added.
    """
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    d = a.join(b, keys, "full")
    names = F.array_compact(F.array(*[F.when(~F.col("_old")[v].eqNullSafe(F.col("_new")[v]), F.lit(v)) for v in values]))
    state = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
             .when(F.size(names) > 0, "changed").otherwise("same"))
    differ = F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull(), names).otherwise(F.array().cast("array<string>"))
    return d.select(*keys, state.alias("state"), differ.alias("changes"))


def by_overlap(old: DataFrame, new: DataFrame, keys: list[str], ident: str, bucket: float, least: float = 0.5) -> DataFrame:
    """(keys, old_<ident>, new_<ident>, share, state): ranges (start, end) of two versions matched by their overlap.

    A range is matched with the one that it shares most time with (ties: the earlier, then the smaller id), if both
    choose each other and the shared time is at least ``least`` of the longer one: moved, or same where the bounds agree.
    The rest of either version is removed or added.  The join is by session and time bucket, never all pairs.
    """
    a = old.select(*keys, "start", "end", F.col(ident).alias("a"))
    b = new.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col(ident).alias("b"))
    both = overlap_join(a, b, keys, bucket)
    common = F.least("end", "b_end") - F.greatest("start", "b_start")
    both = both.withColumn("share", common / F.greatest(F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start")))
    best_b = F.row_number().over(Window.partitionBy(*keys, "a").orderBy(F.desc("share"), "b_start", "b"))
    best_a = F.row_number().over(Window.partitionBy(*keys, "b").orderBy(F.desc("share"), "start", "a"))
    pairs = both.withColumns({"ra": best_b, "rb": best_a}).where((F.col("ra") == 1) & (F.col("rb") == 1) & (F.col("share") >= least))
    pairs = pairs.select(*keys, "a", "b", "share", ((F.col("start") == F.col("b_start")) & (F.col("end") == F.col("b_end"))).alias("still"))
    d = a.select(*keys, "a").join(pairs, [*keys, "a"], "left").withColumnRenamed("b", "_b").join(
        b.select(*keys, F.col("b").alias("_b"), "b"), [*keys, "_b"], "full")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("still"), "same").otherwise("moved")
    return d.select(*keys, F.col("a").alias(f"old_{ident}"), F.col("b").alias(f"new_{ident}"), "share", state.alias("state"))
