"""Pictures for arcs: each arc in turn takes the best picture that is left, near ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select(arcs: DataFrame, pictures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, arc, name, source, score): one picture per arc of a session, in order of the arcs.

    ``arcs`` has keys and ``arc`` (a whole number); ``pictures`` has keys, name, source (the arc it was taken from, or
    null) and score.  Of the pictures that no arc has, the highest score wins, equal scores by name: first among those
    whose source is the arc itself or next to it, then among those whose source no arc has used (or that have none),
    then among all.  Pictures without a name are passed over; an arc for which nothing is left has no row.

    A session with n arcs uses at most n pictures of one source, and of one source always the best that are left, so
    only the n best of each source enter the fold over the session's arcs, however many pictures there are.
    """
    n = arcs.groupBy(*keys).agg(F.array_sort(F.collect_set("arc")).alias("arcs"))
    order = [F.desc("score"), F.col("name")]
    named = pictures.where(F.length("name") > 0).join(n.select(*keys, F.size("arcs").alias("n")), keys)
    first = named.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "source").orderBy(*order))).where("r <= n")
    picture = F.struct((-F.col("score")).alias("o"), "name", F.col("source").cast("long").alias("source"), "score")
    sets = n.join(first.groupBy(*keys).agg(F.array_sort(F.collect_list(picture)).alias("ps")), keys)
    one = "struct<arc:long,name:string,source:long,score:double>"

    def pick(acc: Column, arc: Column) -> Column:
        left = F.filter("ps", lambda p: ~F.exists(acc, lambda a: a["name"] == p["name"]))
        near = F.filter(left, lambda p: F.abs(p["source"] - arc) <= 1)
        fresh = F.filter(left, lambda p: p["source"].isNull() | ~F.exists(acc, lambda a: a["source"].eqNullSafe(p["source"])))
        best = F.coalesce(F.get(near, F.lit(0)), F.get(fresh, F.lit(0)), F.get(left, F.lit(0)))
        taken = F.struct(arc.cast("long").alias("arc"), best["name"].alias("name"), best["source"].alias("source"), best["score"].cast("double").alias("score"))
        return F.when(best.isNull(), acc).otherwise(F.concat(acc, F.array(taken.cast(one))))

    taken = F.aggregate("arcs", F.array().cast(f"array<{one}>"), pick)
    return sets.select(*keys, F.explode(taken).alias("t")).select(*keys, "t.*")
