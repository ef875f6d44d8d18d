"""Grouping, keep sets, smoothing and blocks over the windows of a chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold_runs
from .segments import islands



def reaction_arcs(df: DataFrame, keys: list[str], gap: float = 40.0, most: float = 180.0) -> DataFrame:
    """Neighbouring groups merged while the gap and the whole length stay small."""
    fields = {"start": F.col("start"), "end": F.col("end"), "reactions": F.col("reactions"), "n": F.lit(1).cast("long")}
    return fold_runs(df, keys, [F.col("start"), F.col("end")], fields,
                     lambda a, r: (r["start"] - a["end"] <= gap) & (F.greatest(a["end"], r["end"]) - a["start"] <= most),
                     lambda a, r: {"end": F.greatest(a["end"], r["end"]), "reactions": a["reactions"] + r["reactions"], "n": a["n"] + 1})


def extend_by_thread(df: DataFrame, seeds: DataFrame, keys: list[str], order: str, thread: str, same_prev: str) -> DataFrame:
    """(keys, seed, lo, hi): the run of rows that continue a seed's thread, or are marked as the same topic as before."""
    w = Window.partitionBy(*keys).orderBy(order)
    goes_on = (F.col(thread) == F.lag(thread).over(w)) | F.col(same_prev)
    d = islands(df, keys, [order], ~F.coalesce(goes_on, F.lit(False)), "run")
    span = d.groupBy(*keys, "run").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    return seeds.join(d.select(*keys, order, "run"), [*keys, order]).join(span, [*keys, "run"]).drop("run")


def majority(x: str, order: str) -> Column:
    """Aggregate: the most frequent value, the one that came first on a tie."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x"))))
    vals = F.filter(F.transform(rows, lambda r: r["x"]), lambda v: v.isNotNull())
    votes = F.transform(F.array_distinct(vals), lambda v: F.struct(
        F.size(F.filter(vals, lambda y: y == v)).alias("n"), (-F.array_position(vals, v)).alias("p"), v.alias("v")))
    return F.array_max(votes)["v"]


def energy_rank(c: Column) -> Column:
    return F.when(c == "high", 2).when(c == "low", 0).otherwise(1)


def energy_name(c: Column) -> Column:
    return F.when(c == 2, "high").when(c == 0, "low").otherwise("medium")


def merge_chunk(df: DataFrame, keys: list[str], order: str = "start") -> DataFrame:
    """One row per group: bounds, majority topic, highest energy, joined summaries, best confidence, all reactions, highest z."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "summary"))), lambda r: r["summary"]), " ")
    return df.groupBy(*keys).agg(
        majority("topic", order).alias("topic"), F.substring(text, 1, 140).alias("summary"), F.min("start").alias("start"),
        F.max("end").alias("end"), energy_name(F.max(energy_rank(F.col("energy")))).alias("energy"),
        F.max("confidence").alias("confidence"), F.sum("reactions").alias("reactions"), F.max("z").alias("z"),
        F.count("*").alias("n"))


def keep_gameplay(anchor: Column, role: Column) -> Column:
    return F.coalesce(anchor | role.isin("peak", "conflict", "resolution"), F.lit(False))


def keep_gameplay_active(anchor: Column, role: Column, z: Column, burst: Column) -> Column:
    return keep_gameplay(anchor, role) | F.coalesce((z >= 0.25) | (burst >= 1.2), F.lit(False))


def keep_talk(role: Column, z: Column, burst: Column, reactions: Column, energy: Column) -> Column:
    """Everything but idle and technical breaks, which stay only with a lively chat."""
    lively = (z > 0.3) | (burst > 0) | (reactions > 0) | (energy == "high")
    return ~F.coalesce(role, F.lit("")).isin("afk", "tech_issue") | F.coalesce(lively, F.lit(False))


def bridge_similar(df: DataFrame, sims: DataFrame, keys: list[str], rid: str, keep: str, topic: str, strong: float = 0.5,
                   weak: float = 0.4, word: str = "giveaway") -> DataFrame:
    """Rows kept because a kept row is similar: ``sims`` has pairs (a, b, sim) within the time bound; one step outwards."""
    both = sims.select(*keys, F.col("a").alias("p"), F.col("b").alias("q"), "sim").unionByName(
        sims.select(*keys, F.col("b").alias("p"), F.col("a").alias("q"), "sim")).where(F.col("sim") >= weak)
    side = df.select(*keys, rid, keep, topic)
    told = both.join(side.select(*keys, F.col(rid).alias("p"), F.col(keep).alias("kp"), F.col(topic).alias("tp")), [*keys, "p"]).join(
        side.select(*keys, F.col(rid).alias("q"), F.col(topic).alias("tq")), [*keys, "q"])
    ok = F.col("kp") & ((F.col("sim") >= strong) | (F.lower("tp").contains(word) & F.lower("tq").contains(word)))
    hit = told.where(ok).select(*keys, F.col("q").alias(rid)).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, [*keys, rid], "left").withColumn(keep, F.col(keep) | F.coalesce("_hit", F.lit(False))).drop("_hit")


def context_wrap(df: DataFrame, keys: list[str], order: str, keep: str, role: str, same_prev: str) -> DataFrame:
    """Neighbours of kept rows that belong to them: a build-up before, and what goes on with the topic after, row by row."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lead(keep).over(w) & (F.col(role).isin("build_up", "setup") | F.lead(same_prev).over(w))
    d = df.withColumn("_k", F.col(keep) | F.coalesce(before, F.lit(False)))
    # to the right it cascades: a row marked as the same topic is kept if the row it follows is
    runs = islands(d, keys, [order], ~F.coalesce(F.col(same_prev), F.lit(False)), "_run")
    upto = F.max(F.col("_k").cast("int")).over(
        Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn(keep, upto == 1).drop("_k", "_run")


def pad_importants(df: DataFrame, keys: list[str], start: str, keep: str, important: str, before: Column, after: Column, reach: float) -> DataFrame:
    """Rows within ``before`` / ``after`` seconds of an important row are kept; a bucketed self-join."""
    imp = df.where(F.col(important)).select(*keys, F.col(start).alias("_i"), before.alias("_bf"), after.alias("_af"),
                                            F.explode(F.array(*[F.floor(F.col(start) / reach) + o for o in (-1, 0, 1)])).alias("_b"))
    d = df.withColumn("_b", F.floor(F.col(start) / reach))
    hit = d.join(imp, [*keys, "_b"]).where((F.col(start) >= F.col("_i") - F.col("_bf")) & (F.col(start) <= F.col("_i") + F.col("_af")))
    hit = hit.select(*keys, start).distinct().withColumn("_hit", F.lit(True))
    return d.drop("_b").join(hit, [*keys, start], "left").withColumn(keep, F.col(keep) | F.coalesce("_hit", F.lit(False))).drop("_hit")


def fill_gaps(df: DataFrame, keys: list[str], keep: str, most: Column, allowed: Column | None = None) -> DataFrame:
    """Rows between two kept rows that are at most ``most`` seconds apart, where ``allowed``."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    prev = F.last(F.when(F.col(keep), F.col("end")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("end"))
    nxt = F.last(F.when(F.col(keep), F.col("start")), True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    ok = F.coalesce(F.greatest(F.lit(0.0), nxt - prev) <= most, F.lit(False))
    return df.withColumn(keep, F.col(keep) | (ok & (allowed if allowed is not None else F.lit(True))))


def salience_guard(df: DataFrame, keep: str, strict: bool = False) -> DataFrame:
    """Leaves the keep set as it is; ``strict`` drops kept rows whose salience is below the median of the group."""
    if not strict:
        return df
    return df.withColumn(keep, F.col(keep) & (F.col("salience") >= F.col("median_salience")))


def drop_loners(df: DataFrame, keys: list[str], order: str, keep: str, important: str, reactions: str, salience_: str, short: float = 12.0) -> DataFrame:
    """Short kept rows with unkept neighbours, no reactions and little salience go."""
    w = Window.partitionBy(*keys).orderBy(order)
    alone = ~F.coalesce(F.lag(keep).over(w), F.lit(False)) & ~F.coalesce(F.lead(keep).over(w), F.lit(False))
    v = F.array_sort(F.collect_list(salience_).over(Window.partitionBy(*keys)))
    median = F.get(v, F.floor(0.5 * (F.size(v) - 1)).cast("int"))
    d = df.withColumns({"_alone": alone, "_m": median})
    go = F.col("_alone") & (F.col("end") - F.col("start") <= short) & (F.col(reactions) == 0) & ~F.col(important) & (F.col(salience_) < F.col("_m"))
    return d.withColumn(keep, F.col(keep) & ~go).drop("_alone", "_m")


def peak_blocks(df: DataFrame, keys: list[str], member: Column, gap: Column) -> DataFrame:
    """Blocks ``PB-001`` .. of member rows at most ``gap`` seconds apart; null for the others."""
    d = df.withColumn("_m", F.coalesce(member, F.lit(False)))
    w = Window.partitionBy(*keys, "_m").orderBy("start", "end")
    runs = islands(d.withColumn("_g", gap), [*keys, "_m"], ["start", "end"], F.col("start") - F.lag("end").over(w) > F.col("_g"), "_run")
    return runs.withColumn("block", F.when(F.col("_m"), F.format_string("PB-%03d", "_run"))).drop("_m", "_run", "_g")


def kept_runs(df: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Every run of neighbouring kept rows as a block."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    d = islands(df, keys, ["start", "end"], ~F.coalesce(F.lag(keep).over(w), F.lit(False)) | ~F.col(keep), "_run")
    first = F.dense_rank().over(Window.partitionBy(*keys, keep).orderBy("_run"))
    return d.withColumn("block", F.when(F.col(keep), F.format_string("PB-%03d", first))).drop("_run")


def flatten(df: DataFrame, keys: list[str], keep: str, gap: float, need_block: bool) -> DataFrame:
    """Ranges of kept rows of one block at most ``gap`` apart, with majority topic, highest energy and ids."""
    d = df.where(F.col(keep))
    w = Window.partitionBy(*keys).orderBy("start", "end")
    same = (F.col("block") == F.lag("block").over(w)) if need_block else F.col("block").eqNullSafe(F.lag("block").over(w))
    near = F.col("start") - F.lag("end").over(w) <= gap
    runs = islands(d, keys, ["start", "end"], ~(F.coalesce(same, F.lit(False)) & F.coalesce(near, F.lit(False))), "range")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("start", "id"))), lambda r: r["id"])
    return runs.groupBy(*keys, "range").agg(
        majority("topic", "start").alias("topic"), ids.alias("burst_ids"), F.min("start").alias("start"), F.max("end").alias("end"),
        energy_name(F.max(energy_rank(F.col("energy")))).alias("energy"))


def range_stats(ranges: DataFrame, windows: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """Per range over the windows it overlaps: mean positive z, majority topic, and whether each role occurs."""
    from .intervals import overlap_join

    w = windows.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"), "z", "topic", "role")
    d = overlap_join(ranges.select(*keys, "start", "end"), w, keys, bucket)
    roles = ("peak", "conflict", "build_up", "resolution")
    return d.groupBy(*keys, "start", "end").agg(
        F.avg(F.greatest(F.lit(0.0), F.col("z"))).alias("avg_z"), majority("topic", "b_start").alias("topic"),
        *[F.coalesce(F.bool_or(F.col("role") == r), F.lit(False)).alias(f"has_{r}") for r in roles])


def buildup_start(ranges: DataFrame, windows: DataFrame, keys: list[str], reach: float = 75.0) -> DataFrame:
    """Start moved to the first quiet window, or the first build-up or conflict, of the ``reach`` seconds before."""
    w = windows.select(*keys, F.col("start").alias("t"), "z", "role", F.explode(F.array(
        *[F.floor(F.col("start") / reach) + o for o in (0, 1)])).alias("_b"))
    d = ranges.select(*keys, "start", "end", "peak_z").withColumn("_b", F.floor(F.col("start") / reach))
    near = d.join(w, [*keys, "_b"], "left").where(F.col("t").isNull() | ((F.col("t") < F.col("start")) & (F.col("t") >= F.col("start") - reach)))
    quiet = F.min(F.when(F.col("z") <= 0.35 * F.col("peak_z"), F.col("t")))
    role = F.min(F.when(F.col("role").isin("build_up", "conflict"), F.col("t")))
    got = near.groupBy(*keys, "start", "end").agg(F.least(quiet, role).alias("moved"))
    return ranges.join(got, [*keys, "start", "end"], "left").withColumn("buildup", F.coalesce("moved", "start")).drop("moved")


def topic_continuity(df: DataFrame, keys: list[str], gap: float = 40.0) -> DataFrame:
    """Ranges of one topic at most ``gap`` apart merged; highest energy; summaries joined."""
    fields = {"start": F.col("start"), "end": F.col("end"), "topic": F.coalesce("topic", F.lit("")),
              "energy": energy_rank(F.col("energy")), "n": F.lit(1).cast("long")}
    out = fold_runs(df, keys, [F.col("start"), F.col("end")], fields,
                    lambda a, r: (r["start"] - a["end"] <= gap) & (a["topic"] != "") & (a["topic"] == r["topic"]),
                    lambda a, r: {"end": F.greatest(a["end"], r["end"]), "energy": F.greatest(a["energy"], r["energy"]), "n": a["n"] + 1})
    return out.withColumn("energy", energy_name(F.col("energy")))


def title_numbers(df: DataFrame, keys: list[str], near: float, order: tuple[str, ...] = ("start",)) -> DataFrame:
    """Clips near each other share the first one's title, numbered from the second on."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = islands(df, keys, list(order), F.col("start") - F.lag("end").over(w) > near, "_run")
    g = Window.partitionBy(*keys, "_run").orderBy(*order)
    n = F.row_number().over(g)
    return d.withColumn("title", F.when(n == 1, F.col("title")).otherwise(F.concat(F.first("title").over(g), F.lit(" "), n))).drop("_run")


def topic_thread(df: DataFrame, keys: list[str], order: str, same_prev: Column) -> DataFrame:
    """Thread number: one more wherever a row does not go on with the topic before."""
    return islands(df, keys, [order], ~F.coalesce(same_prev, F.lit(False)) | (
        F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1), "thread")


def recent_keys(x: str, keys: list[str], order: str, n: int = 8) -> Column:
    """The last ``n`` distinct values before a row, oldest first."""
    before = F.collect_list(x).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    distinct = F.reverse(F.array_distinct(F.reverse(F.filter(before, lambda v: v != ""))))
    return F.slice(distinct, F.greatest(F.size(distinct) - n + 1, F.lit(1)), n)


def lead_in(df: DataFrame, keys: list[str], order: str, at: Column, seconds: Column) -> DataFrame:
    """The rows before ``at`` whose total length, counted back from it, stays within ``seconds``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = df.where(F.col(order) < at).withColumn("_used", F.sum(F.col("end") - F.col("start")).over(w))
    return d.where(F.col("_used") <= seconds).drop("_used")


def median_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Component-wise upper median of boxes."""

    def upper(c: str) -> Column:
        v = F.array_sort(F.collect_list(c))
        return F.get(v, F.floor(F.size(v) / 2).cast("int")).alias(c)

    return boxes.groupBy(*keys).agg(*[upper(c) for c in ("x", "y", "w", "h")])


