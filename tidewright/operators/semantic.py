"""Grouping of session rows by the similarity of their vectors.

These operators depend on what was taken before: a row that became kept keeps
others.  The rows of a session (windows: tens to a few hundred) are sorted in an
array and folded on the JVM, sessions in parallel; no Python runs.  Vectors are
compared by cosine; a missing one is similar to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold_runs
from .vectors import cosine, dot, normalise


def _unit() -> Column:
    """The vector at length one, null where it is missing or zero: its products are cosines."""
    return F.when(dot(F.col("vector"), F.col("vector")) > 0, normalise(F.col("vector"))).alias("vector")


def _fields() -> list[Column]:
    return [F.col(c) for c in ("start", "end", "topic", "chapter")] + [_unit()]


def _sim(a: Column, b: Column) -> Column:
    return F.coalesce(dot(a["vector"], b["vector"]), F.lit(-1.0))


def _rows(df: DataFrame, keys: list[str], rid: str, keep: str) -> DataFrame:
    row = F.struct(F.col("start").alias("o"), F.col(rid).alias("id"), F.coalesce(keep, F.lit(False)).alias("keep"), *_fields())
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _fold(df: DataFrame, keys: list[str], rid: str, keep: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, rid, keep) after ``step(flags, i)`` for every row i in order of start and id."""
    grouped = _rows(df, keys, rid, keep)
    flags = F.aggregate(F.sequence(F.lit(0), F.size("rows") - 1), F.transform("rows", lambda r: r["keep"]), step)
    both = F.zip_with("rows", flags, lambda r, k: F.struct(r["id"].alias(rid), k.alias(keep)))
    return grouped.select(*keys, F.explode(both).alias("x")).select(*keys, f"x.{rid}", f"x.{keep}")


def _row(i: Column) -> Column:
    return F.get(F.col("rows"), i)


def bridge(df: DataFrame, keys: list[str], rid: str, keep: str, reach: float = 300.0, strong: float = 0.5, weak: float = 0.4,
           word: str = "giveaway") -> DataFrame:
    """Rows that start within ``reach`` of a kept row and are ``strong`` similar to it (``weak`` if both topics hold ``word``) are kept.

    In order of time, so that a newly kept row keeps later ones, and earlier ones only when its own turn comes.
    """
    def step(flags: Column, i: Column) -> Column:
        def told(k: Column, j: Column) -> Column:
            sim = _sim(_row(i), _row(j))
            both = F.lower(_row(i)["topic"]).contains(word) & F.lower(_row(j)["topic"]).contains(word)
            near = F.abs(_row(j)["start"] - _row(i)["start"]) <= reach
            return k | (near & ((sim >= max(strong, weak)) | ((sim >= weak) & F.coalesce(both, F.lit(False)))))

        return F.when(F.get(flags, i), F.transform(flags, told)).otherwise(flags)

    return _fold(df, keys, rid, keep, step)


def extend(df: DataFrame, keys: list[str], rid: str, keep: str, reach: float = 60.0, least: float = 0.4) -> DataFrame:
    """A group (the kept rows) grows by rows of its first row's chapter, within ``reach`` of its bounds, that are similar to any row taken so far."""
    rows = F.col("rows")
    seeds = F.filter(rows, lambda r: r["keep"])
    lo, hi = F.array_min(F.transform(seeds, lambda r: r["start"])) - reach, F.array_max(F.transform(seeds, lambda r: r["end"])) + reach

    def step(flags: Column, i: Column) -> Column:
        x = _row(i)
        like = F.exists(F.zip_with(rows, flags, lambda r, k: k & (_sim(r, x) >= least)), lambda hit: hit)
        take = ~F.get(flags, i) & (x["start"] >= lo) & (x["end"] <= hi) & (x["chapter"] == F.get(seeds, F.lit(0))["chapter"]) & like
        return F.when(F.coalesce(take, F.lit(False)), F.transform(flags, lambda k, j: k | (j == i))).otherwise(flags)

    return _fold(df, keys, rid, keep, step)


def wrap(df: DataFrame, keys: list[str], rid: str, keep: str, least: float = 0.35, gap: float = 60.0) -> DataFrame:
    """Around every kept row, also newly kept ones, similar rows are kept up to the first unlike row more than ``gap`` seconds away."""
    rows = F.col("rows")

    def step(flags: Column, i: Column) -> Column:
        x = _row(i)
        # what stops the walk on either side: unlike and too far
        stops = F.transform(rows, lambda r, j: F.when((_sim(x, r) < least) & (
            F.when(j < i, x["start"] - r["end"]).otherwise(r["start"] - x["end"]) > gap) & (j != i), j))
        left = F.coalesce(F.array_max(F.filter(stops, lambda j: j < i)), F.lit(-1))
        right = F.coalesce(F.array_min(F.filter(stops, lambda j: j > i)), F.size(rows))
        within = F.array(F.struct(left.alias("left"), right.alias("right")))  # an array of one, so that both are computed once
        grown = F.transform(within, lambda b: F.transform(flags, lambda k, j: k | ((j > b["left"]) & (j < b["right"]) & (_sim(x, _row(j)) >= least))))
        return F.when(F.get(flags, i), F.get(grown, F.lit(0))).otherwise(flags)

    return _fold(df, keys, rid, keep, step)


def blocks(df: DataFrame, keys: list[str], rid: str, keep: str, least: float = 0.4, gap: float = 30.0) -> DataFrame:
    """(keys, rid, block): neighbouring kept rows, as long as one is similar to any member or at most ``gap`` after the row before; null for others."""
    grouped = _rows(df, keys, rid, keep)
    kind = grouped.schema["rows"].dataType
    none = F.array().cast(f"array<{dict((f.name, f.dataType) for f in kind.elementType.fields)['vector'].simpleString()}>")
    start = F.struct(F.lit(0).alias("n"), none.alias("members"), F.lit(None).cast("double").alias("last"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, r: Column) -> Column:
        like = F.exists(acc["members"], lambda v: F.coalesce(dot(v, r["vector"]), F.lit(-1.0)) >= least)
        joins = (F.size(acc["members"]) > 0) & (like | (r["start"] - acc["last"] <= gap))
        n = F.when(r["keep"] & ~F.coalesce(joins, F.lit(False)), acc["n"] + 1).otherwise(acc["n"])
        own = F.array(r["vector"])
        members = F.when(~r["keep"], none).when(F.coalesce(joins, F.lit(False)), F.concat(acc["members"], own)).otherwise(own)
        ids = F.concat(acc["ids"], F.array(F.when(r["keep"], n)))
        return F.struct(n.alias("n"), members.alias("members"), r["end"].alias("last"), ids.alias("ids"))

    ids = F.aggregate("rows", start, step)["ids"]
    both = F.zip_with("rows", ids, lambda r, b: F.struct(r["id"].alias(rid), F.when(b.isNotNull(), F.format_string("PB-%03d", b)).alias("block")))
    return grouped.select(*keys, F.explode(both).alias("x")).select(*keys, f"x.{rid}", "x.block")


def coherence(df: DataFrame, keys: list[str], tau: float = 600.0) -> DataFrame:
    """Coherence of an arc's rows: 0.65 of the medoid's five best similarities, 0.35 of the mean between neighbours; 0.8 for a single row.

    Similarities are those of :func:`.vectors.range_similarity`, from the earlier row to the later one.
    """
    from .vectors import range_similarity

    row = F.struct("start", "end", "topic", _unit())
    d = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    rows, n = F.col("rows"), F.size("rows")

    def between(a: Column, b: Column) -> Column:
        same = F.coalesce((a["topic"] != "") & (a["topic"] == b["topic"]), F.lit(False))
        return range_similarity(_sim(a, b), F.greatest(F.lit(0.0), b["start"] - a["end"]), same, tau)

    matrix = F.transform(rows, lambda a, i: F.transform(F.filter(F.transform(rows, lambda b, j: F.struct(
        j.alias("j"), F.when(j < i, between(b, a)).otherwise(between(a, b)).alias("s"))), lambda x: x["j"] != i), lambda x: x["s"]))
    d = d.withColumn("matrix", matrix)

    def mean(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)

    best = F.array_max(F.transform("matrix", lambda v, i: F.struct(F.round(mean(v), 9).alias("mean"), (-i).alias("first"), v.alias("v"))))["v"]
    top = F.slice(F.sort_array(best, False), 1, 5)
    adjacent = F.transform(F.slice(F.col("matrix"), 1, n - 1), lambda v, i: F.get(v, i))
    blend = 0.65 * mean(top) + 0.35 * mean(adjacent)
    return d.select(*keys, F.when(n == 1, 0.8).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend))).alias("coherence"))


def fill_between(df: DataFrame, keys: list[str], keep: str, most: float, least: float, weak: float | None = None, word: str = "giveaway",
                 strict: Column | None = None, lively: Column | None = None) -> DataFrame:
    """Rows between two neighbouring kept rows at most ``most`` seconds apart are kept if they are like the first of the two.

    Like: similar by ``least``, or by ``weak`` if both topics hold ``word``.  With ``strict`` (a condition): where it holds,
    the two kept rows must also share their topic, and idle rows and fillers that are not ``lively`` stay out; where it
    does not hold, everything between is kept.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    mark = F.when(F.col(keep), F.struct("start", "end", "topic", "vector"))
    prev = F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(mark, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    d = df.withColumns({"_p": prev, "_n": nxt})
    near = F.coalesce(F.greatest(F.lit(0.0), F.col("_n.start") - F.col("_p.end")) <= most, F.lit(False))
    sim = F.coalesce(cosine(F.col("_p.vector"), F.col("vector")), F.lit(-1.0))
    like = sim >= least
    if weak is not None:
        both = F.lower("_p.topic").contains(word) & F.lower("topic").contains(word)
        like = like | ((sim >= weak) & F.coalesce(both, F.lit(False)))
    if strict is not None:
        role = F.coalesce("role", F.lit(""))
        same = F.coalesce((F.col("_p.topic") == F.col("_n.topic")) & (F.col("_p.topic") != ""), F.lit(False))
        like = ~strict | (like & same & (role != "afk") & ((role != "filler") | lively))
    return d.withColumn(keep, F.col(keep) | (near & like)).drop("_p", "_n")


def pad_similar(df: DataFrame, keys: list[str], rid: str, keep: str, important: Column, strict: Column, cap: float = 12.0, least: float = 0.3) -> DataFrame:
    """(keys, rid, keep): padding around important rows by the quartiles of the group's row lengths.

    Before by starts and after by ends: the median on both sides, or where ``strict`` holds the lower quartile before,
    at most ``cap`` and 0.4 medians (the quartile at least) after, and only rows similar to the important one.
    """
    row = F.struct(F.col("start").alias("o"), F.col(rid).alias("id"), F.coalesce(keep, F.lit(False)).alias("keep"),
                   F.coalesce(important, F.lit(False)).alias("imp"), strict.alias("strict"), *_fields())
    d = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.array_sort(F.collect_list(F.col("end") - F.col("start"))).alias("len"))

    def at(q: float) -> Column:
        return F.get("len", F.floor(q * (F.size("len") - 1)).cast("int"))

    d = d.withColumns({"q25": at(0.25), "q50": at(0.5)})
    q25, q50 = F.col("q25"), F.col("q50")

    def flagged(x: Column, j: Column) -> Column:
        def told(a: Column) -> Column:
            left = F.when(a["strict"], q25).otherwise(q50)
            right = F.when(a["strict"], F.least(F.greatest(q25, 0.4 * q50), F.lit(cap))).otherwise(q50)
            before = (x["o"] < a["o"]) & (a["start"] - x["start"] <= left)
            after = (x["o"] > a["o"]) & (x["end"] - a["end"] <= right)
            return a["imp"] & (before | after) & (~a["strict"] | (_sim(a, x) >= least))

        return F.struct(x["id"].alias(rid), (x["keep"] | F.exists("rows", told)).alias(keep))

    return d.select(*keys, F.explode(F.transform("rows", flagged)).alias("x")).select(*keys, f"x.{rid}", f"x.{keep}")


def flatten(df: DataFrame, keys: list[str], keep: str, gap: float, least: float = 0.4) -> DataFrame:
    """Ranges of kept rows: (keys, range, start, end, n, topic, energy, burst_ids, anchor).

    A kept row joins the range before it if it is ``least`` similar to any row of that range, or if it has the block of
    the range's first row (two nulls agree) and starts at most ``gap`` after its last row.  The topic is the most frequent
    one (the first of equals; empty if there is none), the energy the highest, the anchor the first row with reactions.
    ``df`` has id, start, end, topic, energy, block, reactions and vector.
    """
    from .grouping import energy_name, energy_rank

    row = {"start": F.col("start"), "end": F.col("end"), "block": F.col("block"), "vectors": F.array(_unit()), "topics": F.array("topic"),
           "energy": energy_rank(F.col("energy")), "ids": F.array("id"), "anchor": F.when(F.col("reactions") > 0, F.col("id"))}

    def joins(a: Column, r: Column) -> Column:
        like = F.exists(a["vectors"], lambda v: F.coalesce(dot(v, r["vectors"][0]), F.lit(-1.0)) >= least)
        return like | (a["block"].eqNullSafe(r["block"]) & (F.greatest(F.lit(0.0), r["start"] - a["end"]) <= gap))

    def grown(a: Column, r: Column) -> dict[str, Column]:
        return {"end": r["end"], "energy": F.greatest(a["energy"], r["energy"]), "anchor": F.coalesce(a["anchor"], r["anchor"]),
                **{n: F.concat(a[n], r[n]) for n in ("vectors", "topics", "ids")}}

    runs = fold_runs(df.where(keep), keys, [F.col("start"), F.col("end")], row, joins, grown)
    told = F.filter("topics", lambda t: F.length(t) > 0)
    count = F.transform(told, lambda t: F.struct(F.size(F.filter(told, lambda o: o == t)).alias("n"), (-F.array_position(told, t)).alias("first"), t.alias("t")))
    return runs.select(*keys, F.col("run").alias("range"), "start", "end", F.size("ids").cast("long").alias("n"), F.coalesce(F.array_max(count)["t"], F.lit("")).alias("topic"),
                       energy_name(F.col("energy")).alias("energy"), F.col("ids").alias("burst_ids"), "anchor")
