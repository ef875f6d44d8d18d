"""Ordered folds: greedy selections that depend on what was selected before.

The rows of a group (a session or a chapter, hundreds to a few thousand rows)
are sorted in an array and folded by ``aggregate`` on the JVM, so no Python runs
and groups are folded in parallel.  Not for message-level rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(order: list[Column], fields: dict[str, Column]) -> Column:
    """Aggregate: the group's rows as an array of struct<o0.., fields>, sorted by ``order`` ascending."""
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return F.array_sort(F.collect_list(F.struct(*keys, *[c.alias(n) for n, c in fields.items()])))


def fold_select(df: DataFrame, keys: list[str], order: list[Column], fields: dict[str, Column],
                accept: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows taken one by one in ``order``: a row is taken if ``accept(taken so far, row)``.

    Returns keys, ``pos`` (order of selection from 1) and the fields of the taken rows.
    """
    grouped = df.groupBy(*keys).agg(ordered(order, fields).alias("rows"))
    kind = grouped.schema["rows"].dataType.simpleString()
    start = F.array().cast(kind)
    taken = F.aggregate("rows", start, lambda acc, r: F.when(accept(acc, r), F.concat(acc, F.array(r))).otherwise(acc))
    out = grouped.select(*keys, F.posexplode(taken).alias("p", "r"))
    return out.select(*keys, (F.col("p") + 1).cast("long").alias("pos"), *[F.col(f"r.{n}").alias(n) for n in fields])


def fold_runs(df: DataFrame, keys: list[str], order: list[Column], fields: dict[str, Column],
              joins: Callable[[Column, Column], Column], merge: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Neighbouring rows merged into runs: a row extends the last run if ``joins(run, row)``, by ``merge(run, row)``.

    The run has the same fields as a row.
    """
    grouped = df.groupBy(*keys).agg(ordered(order, fields).alias("rows"))
    plain = F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in fields]))
    kind = grouped.select(plain.alias("rows")).schema["rows"].dataType
    element, kind = kind.elementType.simpleString(), kind.simpleString()  # as text, all fields may be null
    grouped = grouped.select(*keys, plain.cast(kind).alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = merge(last, r)
        grown = F.struct(*[merged.get(n, last[n]).alias(n) for n in fields]).cast(element)
        return F.when((F.size(acc) > 0) & F.coalesce(joins(F.get(acc, F.size(acc) - 1), r), F.lit(False)),
                      F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(r)))

    def safe(acc: Column, r: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(r)).otherwise(step(acc, r))

    runs = F.aggregate("rows", F.array().cast(kind), safe)
    out = grouped.select(*keys, F.posexplode(runs).alias("p", "r"))
    return out.select(*keys, (F.col("p") + 1).cast("long").alias("run"), *[F.col(f"r.{n}").alias(n) for n in fields])
