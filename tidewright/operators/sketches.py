"""Approximate aggregates that merge: distinct counts and quantiles kept per hour, and rolled up to any coarser grain.

A sketch of a few kilobytes stands for the rows of one key and hour (HyperLogLog
for distinct values, KLL for quantiles).  Sketches are built next to the scan,
travel in place of the rows, and unions of sketches equal the sketch of all their
rows, so a day, a user segment or the whole table is answered from the hourly
table without another pass over the data; late hours are added by one more union.

Null values count in no sketch.  A key without values has a distinct count of
zero and no quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 200
#: Bounds that hold with a chance of over 99 in 100: relative for distinct counts (three times 1.04 / sqrt(2^12)), in rank for quantiles.
DISTINCT_ERROR, RANK_ERROR = 0.049, 0.0265


def hourly(df: DataFrame, keys: list[str], hour: Column, distinct: str, measure: str) -> DataFrame:
    """(keys, hour, n, uniques, spread): the sketches of the rows of each key and hour."""
    value = F.col(measure).cast("double")
    return df.groupBy(*keys, hour.alias("hour")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("uniques"), F.kll_sketch_agg_double(value, F.lit(KLL_K)).alias("spread"))


def rolled(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches merged to coarser ``keys`` (none: one row)."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("uniques").alias("uniques"), F.kll_merge_agg_double("spread").alias("spread"))


def read(sketches: DataFrame, quantiles: list[float]) -> DataFrame:
    """What sketches tell: ``n_distinct`` and a column per quantile."""
    kept = [c for c in sketches.columns if c not in ("uniques", "spread")]
    some = F.kll_sketch_get_n_double("spread") > 0
    asked = [F.when(some, F.kll_sketch_get_quantile_double("spread", F.lit(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    return sketches.select(*kept, F.hll_sketch_estimate("uniques").alias("n_distinct"), *asked)


def held(df: DataFrame, told: DataFrame, keys: list[str], distinct: str, measure: str, quantiles: list[float]) -> DataFrame:
    """(keys, n, exact_distinct, distinct_held, <q>_held): what sketches told against an exact pass, each within its bound or not.

    A quantile is held if the share of rows at or below it is within the bound of ranks: the values next to it count.
    """
    exact = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(distinct).alias("exact_distinct"), F.count(measure).alias("m"))
    names = {f"q{round(q * 100)}": q for q in quantiles}
    both = df.join(told.select(*keys, *names), keys)
    ranks = both.groupBy(*keys).agg(*[f for n in names for f in (F.count_if(F.col(measure) <= F.col(n)).alias(f"{n}_to"), F.count_if(F.col(measure) < F.col(n)).alias(f"{n}_below"))])
    d = exact.join(told.select(*keys, "n_distinct"), keys).join(ranks, keys)
    near = [((F.col(f"{n}_to") >= (q - RANK_ERROR) * F.col("m")) & (F.col(f"{n}_below") <= (q + RANK_ERROR) * F.col("m"))).alias(f"{n}_held") for n, q in names.items()]
    fit = F.abs(F.col("n_distinct") - F.col("exact_distinct")) <= F.ceil(DISTINCT_ERROR * F.col("exact_distinct"))
    return d.select(*keys, "n", "exact_distinct", fit.alias("distinct_held"), *near)
