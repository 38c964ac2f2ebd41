"""Exact percentiles of large groups, by histograms that are refined around the ranks asked for.

A group's values are counted in bins between its least and its greatest; only the bins that hold a rank asked for are
divided again, until such a bin has one value. No task holds a group's values: a round sends at most ``bins`` counts of
each open bin, and a value that is repeated millions of times is one count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.storage import cut


def _names(points: tuple[float, ...]) -> list[str]:
    return [f"p{100 * p:g}".replace(".", "_") for p in points]


def _bin(bins: int) -> Column:
    """Place of v between lo and hi, from 0; never falls as v rises, and differs for lo and hi. Infinite values and NaN
    have places of their own."""
    v, lo, hi = (F.col(c) / 2 for c in ("v", "lo", "hi"))  # halves: a difference can't overflow
    at = F.least(F.coalesce(F.floor(F.try_divide(v - lo, hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    at = F.when((F.col("v") == F.col("hi")) & (F.col("lo") < F.col("hi")), bins - 1).otherwise(at)
    return F.when(F.isnan("v"), bins + 1).when(F.col("v") == math.inf, bins).when(F.col("v") == -math.inf, -1).otherwise(at)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & a[k].eqNullSafe(b[f"_{k}"])
    return found


def _ranks(points: tuple[float, ...]) -> Column:
    at = [F.lit(p) * (F.col("n") - 1) for p in points]
    return F.array_distinct(F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil))))


def _values(rows: DataFrame, groups: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys, rank, value) of every rank of ``groups`` (keys, lo, hi, ranks), counted from 0."""
    open_, first, done = groups.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("below"), "ranks"), True, []
    while True:
        side = open_.select(*(F.col(k).alias(f"_{k}") for k in keys), "lo", "hi", "below", "ranks")
        within = _same(rows, side, keys) if first else _same(rows, side, keys) & rows["v"].between(side["lo"], side["hi"])
        counts = rows.join(side, within).groupBy(*keys, "lo", "below", "ranks", _bin(bins).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "below").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
        found = counts.withColumn("before", before).withColumn("ranks", F.expr("filter(ranks, r -> r >= before and r < before + n)")).where("size(ranks) > 0")
        found = cut(found.select(*keys, "low", "high", "before", "ranks"))
        done.append(found.where("low = high").select(*keys, F.explode("ranks").alias("rank"), F.col("low").alias("value")))
        open_ = found.where("low < high").select(*keys, F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("before").alias("below"), "ranks")
        if open_.isEmpty():
            break
        first = False
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every


def percentiles(rows: DataFrame, column: str, points: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999), by: list[str] | None = None, accuracy: int | None = None, bins: int = 1 << 14) -> DataFrame:
    """(by, p50, p90, ..., max): percentiles with linear interpolation between the two nearest values, and the maximum.

    Values are compared as doubles; nulls take no part, NaN is the greatest value. A group without values has null
    percentiles; an empty table gives no rows, or one of nulls where ``by`` is empty. The two columns are written
    once and read once a round, mostly two. With ``accuracy`` the percentiles are values of the column whose rank is wrong by
    n / accuracy at most, from one pass.
    """
    by, names = by or [], _names(points)
    if accuracy is not None:
        found = rows.groupBy(*by).agg(F.percentile_approx(column, list(points), accuracy).alias("p"), F.max(column).alias("max"))
        return found.select(*by, *(F.col("p")[k].cast("double").alias(n) for k, n in enumerate(names)), "max")
    keys = [f"k{i}" for i in range(len(by))]
    narrow = cut(rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(column).alias("x"), F.col(column).cast("double").alias("v")))
    finite = F.when(~F.isnan("v") & (F.abs("v") < math.inf), F.col("v"))
    stats = cut(narrow.groupBy(*keys).agg(F.count("v").alias("n"), F.max("x").alias("max"), F.min(finite).alias("lo"), F.max(finite).alias("hi")))
    found = _values(narrow.where("v is not null").drop("x"), stats.where("n > 0").select(*keys, "lo", "hi", _ranks(points).alias("ranks")), keys, bins)
    entries = F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of")
    maps = found.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(entries)
    joined = stats.join(maps, _same(stats, maps, keys), "left")

    def value(p: float) -> Column:
        at = F.lit(p) * (F.col("n") - 1)
        low, high = (F.try_element_at("of", f(at).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return joined.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *(value(p).alias(n) for p, n in zip(points, names, strict=True)), "max")
