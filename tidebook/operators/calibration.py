"""Clock calibration of snapshots against trades, and healing with the curve found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions import expressions as X
from tidebook.functions.expressions import whole
from tidebook.operators.asof import asof_backward, carry_in
from tidebook.storage import cut

NS_MS = 1_000_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def windows(trades: DataFrame, snapshots: DataFrame, window_ns: int, margin_ns: int, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fixed windows that start at the smallest time of either table per ``by``: (trades with win, snapshots with
    win, spans). Snapshots also go to neighbouring windows within ``margin_ns`` of them."""
    times = trades.select(*by, "ts_ns").unionByName(snapshots.select(*by, "ts_ns"))
    spans = times.groupBy(*by).agg(F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
    own = trades.join(spans, by).withColumn("win", whole(F.col("ts_ns") - F.col("t0"), window_ns)).where(F.col("t0") + F.col("win") * window_ns < F.col("t1")).drop("t0", "t1")
    first = F.greatest(F.lit(0), F.floor((F.col("ts_ns") - F.col("t0") - margin_ns) / window_ns).cast("long"))
    last = whole(F.col("ts_ns") - F.col("t0") + margin_ns, window_ns)
    near = snapshots.join(spans, by).withColumn("win", F.explode(F.sequence(first, last)))
    start = F.col("t0") + F.col("win") * window_ns
    near = near.where((start < F.col("t1")) & (F.col("ts_ns") >= start - margin_ns) & (F.col("ts_ns") < start + window_ns + margin_ns)).drop("t0", "t1")
    return own, near, spans


def _outside_counts(keys: list[str], offsets: np.ndarray, bin_ns: int):
    """Of one bin the rows (keys, o, hits): how many of its trades, moved by each offset into the bin, are outside."""

    def run(table: pa.Table) -> pa.Table:
        book = pc.is_null(table.column("t"))
        books = table.filter(book).sort_by([("ts_ns", "ascending"), ("u", "ascending")])
        asked = table.filter(pc.invert(book)).sort_by("t")
        t, price, n = (asked.column(c).to_numpy() for c in ("t", "price_ticks", "n"))
        starts = books.column("ts_ns").to_numpy()
        bid, ask = (pc.fill_null(books.column(c), edge).to_numpy() for c, edge in (("best_bid_ticks", _LEAST), ("best_ask_ticks", _MOST)))
        bin_ = table.column("bucket")[0].as_py()
        # the times of a bin as ``whole`` deals them: bin 0 reaches a bin to either side of 0
        first, end = bin_ * bin_ns if bin_ > 0 else (bin_ - 1) * bin_ns + 1, (bin_ + 1) * bin_ns if bin_ >= 0 else bin_ * bin_ns + 1
        first = max(first, int(starts[0])) if len(starts) else end
        counts = np.zeros(len(offsets), np.int64)
        for k, (lo, hi) in enumerate(zip(np.searchsorted(t, first + offsets), np.searchsorted(t, end + offsets), strict=True)):
            # both sides are in order, so the search runs through the books once
            at = np.searchsorted(starts, t[lo:hi] - offsets[k], "right") - 1
            p = price[lo:hi]
            counts[k] = n[lo:hi][(p < bid[at]) | (p > ask[at])].sum()
        some = np.flatnonzero(counts)
        own = table.select(keys).take(np.zeros(len(some), np.int64))
        return own.append_column("o", pa.array(offsets[some])).append_column("hits", pa.array(counts[some]))

    return run


def outside_rates(trades: DataFrame, snapshots: DataFrame, keys: list[str], range_ms: int = 500, step_ms: int = 10, bin_ns: int = 1_000_000_000) -> DataFrame:
    """(keys, offset_ms, outside, trades): for each offset of the snapshots' clock on a grid, how many trades lie
    outside the spread of their match; trades without a match count as inside.

    Under offset o trade t matches the last snapshot at or before t - o. Snapshots are dealt in bins of time of a minute at
    least, each with the last of the earlier ones as a seed; a trade goes to each bin that an offset can move it to,
    and a bin looks its trades up once an offset. The work is trades times offsets, however many snapshots are near.
    Trades of one time and price are looked up together, and of the snapshots of one time only the last is sent.
    """
    reach, step, bin_ns = range_ms * NS_MS, step_ms * NS_MS, max(bin_ns, 60 * 10**9)
    asked = trades.where("ts_ns is not null and price_ticks is not null").select(*keys, F.col("ts_ns").alias("t"), F.col("price_ticks").cast("long").alias("price_ticks"))
    asked = asked.groupBy(*keys, "t", "price_ticks").agg(F.count("*").alias("n"))
    asked = asked.withColumn("bucket", F.explode(F.sequence(whole(F.col("t") - reach, bin_ns), whole(F.col("t") + reach, bin_ns))))
    fields = ["ts_ns", "u", "best_bid_ticks", "best_ask_ticks"]
    books = snapshots.where("ts_ns is not null").select(*keys, *(F.col(c).cast("long").alias(c) for c in fields)).withColumn("u", F.coalesce("u", F.lit(_LEAST)))
    books = books.groupBy(*keys, "ts_ns").agg(F.max_by(F.struct(*fields), "u").alias("book"))
    books = books.select(*keys, whole(F.col("ts_ns"), bin_ns).alias("bucket"), "ts_ns", "book.u", "book")
    seeds = carry_in(books, asked, "book", ["ts_ns", "u"], keys)
    both = books.select(*keys, "bucket", "book.*").unionByName(seeds.select(*keys, "bucket", "book.*")).unionByName(asked, allowMissingColumns=True)
    counted = T.StructType([*(both.schema[k] for k in keys), T.StructField("o", T.LongType()), T.StructField("hits", T.LongType())])
    # few bytes are much work here, so the number of tasks is given: Spark would merge small partitions
    dealt = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "bucket")
    hits = dealt.groupBy(*keys, "bucket").applyInArrow(_outside_counts(keys, np.arange(-reach, reach + 1, step), bin_ns), counted)
    sums = hits.groupBy(*keys, "o").agg(F.sum("hits").alias("hits"))
    grid = trades.groupBy(*keys).agg(F.count("*").alias("trades")).withColumn("o", F.explode(F.sequence(F.lit(-reach), F.lit(reach), F.lit(step))))
    return grid.join(sums, [*keys, "o"], "left").select(*keys, (F.col("o") / NS_MS).cast("long").alias("offset_ms"), F.coalesce("hits", F.lit(0)).alias("outside"), "trades")


def best_offset(rates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, optimal_offset_ms, outside_spread_rate): the smallest rate, on ties the most negative offset; 0 if
    every trade is outside at every offset."""
    rate = F.col("outside") / F.col("trades")
    found = rates.withColumn("rate", rate).groupBy(*keys).agg(F.min_by("offset_ms", F.struct("rate", "offset_ms")).alias("o"), F.min("rate").alias("r"))
    return found.select(*keys, F.when(F.col("r") < 1, F.col("o")).otherwise(0).cast("double").alias("optimal_offset_ms"), F.col("r").alias("outside_spread_rate"))


def calibrate(trades: DataFrame, snapshots: DataFrame, by: list[str], window_ns: int = 600 * 10**9, margin_ns: int = 10**9, range_ms: int = 500, step_ms: int = 10, least: int = 10, bin_ns: int = 10**9) -> DataFrame:
    """The calibration table per ``by``: one row per window with at least ``least`` trades and snapshots."""
    own, near, spans = windows(trades.select(*by, "ts_ns", "price_ticks"), snapshots.select(*by, "ts_ns", "u", "best_bid_ticks", "best_ask_ticks"), window_ns, margin_ns, by)
    # each is read several times below
    own, near, spans = cut(own), cut(near), cut(spans)
    keys = [*by, "win"]
    counts = own.groupBy(*keys).agg(F.count("*").alias("trade_count")).join(near.groupBy(*keys).agg(F.count("*").alias("snapshot_count")), keys).where((F.col("trade_count") >= least) & (F.col("snapshot_count") >= least))
    counts = cut(counts)
    enough = counts.select(*keys)
    found = best_offset(outside_rates(own.join(enough, keys), near.join(enough, keys), keys, range_ms, step_ms, bin_ns), keys)
    start = F.col("t0") + F.col("win") * window_ns
    return found.join(counts, keys).join(spans, by).select(*by, start.alias("window_start_ns"), (start + window_ns).alias("window_end_ns"), F.substring(X.trade_time(start), 1, 19).alias("window_start_time"), "optimal_offset_ms", "outside_spread_rate", "trade_count", "snapshot_count")


def curve_statistics(curve: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of a calibration curve; changes and trend only where there are more than ten windows."""
    order = Window.partitionBy(*by).orderBy("window_start_ns")
    o, r = F.col("optimal_offset_ms"), F.col("outside_spread_rate")
    rows = curve.withColumn("idx", F.row_number().over(order) - 1).withColumn("change", F.abs(o - F.lag("optimal_offset_ms").over(order)))
    many = F.count("*") > 10
    return rows.groupBy(*by).agg(
        F.count("*").alias("windows"), F.avg(o).alias("mean_offset"), F.stddev_pop(o).alias("std_offset"), F.min(o).alias("min_offset"), F.max(o).alias("max_offset"), F.percentile(o, F.lit(0.5)).alias("median_offset"), F.avg(r).alias("mean_rate"), F.min(r).alias("min_rate"), F.max(r).alias("max_rate"),
        F.when(many, F.avg("change")).alias("mean_change"), F.when(many, F.max("change")).alias("max_change"), F.when(many, F.regr_slope(o, F.col("idx"))).alias("trend_per_window"),
    )


def heal(snapshots: DataFrame, curve: DataFrame, by: list[str], slot_ns: int = 600 * 10**9) -> DataFrame:
    """``snapshots`` with ts_ns moved by the offset interpolated between window centres, clamped at either end,
    and ts_ns_original and offset_applied_ns. Rows of groups without a curve are moved by 0.

    Stretches between centres are dealt over slots of time, so that a snapshot meets one or two of them by key,
    whatever the length of the curve; where the curves are small Spark sends them to the snapshots.
    """
    centre = F.col("window_start_ns") + whole(F.col("window_end_ns") - F.col("window_start_ns"), 2)
    points = curve.select(*by, centre.alias("c"), (F.col("optimal_offset_ms") * NS_MS).alias("o"))
    order = Window.partitionBy(*by).orderBy("c", "o")
    steps = points.withColumns({"d": F.lead("c").over(order), "p": F.lead("o").over(order)}).where("d > c")
    slots = F.sequence(whole(F.col("c"), slot_ns), whole(F.col("d") - 1, slot_ns))
    steps = steps.select(*(F.col(k).alias(f"_{k}") for k in by), "c", "o", "d", "p", F.explode(slots).alias("_slot"))
    ends = points.groupBy(*by).agg(F.min(F.struct("c", "o")).alias("_first"), F.max(F.struct("c", "o")).alias("_last"))
    rows = snapshots.join(ends, by, "left")
    at = F.col("ts_ns")
    near = (whole(at, slot_ns) == F.col("_slot")) & (at >= F.col("c")) & (at < F.col("d"))
    for k in by:
        near &= snapshots[k] == F.col(f"_{k}")
    rows = rows.join(steps, near, "left")
    between = F.col("o") + (F.col("p") - F.col("o")) * (at - F.col("c")) / (F.col("d") - F.col("c"))
    offset = F.when(at < F.col("_first.c"), F.col("_first.o")).when(at >= F.col("_last.c"), F.col("_last.o")).otherwise(F.coalesce(between, F.lit(0.0)))
    kept = [snapshots[c] for c in snapshots.columns if c != "ts_ns"]
    applied = offset.cast("long")
    return rows.select(*kept, (at + applied).alias("ts_ns"), at.alias("ts_ns_original"), applied.alias("offset_applied_ns")).select(*snapshots.columns, "ts_ns_original", "offset_applied_ns")


def outside_share(trades: DataFrame, snapshots: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, name): share of matched trades outside the spread of their snapshot."""
    found = asof_backward(trades, snapshots, ["best_bid_ticks", "best_ask_ticks"]).where("snap is not null")
    hit = X.outside(F.col("price_ticks"), F.col("snap.best_bid_ticks"), F.col("snap.best_ask_ticks"))
    return found.groupBy(*by).agg((F.count_if(hit) / F.count("*")).alias(name))


def verify_healing(trades: DataFrame, snapshots: DataFrame, healed: DataFrame, by: list[str]) -> DataFrame:
    """Outside rates before and after healing on the same trades, and the improvement."""
    before, after = outside_share(trades, snapshots, by, "rate_before"), outside_share(trades, healed, by, "rate_after")
    return before.join(after, by).withColumn("improvement", F.col("rate_before") - F.col("rate_after"))
