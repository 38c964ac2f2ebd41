"""Trades whose price lies outside the book's spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import expressions as X
from tidebook.operators.asof import asof_backward, forward_frames


def _with_frames(trades: DataFrame, snapshots: DataFrame, windows: list[int]) -> DataFrame:
    frames = forward_frames(snapshots, windows)
    return asof_backward(trades.select("symbol", "ts_ns", "agg_trade_id", "price_ticks", "qty_lots"), frames, ["spreads"]).where("snap is not null")


def match_spread(trades: DataFrame, snapshots: DataFrame, windows: tuple[int, ...] = (1,)) -> DataFrame:
    """Each trade that has a snapshot at or before it, once per window w: the lowest bid and highest ask over
    the matched snapshot and the w after it, and the price's deviation from them."""
    found = _with_frames(trades, snapshots, list(windows))
    rows = found.select("symbol", "ts_ns", "agg_trade_id", "price_ticks", "qty_lots", F.col("snap.ts_ns").alias("snap_ts_ns"), F.col("snap.u").alias("snap_u"), F.inline("snap.spreads"))
    dev = X.deviation(F.col("price_ticks"), F.col("ext_bid"), F.col("ext_ask"))
    return rows.select(
        "symbol", "w", "ts_ns", "agg_trade_id", "price_ticks", "qty_lots", "snap_ts_ns", "snap_u", "ext_bid", "ext_ask", (F.col("ext_ask") - F.col("ext_bid")).alias("spread"), dev.alias("deviation"), F.abs(dev).alias("abs_deviation"),
        X.ns_to_ms(F.col("ts_ns") - F.col("snap_ts_ns")).alias("time_diff_ms"), X.ns_to_ms(F.col("last_ts_ns") - F.col("snap_ts_ns")).alias("window_ms"),
    )


def report(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Deviation statistics in one aggregate."""
    d = F.col("abs_deviation")
    return matches.groupBy(*(by or [])).agg(
        F.count("*").alias("matched"), F.avg(d).alias("mean_abs"), F.stddev_pop(d).alias("std_abs"), F.max(d).alias("max_abs"), F.percentile(d, F.lit(0.5)).alias("median_abs"), F.min("deviation").alias("min_signed"), F.max("deviation").alias("max_signed"),
        F.count_if(d > 0).alias("outside"), F.count_if(d > 10).alias("over_10"), F.count_if(d > 100).alias("over_100"), F.count_if(d > 500).alias("over_500"), F.count_if(d > 1000).alias("over_1000"),
        X.safe_pct(F.count_if(d > 0), F.count("*")).alias("outside_pct"), X.safe_pct(F.count_if(d > 100), F.count("*")).alias("over_100_pct"), F.avg("time_diff_ms").alias("mean_time_diff_ms"), F.max("time_diff_ms").alias("max_time_diff_ms"),
    )


def by_hour(matches: DataFrame) -> DataFrame:
    d = F.col("abs_deviation")
    return matches.groupBy(X.hour_of(F.col("ts_ns")).alias("hour")).agg(F.count("*").alias("trades"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"), F.avg("time_diff_ms").alias("mean_time_diff_ms"), F.count_if(d > 100).alias("over_100"))


def large(matches: DataFrame, over: int = 500, top: int | None = None) -> DataFrame:
    """Matches deviating by more than ``over``; with ``top``, the largest (ties to the earlier trade)."""
    rows = matches.where(F.col("abs_deviation") > over).withColumn("trade_time", X.trade_time(F.col("ts_ns")))
    return rows if top is None else rows.orderBy(F.desc("abs_deviation"), "ts_ns", "agg_trade_id").limit(top)


def window_sweep(trades: DataFrame, snapshots: DataFrame, largest: int = 10) -> DataFrame:
    """Per window size 0 to ``largest``: shares outside the spread and beyond 100 and 500 ticks, whether it is
    the best (fewest outside, the smaller on ties), and the drift that a larger best window would imply."""
    found = _with_frames(trades, snapshots, list(range(largest + 1)))
    shares = {"outside_pct": 0, "over_100_pct": 100, "over_500_pct": 500}

    def beyond(w: int, over: int) -> Column:
        spread = F.col("snap.spreads")[w]
        return F.count_if(F.abs(X.deviation(F.col("price_ticks"), spread["ext_bid"], spread["ext_ask"])) > over)

    counts = found.agg(F.count("*").alias("n"), *(beyond(w, over).alias(f"{name}{w}") for w in range(largest + 1) for name, over in shares.items()))  # one row
    rows = F.array(*(F.struct(F.lit(w).alias("w"), *(X.safe_pct(F.col(f"{name}{w}"), F.col("n")).alias(name) for name in shares)) for w in range(largest + 1)))
    per = counts.where("n > 0").select(F.inline(rows))
    best = F.min_by("w", F.struct("outside_pct", "w")).over(Window.partitionBy())  # one row per window size
    return per.select("w", "outside_pct", "over_100_pct", "over_500_pct", (F.col("w") == best).alias("is_best"), F.when(F.col("w") > 1, F.col("w") * 50).otherwise(0).alias("drift_ms"))


def sample(trades: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` trades by the hash of their key, the same on every run; all of them where there are no more. The hash is the first
    15 hex digits of the MD5 of symbol|ts_ns|agg_trade_id|seed, so other engines draw the same sample.

    A count by the upper 16 bits of the hash tells which rows are in for certain, so only those of one value, about one
    in 65,536, are ordered: ``n`` may be as large as the table."""
    digest = F.md5(F.concat_ws("|", F.col("symbol"), F.col("ts_ns").cast("string"), F.col("agg_trade_id").cast("string"), F.lit(str(seed))).cast("binary"))
    rows = trades.withColumn("_hash", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    upper = F.shiftright("_hash", 44)
    taken, edge = 0, None
    for value, size in sorted(map(tuple, rows.groupBy(upper.alias("v")).agg(F.count("*").alias("n")).collect())):  # 65,536 rows at most
        if taken + size > n:
            edge = value
            break
        taken += size
    if edge is None:
        return trades
    last = rows.where(upper == edge).orderBy("_hash", "symbol", "ts_ns", "agg_trade_id").limit(n - taken)
    return rows.where(upper < edge).unionByName(last).drop("_hash")
