"""How deep trades reach into the book: matching, exceedance summaries and the level table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import expressions as X
from tidebook.operators.asof import asof_backward
from tidebook.storage import cut

THRESHOLDS = (20, 50, 100, 200, 500, 1000)


NEAR = 16  # levels a side that are shuffled for every snapshot


def penetrations(trades: DataFrame, snapshots: DataFrame, max_level: int | None = 1000) -> DataFrame:
    """(symbol, ts_ns, agg_trade_id, qty_lots, side, snap_ts_ns, snap_u, penetration_level, is_overflow) of
    each trade with a snapshot at or before it. A quantity that the levels do not hold overflows: its level is
    max_level + 1, or, with None, one more than its book's stored levels.

    The match runs on keys alone. The first NEAR levels join back by key and settle nearly all trades; whole level
    arrays are fetched for the snapshots of the others only.
    """
    keys = ["symbol", "snap_ts_ns", "snap_u"]
    kept = ["symbol", "ts_ns", "agg_trade_id", "qty_lots", "is_buyer_maker", "snap_ts_ns", "snap_u"]
    matched = asof_backward(trades.select("symbol", "ts_ns", "agg_trade_id", "qty_lots", "is_buyer_maker"), snapshots, [])
    matched = matched.where("snap is not null").withColumns({"snap_ts_ns": F.col("snap.ts_ns"), "snap_u": F.col("snap.u")}).select(*kept)
    books = snapshots.select("symbol", F.col("ts_ns").alias("snap_ts_ns"), F.col("u").alias("snap_u"), "bids_qty_lots", "asks_qty_lots")
    levels = X.side_levels(F.col("is_buyer_maker"), F.col("bids_qty_lots"), F.col("asks_qty_lots"))

    near = NEAR if max_level is None else min(NEAR, max_level)
    heads = books.withColumns({c: F.slice(c, 1, near) for c in ("bids_qty_lots", "asks_qty_lots")}).dropDuplicates(keys)
    found = cut(matched.join(heads, keys).withColumn("penetration_level", X.penetration_level(F.col("qty_lots"), levels, near)).select(*kept, "penetration_level"))
    settled = F.coalesce(F.col("penetration_level") <= near, F.lit(False))
    deeper = found.where(~settled).drop("penetration_level")
    whole = books.join(deeper.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)
    top = F.size(levels) if max_level is None else F.lit(max_level)
    deep = deeper.join(whole, keys).select(*kept, X.penetration_level(F.col("qty_lots"), levels, max_level).alias("penetration_level"), top.alias("_top"))
    both = found.where(settled).withColumn("_top", F.lit(near)).unionByName(deep)
    return both.select("symbol", "ts_ns", "agg_trade_id", "qty_lots", X.consumed_side(F.col("is_buyer_maker")).alias("side"), "snap_ts_ns", "snap_u", "penetration_level", (F.col("penetration_level") > F.col("_top")).alias("is_overflow"))


def threshold_summary(found: DataFrame, by: list[str] | None = None, max_level: int = 1000, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold (and the overflow row, max_level + 1): trades and notional beyond it, and their shares.
    One pass: a conditional sum per threshold. Groups without trades have no rows."""
    by = by or []
    levels = [*thresholds, max_level + 1]
    aggs = [F.count("*").alias("n"), F.sum("qty_lots").alias("q")]
    for t in levels:
        beyond = F.col("penetration_level") > t if t <= max_level else F.col("penetration_level") == t
        aggs += [F.count_if(beyond).alias(f"n{t}"), F.coalesce(F.sum(F.when(beyond, F.col("qty_lots"))), F.lit(0)).alias(f"q{t}")]
    grouped = found.groupBy(*by).agg(*aggs)
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("trades_exceeding"), F.col(f"q{t}").alias("notional_exceeding")) for t in levels))
    flat = grouped.select(*by, "n", "q", F.inline(rows))
    return flat.select(*by, "threshold", "trades_exceeding", X.safe_pct(F.col("trades_exceeding"), F.col("n")).alias("trades_exceeding_pct"), "notional_exceeding", X.safe_pct(F.col("notional_exceeding"), F.col("q")).alias("notional_exceeding_pct"))


def level_table(found: DataFrame) -> DataFrame:
    """Trades and volume per level group, with running shares and sides; empty middle groups stay with 0.

    Individual levels if there are at most 30 different ones, else the fixed groups up to the one that
    holds the deepest trade.
    """
    bid = F.col("side") == "bid"
    # one row per level of the book at most, written once and read by all that follows
    per_level = cut(
        found.groupBy("penetration_level").agg(
            F.count("*").alias("trades"), F.sum("qty_lots").alias("lots"), F.count_if(bid).alias("bid_trades"), F.count_if(~bid).alias("ask_trades"),
            F.coalesce(F.sum(F.when(bid, F.col("qty_lots"))), F.lit(0)).alias("bid_lots"), F.coalesce(F.sum(F.when(~bid, F.col("qty_lots"))), F.lit(0)).alias("ask_lots"),
        )
    )
    total = per_level.agg(F.max("penetration_level").alias("top"), F.count("penetration_level").alias("kinds"), F.sum("trades").alias("n"), F.sum("lots").alias("q"))
    # total is one row; per_level has one row per level of the book at most
    named = per_level.crossJoin(F.broadcast(total.select("top", "kinds"))).withColumn("level_group", X.level_group(F.col("penetration_level"), F.col("top"), F.col("kinds")))
    sums = [F.sum(c).alias(c) for c in ("trades", "lots", "bid_trades", "ask_trades", "bid_lots", "ask_lots")]
    own = named.groupBy("level_group").agg(F.min("penetration_level").alias("first_level"), *sums)
    dim = total.where("kinds > 30").select(F.explode(F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high).cast("int").alias("high")) for low, high in X.LEVEL_GROUPS))).alias("g"), "top").where("g.low <= top")
    empty = dim.select(X.level_group(F.col("g.low"), F.col("top"), F.lit(31)).alias("level_group"), F.col("g.low").alias("first_level"))
    filled = own.select("level_group", "first_level", *(s for s in ("trades", "lots", "bid_trades", "ask_trades", "bid_lots", "ask_lots")))
    filled = filled.unionByName(empty.join(own, "level_group", "left_anti"), allowMissingColumns=True).fillna(0)
    running = Window.orderBy("first_level").rowsBetween(Window.unboundedPreceding, 0)  # at most 30 rows
    rows = filled.crossJoin(F.broadcast(total.select("n", "q")))
    btc = lambda c: F.bround(X.lots_to_qty(F.col(c)), 3)
    return rows.select(
        "level_group", "trades", X.safe_pct(F.col("trades"), F.col("n")).alias("pct"), X.safe_pct(F.sum("trades").over(running), F.col("n")).alias("cum_pct"),
        btc("lots").alias("btc"), X.safe_pct(F.col("lots"), F.col("q")).alias("btc_pct"), X.safe_pct(F.sum("lots").over(running), F.col("q")).alias("cum_btc_pct"),
        "bid_trades", "ask_trades", btc("bid_lots").alias("bid_btc"), btc("ask_lots").alias("ask_btc"),
    )


def price_impact_bps(qty: str, levels: str, deltas: str, best: str):
    """Average fill price of ``qty`` over the levels against the best price, in basis points; null if the
    book does not hold the quantity or it is not positive."""
    zero = F.struct(F.col(qty).cast("double").alias("left"), F.lit(0.0).alias("paid"))

    def step(acc, x):
        take = F.least(acc["left"], x["q"].cast("double"))
        return F.struct((acc["left"] - take).alias("left"), (acc["paid"] + take * x["d"]).alias("paid"))

    walked = F.aggregate(F.arrays_zip(F.col(levels).alias("q"), F.col(deltas).alias("d")), zero, step)
    return F.when((F.col(qty) > 0) & (walked["left"] == 0), F.abs(walked["paid"] / F.col(qty)) / F.col(best) * 10000)
