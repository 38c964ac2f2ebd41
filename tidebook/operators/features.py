"""Windowed features and training splits over the market tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import expressions as X
from tidebook.functions.expressions import NS_HOUR, whole
from tidebook.operators.asof import asof_backward, previous


def sliding_windows(snapshots: DataFrame, trades: DataFrame, length_ns: int, step_ns: int) -> DataFrame:
    """(symbol, start_ns, ...) of overlapping windows aligned to ``step_ns``: mean spread, top-level imbalance,
    volume per side, first and last epoch, and whether the window spans an epoch boundary. Windows need a
    snapshot; those without trades have volume 0. Rows are first summed by pane, one ``step_ns`` long; a window is
    put together from its panes."""

    panes = length_ns // step_ns
    pane = whole(F.col("ts_ns"), step_ns).alias("pane")

    def windowed(per_pane: DataFrame) -> DataFrame:
        """Each pane, an aggregate of its rows, with the start of every window that holds it."""
        starts = F.transform(F.sequence(F.lit(0), F.lit(panes - 1)), lambda k: (F.col("pane") - k) * step_ns)
        return per_pane.withColumn("start_ns", F.explode(starts)).drop("pane")

    bid, ask = F.get("bids_qty_lots", F.lit(0)), F.get("asks_qty_lots", F.lit(0))
    books = snapshots.select("symbol", pane, (F.col("best_ask_ticks") - F.col("best_bid_ticks")).alias("spread"), F.try_divide(bid - ask, bid + ask).alias("imbalance"), "resync_epoch")
    sums = [F.count("*").alias("snapshots"), F.min("resync_epoch").alias("min_epoch"), F.max("resync_epoch").alias("max_epoch")]
    sums += [f(c).alias(f"{name}_{c}") for c in ("spread", "imbalance") for f, name in ((F.sum, "sum"), (F.count, "n"))]
    a = windowed(books.groupBy("symbol", "pane").agg(*sums)).groupBy("symbol", "start_ns").agg(
        F.sum("snapshots").alias("snapshots"), F.try_divide(F.sum("sum_spread"), F.sum("n_spread")).alias("avg_spread"),
        F.try_divide(F.sum("sum_imbalance"), F.sum("n_imbalance")).alias("imbalance"), F.min("min_epoch").alias("min_epoch"), F.max("max_epoch").alias("max_epoch"),
    )
    side, lots = X.consumed_side(F.col("is_buyer_maker")), F.col("qty_lots")
    volumes = trades.groupBy("symbol", pane).agg(F.sum(F.when(side == "bid", lots)).alias("bid_lots"), F.sum(F.when(side == "ask", lots)).alias("ask_lots"))
    b = windowed(volumes).groupBy("symbol", "start_ns").agg(F.sum("bid_lots").alias("bid_lots"), F.sum("ask_lots").alias("ask_lots"))
    return a.join(b, ["symbol", "start_ns"], "left").fillna(0, ["bid_lots", "ask_lots"]).withColumn("crosses_epoch", F.col("min_epoch") != F.col("max_epoch"))


def price_move(snapshots: DataFrame, ahead_ns: int, clamp: int = 10, bucket_ns: int = NS_HOUR) -> DataFrame:
    """(symbol, ts_ns, u, move_ticks, target): the best bid ``ahead_ns`` later less the one now, and that cut to
    -clamp .. clamp; null once no snapshot lies after the asked time's day of data ends."""
    asked = snapshots.select("symbol", F.col("ts_ns").alias("own_ns"), F.col("u").alias("own_u"), F.col("best_bid_ticks").alias("now"), (F.col("ts_ns") + ahead_ns).alias("ts_ns"))
    ends = snapshots.groupBy("symbol").agg(F.max("ts_ns").alias("end_ns"))
    found = asof_backward(asked, snapshots, ["best_bid_ticks"], bucket_ns).join(ends, "symbol")
    move = F.when(F.col("ts_ns") <= F.col("end_ns"), F.col("snap.best_bid_ticks") - F.col("now"))
    return found.select("symbol", F.col("own_ns").alias("ts_ns"), F.col("own_u").alias("u"), move.alias("move_ticks"), F.greatest(F.lit(-clamp), F.least(F.lit(clamp), move)).alias("target"))


def chronological_split(rows: DataFrame, train: float, validate: float, embargo_ns: int) -> DataFrame:
    """``rows`` with ``split`` by time: the first ``train`` of the span, then ``validate`` of it, then test. Rows
    within ``embargo_ns`` after a cut are dropped."""
    span = rows.agg(F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))  # one row
    a = F.col("t0") + ((F.col("t1") - F.col("t0")) * train).cast("long")
    b = F.col("t0") + ((F.col("t1") - F.col("t0")) * (train + validate)).cast("long")
    t = F.col("ts_ns")
    split = F.when(t < a, "train").when((t >= a + embargo_ns) & (t < b), "validation").when(t >= b + embargo_ns, "test")
    return rows.crossJoin(F.broadcast(span)).withColumn("split", split).where("split is not null").select(*rows.columns, "split")


def data_epoch(rows: DataFrame, cutoff: str) -> DataFrame:
    """``rows`` with ``data_epoch``: pre_fix before the cutoff date, post_fix from it on."""
    return rows.withColumn("data_epoch", F.when(X.date_of(F.col("ts_ns")) >= cutoff, "post_fix").otherwise("pre_fix"))


def epoch_boundaries(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose resync epoch differs from the one before, per symbol."""
    rows = previous(snapshots.select("symbol", "ts_ns", "u", "resync_epoch"), ["resync_epoch"], ["ts_ns", "u"], ["symbol"], whole(F.col("ts_ns"), NS_HOUR))
    return rows.where(F.col("resync_epoch") != F.col("prev.resync_epoch")).select("symbol", "ts_ns", "u", "resync_epoch")
