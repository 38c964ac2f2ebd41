"""Table schemas of the market lake and the scale of its fixed-point numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SNAPSHOTS = T.StructType(
    [
        T.StructField("ts_ns", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("u", T.LongType()),
        T.StructField("best_bid_ticks", T.LongType()),
        T.StructField("best_ask_ticks", T.LongType()),
        T.StructField("bids_price_delta", T.ArrayType(T.IntegerType())),
        T.StructField("bids_qty_lots", T.ArrayType(T.LongType())),
        T.StructField("asks_price_delta", T.ArrayType(T.IntegerType())),
        T.StructField("asks_qty_lots", T.ArrayType(T.LongType())),
        T.StructField("resync_epoch", T.IntegerType()),
    ]
)
TRADES = T.StructType(
    [
        T.StructField("ts_ns", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("price_ticks", T.LongType()),
        T.StructField("qty_lots", T.LongType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
        T.StructField("agg_trade_id", T.LongType()),
        T.StructField("first_trade_id", T.LongType()),
        T.StructField("last_trade_id", T.LongType()),
    ]
)
CALIBRATION = T.StructType(
    [
        T.StructField("window_start_ns", T.LongType()),
        T.StructField("window_end_ns", T.LongType()),
        T.StructField("window_start_time", T.StringType()),
        T.StructField("optimal_offset_ms", T.DoubleType()),
        T.StructField("outside_spread_rate", T.DoubleType()),
        T.StructField("trade_count", T.LongType()),
        T.StructField("snapshot_count", T.LongType()),
    ]
)
_LEVELS = "ARRAY<ARRAY<STRING>>"
DEPTH_EVENT = f"e STRING, E BIGINT, T BIGINT, s STRING, U BIGINT, u BIGINT, pu BIGINT, b {_LEVELS}, a {_LEVELS}"
BOOK_EVENT = f"lastUpdateId BIGINT, bids {_LEVELS}, asks {_LEVELS}"
TRADE_EVENT = "T BIGINT, s STRING, p STRING, q STRING, m BOOLEAN, a BIGINT, f BIGINT, l BIGINT"


@dataclass(frozen=True)
class Scale:
    """Decimal places of prices and quantities; a tick or step size, where set, takes their place."""

    price_scale: int = 1
    qty_scale: int = 3
    tick_size: float | None = None
    step_size: float | None = None
