"""Market tables derived from the generic test tables, in Spark; the SQL twins are in the query registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TS = "unix_micros(cast(ts as timestamp)) * 1000"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "event_type", f"{_TS} as ts_ns")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but a view is a trade."""
    return _events(spark, sf_dir).where("event_type <> 'view'").selectExpr(
        "ts_ns",
        "concat('S', user_id % 5) as symbol",
        "5000 + (ts_ns div 7200000000000) % 500 + event_id % 7 - 1 as price_ticks",
        "1 + (event_id * 7919) % 3000 as qty_lots",
        "event_id % 2 = 0 as is_buyer_maker",
        "event_id as agg_trade_id",
        "event_id as first_trade_id",
        "event_id as last_trade_id",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view is a snapshot of 50 levels a side, on a clock three hours behind."""
    bid = "(5000 + ((ts_ns - 10800000000000) div 7200000000000) % 500)"
    return _events(spark, sf_dir).where("event_type = 'view'").selectExpr(
        "ts_ns",
        "concat('S', user_id % 5) as symbol",
        "event_id as u",
        f"{bid} as best_bid_ticks",
        f"{bid} + event_id % 8 - 1 as best_ask_ticks",
        "transform(sequence(0, 49), i -> cast(-i as int)) as bids_price_delta",
        "transform(sequence(0, 49), i -> (event_id * 31 + i * 17) % 100) as bids_qty_lots",
        "transform(sequence(0, 49), i -> cast(i as int)) as asks_price_delta",
        "transform(sequence(0, 49), i -> (event_id * 37 + i * 13) % 100) as asks_qty_lots",
        "cast(event_id div 1000 as int) as resync_epoch",
    )


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as book changes: (symbol, side, price_ticks, qty_lots, u), quantity 0 for a delete."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "concat('S', l_suppkey % 5) as symbol",
        "if(l_linenumber % 2 = 0, 'bid', 'ask') as side",
        "l_partkey % 200 as price_ticks",
        "if(l_returnflag = 'R', 0, cast(l_quantity as bigint)) as qty_lots",
        "l_orderkey * 10 + l_linenumber as u",
    )


def recorder_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines (value): errors trigger a resync, sign-ups end one, others are noise."""
    stamp = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        f"""case event_type
          when 'error' then concat({stamp}, ' | WARNING  | recorder.sync | Resync triggered: sequence gap: step ', event_id % 3)
          when 'signup' then concat({stamp}, ' | INFO     | recorder.sync | Sync state transition: SYNCING -> LIVE')
          else concat({stamp}, ' | INFO     | recorder | tick ', event_id) end as value"""
    )
