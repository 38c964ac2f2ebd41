"""Registered queries of the market operators, each with its DuckDB SQL.

The queries bind the operators to tables derived from the generic test tables (tidebook.sources.market).
Doubles that come from sums are rounded alike on both sides. Event spacing here is minutes, so gap limits,
windows and offsets are larger than an exchange feed's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.functions import expressions as X
from tidebook.operators import asof, calibration, features, layout, mismatch, penetration, quality, selection, sizes
from tidebook.plans import reports
from tidebook.sources import lake, market
from tidebook.storage import fresh_folder
from tidebook.streaming import book, feeds

NS_HOUR = X.NS_HOUR
GAP_MS = 2 * 3_600_000.0
MAX_LEVEL = 50

# The derived tables in SQL.
BASE = """
WITH ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) * 1000 AS ts_ns FROM events),
trades AS (
  SELECT ts_ns, 'S' || (user_id % 5) AS symbol, 5000 + (ts_ns // 7200000000000) % 500 + event_id % 7 - 1 AS price_ticks,
    1 + (event_id * 7919) % 3000 AS qty_lots, event_id % 2 = 0 AS is_buyer_maker, event_id AS agg_trade_id,
    CAST(ts_ns // 3600000000000 % 24 AS INT) AS hour, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') AS date
  FROM ev WHERE event_type <> 'view'),
snapshots AS (
  SELECT *, best_bid_ticks + u % 8 - 1 AS best_ask_ticks FROM (
    SELECT ts_ns, 'S' || (user_id % 5) AS symbol, event_id AS u, 5000 + ((ts_ns - 10800000000000) // 7200000000000) % 500 AS best_bid_ticks,
      list_transform(range(50), lambda i: (event_id * 31 + i * 17) % 100) AS bids_qty_lots,
      list_transform(range(50), lambda i: (event_id * 37 + i * 13) % 100) AS asks_qty_lots,
      CAST(event_id // 1000 AS INT) AS resync_epoch, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') AS date,
      CAST(ts_ns // 3600000000000 % 24 AS INT) AS hour
    FROM ev WHERE event_type = 'view'))
"""
MATCHED = BASE + """,
matched AS (
  SELECT t.*, s.ts_ns AS snap_ts_ns, s.u AS snap_u, s.best_bid_ticks, s.best_ask_ticks,
    CASE WHEN t.is_buyer_maker THEN s.bids_qty_lots ELSE s.asks_qty_lots END AS q
  FROM trades t ASOF LEFT JOIN snapshots s ON t.symbol = s.symbol AND t.ts_ns >= s.ts_ns)
"""
DEEP = MATCHED + """,
walked AS (
  SELECT symbol, ts_ns, agg_trade_id, qty_lots, snap_ts_ns, snap_u, CASE WHEN is_buyer_maker THEN 'bid' ELSE 'ask' END AS side,
    CAST(1 + (SELECT count(*) FROM (SELECT i, sum(x) OVER (ORDER BY i) AS cum FROM (SELECT unnest(q) AS x, generate_subscripts(q, 1) AS i)) WHERE cum < qty_lots) AS INT) AS penetration_level
  FROM matched WHERE snap_u IS NOT NULL),
deep AS (SELECT *, penetration_level > 50 AS is_overflow FROM walked)
"""
SPREADS = BASE + """,
wide AS (
  SELECT s.symbol, s.ts_ns, s.u, w,
    list_min(list_slice(b, 1, w + 1)) AS ext_bid, list_max(list_slice(a, 1, w + 1)) AS ext_ask, list_max(list_slice(t, 1, w + 1)) AS last_ts_ns
  FROM (SELECT symbol, ts_ns, u, list(best_bid_ticks) OVER o AS b, list(best_ask_ticks) OVER o AS a, list(ts_ns) OVER o AS t
        FROM snapshots WINDOW o AS (PARTITION BY symbol ORDER BY ts_ns, u ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)) s, range(11) r(w)),
spread AS (
  SELECT m.symbol, w.w, m.ts_ns, m.agg_trade_id, m.price_ticks, m.qty_lots, m.snap_ts_ns, m.snap_u, ext_bid, ext_ask, ext_ask - ext_bid AS spread,
    CASE WHEN price_ticks < ext_bid THEN price_ticks - ext_bid WHEN price_ticks > ext_ask THEN price_ticks - ext_ask ELSE 0 END AS deviation,
    (m.ts_ns - m.snap_ts_ns) / 1e6 AS time_diff_ms, (last_ts_ns - m.snap_ts_ns) / 1e6 AS window_ms, m.hour
  FROM (SELECT t.*, s.ts_ns AS snap_ts_ns, s.u AS snap_u FROM trades t ASOF JOIN snapshots s ON t.symbol = s.symbol AND t.ts_ns >= s.ts_ns) m
  JOIN wide w ON w.symbol = m.symbol AND w.ts_ns = m.snap_ts_ns AND w.u = m.snap_u)
"""
STEPS = BASE + """,
steps AS (SELECT symbol, date, ts_ns, u, lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, u) AS prev_ts_ns FROM snapshots),
timed AS (SELECT *, (ts_ns - prev_ts_ns) / 1e6 AS delta_ms FROM steps)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under ``name``, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date", X.date_of(F.col("ts_ns")))


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return penetration.penetrations(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), MAX_LEVEL)


# Scans and derived tables


@query("s1_snapshots", BASE + "SELECT symbol, ts_ns, u, best_bid_ticks, best_ask_ticks, resync_epoch, list_sum(bids_qty_lots)::BIGINT AS bid_lots, list_sum(asks_qty_lots)::BIGINT AS ask_lots FROM snapshots")
def s1_snapshots(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return market.snapshots(spark, sf_dir).select("symbol", "ts_ns", "u", "best_bid_ticks", "best_ask_ticks", "resync_epoch", total("bids_qty_lots").alias("bid_lots"), total("asks_qty_lots").alias("ask_lots"))


@query("s2_trades", BASE + "SELECT symbol, ts_ns, price_ticks, qty_lots, is_buyer_maker, agg_trade_id FROM trades")
def s2_trades(spark, sf_dir):
    return market.trades(spark, sf_dir).select("symbol", "ts_ns", "price_ticks", "qty_lots", "is_buyer_maker", "agg_trade_id")


_LAKES: dict[tuple[str, str], str] = {}


def _lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake of both tables with two half-day "hours", written once per session and read by several queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAKES:
        root = fresh_folder(spark, "lake")
        for kind, rows in (("trades", market.trades(spark, sf_dir)), ("snapshots", market.snapshots(spark, sf_dir))):
            half = F.when(X.hour_of(F.col("ts_ns")) < 12, "00").otherwise("12")
            parts = rows.withColumn("date", X.date_of(F.col("ts_ns"))).withColumn("hour", half)
            parts.repartition("symbol", "date").write.partitionBy("symbol", "date", "hour").option("compression", "zstd").parquet(f"{root}/{kind}")
        _LAKES[key] = root
    return _LAKES[key]


@query("s3_lake_one_symbol", BASE + "SELECT date, hour // 12 * 12 AS hour, count(*) AS n, sum(qty_lots)::BIGINT AS lots FROM trades WHERE symbol = 'S1' GROUP BY ALL")
def s3_lake_one_symbol(spark, sf_dir):
    rows = lake.read_table(spark, _lake(spark, sf_dir), "trades", symbol="S1")
    return rows.groupBy("date", F.col("hour").cast("int").alias("hour")).agg(F.count("*").alias("n"), F.sum("qty_lots").alias("lots"))


@query("s13_dates", BASE + "SELECT DISTINCT symbol, date FROM snapshots")
def s13_dates(spark, sf_dir):
    return lake.dates(_dated(market.snapshots(spark, sf_dir)))


@query("s14_inventory", BASE + "SELECT symbol, count(DISTINCT (date, hour // 12)) FILTER (k = 0) AS snapshot_files, count(DISTINCT (date, hour // 12)) FILTER (k = 1) AS trade_files FROM (SELECT symbol, date, hour, 0 AS k FROM snapshots UNION ALL SELECT symbol, date, hour, 1 FROM trades) GROUP BY symbol")
def s14_inventory(spark, sf_dir):
    root = _lake(spark, sf_dir)
    return layout.inventory(*(layout.with_files(lake.read_table(spark, root, kind)) for kind in ("snapshots", "trades")))


@query("s15_file_counts", BASE + "SELECT symbol, date, hour // 12 * 12 AS hour, count(*) AS rows, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM trades GROUP BY ALL")
def s15_file_counts(spark, sf_dir):
    rows = layout.with_files(lake.read_table(spark, _lake(spark, sf_dir), "trades"))
    return layout.file_counts(rows, ["symbol", "date", "hour"]).select("symbol", "date", F.col("hour").cast("int").alias("hour"), "rows", "first_ns", "last_ns")


@query("s11_trade_events", BASE + "SELECT ts_ns // 1000000 * 1000000 AS ts_ns, symbol, price_ticks, qty_lots, is_buyer_maker, CASE WHEN agg_trade_id % 3 = 0 THEN 0 ELSE agg_trade_id END AS agg_trade_id FROM trades")
def s11_trade_events(spark, sf_dir):
    """Trades as JSON lines and back; every third lacks its ids, and a line in between is broken."""
    t = market.trades(spark, sf_dir)
    line = F.to_json(F.struct(X.whole(F.col("ts_ns"), 1_000_000).alias("T"), F.col("symbol").alias("s"), F.format_string("%.1f", F.col("price_ticks") / 10.0).alias("p"), F.format_string("%.3f", F.col("qty_lots") / 1000.0).alias("q"), F.col("is_buyer_maker").alias("m"), F.when(F.col("agg_trade_id") % 3 != 0, F.col("agg_trade_id")).alias("a")))
    lines = t.select(F.explode(F.array(line, F.lit("{broken"))).alias("value"))
    return feeds.trade_rows(feeds.decode(lines, schemas.TRADE_EVENT)).select("ts_ns", "symbol", "price_ticks", "qty_lots", "is_buyer_maker", "agg_trade_id")


@query("s9_log_lines", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS lines FROM events GROUP BY 1")
def s9_log_lines(spark, sf_dir):
    return market.recorder_log(spark, sf_dir).groupBy(F.substring("value", 1, 10).alias("date")).agg(F.count("*").alias("lines"))


# Expressions


@query("p1_scaled_numbers", """SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 10.0, 0)::BIGINT AS price_ticks, round_even(l_extendedprice / 0.05, 0)::BIGINT AS ticks_by_size,
  round_even(l_quantity * 1000.0, 0)::BIGINT AS qty_lots, round_even(l_extendedprice * 10.0, 0)::BIGINT / 10.0 AS price, round_even(l_quantity * 1000.0, 0)::BIGINT / 1000.0 AS qty FROM lineitem""")
def p1_scaled_numbers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ticks, lots = X.price_to_ticks(F.col("l_extendedprice")), X.qty_to_lots(F.col("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", ticks.alias("price_ticks"), X.price_to_ticks(F.col("l_extendedprice"), schemas.Scale(tick_size=0.05)).alias("ticks_by_size"), lots.alias("qty_lots"), X.ticks_to_price(ticks).alias("price"), X.lots_to_qty(lots).alias("qty"))


@query("p6_time_keys", BASE + "SELECT agg_trade_id, hour, date, lpad(hour::VARCHAR, 2, '0') AS part_hour, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%f') AS trade_time FROM trades")
def p6_time_keys(spark, sf_dir):
    ts = F.col("ts_ns")
    return market.trades(spark, sf_dir).select("agg_trade_id", X.hour_of(ts).alias("hour"), X.date_of(ts).alias("date"), X.part_hour(ts).alias("part_hour"), X.trade_time(ts).alias("trade_time"))


BUCKET_CASE = "CASE WHEN qty_lots < 1 THEN 'dust' WHEN qty_lots < 10 THEN 'micro' WHEN qty_lots < 100 THEN 'small' WHEN qty_lots < 1000 THEN 'medium' WHEN qty_lots < 10000 THEN 'large' WHEN qty_lots < 100000 THEN 'whale' ELSE 'mega' END"


@query("p12_size_bucket", BASE + f"SELECT agg_trade_id, {BUCKET_CASE} AS bucket, CASE WHEN is_buyer_maker THEN 'bid' ELSE 'ask' END AS side FROM trades")
def p12_size_bucket(spark, sf_dir):
    return market.trades(spark, sf_dir).select("agg_trade_id", X.size_bucket(F.col("qty_lots")).alias("bucket"), X.consumed_side(F.col("is_buyer_maker")).alias("side"))


@query("p22_level_prices", BASE + "SELECT u, i - 1 AS level, best_bid_ticks - (i - 1) AS price, bids_qty_lots[i] AS qty FROM snapshots, range(1, 51) r(i) WHERE bids_qty_lots[i] > 0")
def p22_level_prices(spark, sf_dir):
    """Absolute prices through delta encoding, padding to 60 levels and back, padding dropped."""
    s = market.snapshots(spark, sf_dir)
    prices = X.absolute_prices(F.col("best_bid_ticks"), F.col("bids_price_delta"))
    deltas = X.delta_encode(prices, F.col("best_bid_ticks"))
    back = X.absolute_prices(F.col("best_bid_ticks"), X.pad(deltas, 60))
    rows = s.select("u", F.posexplode(F.arrays_zip(back.alias("price"), X.pad(F.col("bids_qty_lots"), 60).alias("qty"))).alias("level", "x"))
    return rows.where("x.qty > 0").select("u", F.col("level").cast("long").alias("level"), "x.price", "x.qty")


# As-of matching and penetration


@query("j1_asof", MATCHED + "SELECT symbol, ts_ns, agg_trade_id, snap_ts_ns, snap_u, best_bid_ticks FROM matched")
def j1_asof(spark, sf_dir):
    found = asof.asof_backward(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), ["best_bid_ticks"])
    return found.select("symbol", "ts_ns", "agg_trade_id", F.col("snap.ts_ns").alias("snap_ts_ns"), F.col("snap.u").alias("snap_u"), "snap.best_bid_ticks")


@query("j1_asof_same_epoch", BASE + """, t AS (SELECT symbol, ts_ns, agg_trade_id, CAST(agg_trade_id // 1000 AS INT) AS resync_epoch FROM trades)
SELECT t.symbol, t.ts_ns, t.agg_trade_id, t.resync_epoch, s.ts_ns AS snap_ts_ns, s.u AS snap_u FROM t ASOF LEFT JOIN snapshots s ON t.symbol = s.symbol AND t.resync_epoch = s.resync_epoch AND t.ts_ns >= s.ts_ns""")
def j1_asof_same_epoch(spark, sf_dir):
    """Trades get the epoch of their id's thousand, as the snapshots do."""
    trades = market.trades(spark, sf_dir).withColumn("resync_epoch", X.whole(F.col("agg_trade_id"), 1000).cast("int"))
    found = asof.asof_backward(trades, market.snapshots(spark, sf_dir), [], same_epoch="resync_epoch")
    return found.select("symbol", "ts_ns", "agg_trade_id", "resync_epoch", F.col("snap.ts_ns").alias("snap_ts_ns"), F.col("snap.u").alias("snap_u"))


@query("j2_extended_spread", SPREADS + "SELECT symbol, w, ts_ns, agg_trade_id, price_ticks, qty_lots, snap_ts_ns, snap_u, ext_bid, ext_ask, spread, deviation, abs(deviation) AS abs_deviation, time_diff_ms, window_ms FROM spread WHERE w = 1")
def j2_extended_spread(spark, sf_dir):
    return mismatch.match_spread(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), (1,))


@query("j3_asof_offset", BASE + "SELECT t.symbol, t.agg_trade_id, s.u AS snap_u FROM trades t ASOF LEFT JOIN (SELECT *, ts_ns - 3600000000000 AS moved FROM snapshots) s ON t.symbol = s.symbol AND t.ts_ns >= s.moved")
def j3_asof_offset(spark, sf_dir):
    found = asof.asof_backward(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), [], offset_ns=-NS_HOUR)
    return found.select("symbol", "agg_trade_id", F.col("snap.u").alias("snap_u"))


@query("p10_penetration", DEEP + "SELECT symbol, ts_ns, agg_trade_id, qty_lots, side, snap_ts_ns, snap_u, penetration_level, is_overflow FROM deep")
def p10_penetration(spark, sf_dir):
    return _deep(spark, sf_dir)


def _thresholds(by: str) -> str:
    group = f"{by}, " if by else ""
    return DEEP + f""", t(threshold) AS (VALUES (20), (50), (100), (200), (500), (1000), (51))
SELECT {group}threshold, count(*) FILTER (beyond) AS trades_exceeding, round(coalesce(100.0 * count(*) FILTER (beyond) / count(*), 0), 6) AS trades_exceeding_pct,
  coalesce(sum(qty_lots) FILTER (beyond), 0)::BIGINT AS notional_exceeding, round(coalesce(100.0 * sum(qty_lots) FILTER (beyond) / sum(qty_lots), 0), 6) AS notional_exceeding_pct
FROM (SELECT *, CASE WHEN threshold = 51 OR threshold > 50 THEN penetration_level = threshold ELSE penetration_level > threshold END AS beyond FROM deep, t) GROUP BY {group}threshold"""


@query("a1_threshold_summary", _thresholds(""))
def a1_threshold_summary(spark, sf_dir):
    return _rounded(penetration.threshold_summary(_deep(spark, sf_dir), None, MAX_LEVEL))


@query("a2_threshold_by_side", _thresholds("side"))
def a2_threshold_by_side(spark, sf_dir):
    return _rounded(penetration.threshold_summary(_deep(spark, sf_dir), ["side"], MAX_LEVEL))


@query("a3_percentiles", DEEP + "SELECT side, round(quantile_cont(penetration_level, 0.5), 6) AS p50, round(quantile_cont(penetration_level, 0.9), 6) AS p90, round(quantile_cont(penetration_level, 0.99), 6) AS p99, round(quantile_cont(penetration_level, 0.999), 6) AS p99_9, max(penetration_level) AS max FROM deep GROUP BY side")
def a3_percentiles(spark, sf_dir):
    return _rounded(selection.percentiles(_deep(spark, sf_dir), "penetration_level", by=["side"]))


@query("a4_level_table", DEEP + """, dim AS (SELECT * FROM (VALUES (1,1),(2,2),(3,3),(4,4),(5,9),(10,19),(20,49),(50,99),(100,199),(200,499),(500,999),(1000,NULL)) d(low, high)),
tot AS (SELECT max(penetration_level) AS top, count(DISTINCT penetration_level) AS kinds, count(*) AS n, sum(qty_lots) AS q FROM deep),
groups AS (
  SELECT low, high, CASE WHEN low = high THEN low::VARCHAR ELSE low || '-' || coalesce(high, top) END AS level_group FROM dim, tot WHERE kinds > 30 AND low <= top
  UNION ALL SELECT DISTINCT penetration_level, penetration_level, penetration_level::VARCHAR FROM deep, tot WHERE kinds <= 30),
per AS (
  SELECT g.level_group, g.low, count(d.side) AS trades, coalesce(sum(d.qty_lots), 0) AS lots, count(*) FILTER (d.side = 'bid') AS bid_trades, count(*) FILTER (d.side = 'ask') AS ask_trades,
    coalesce(sum(d.qty_lots) FILTER (d.side = 'bid'), 0) AS bid_lots, coalesce(sum(d.qty_lots) FILTER (d.side = 'ask'), 0) AS ask_lots
  FROM groups g LEFT JOIN deep d ON d.penetration_level >= g.low AND (g.high IS NULL OR d.penetration_level <= g.high) GROUP BY ALL)
SELECT level_group, trades, round(100.0 * trades / n, 6) AS pct, round(100.0 * sum(trades) OVER (ORDER BY low) / n, 6) AS cum_pct, round(lots / 1000.0, 3) AS btc,
  round(100.0 * lots / q, 6) AS btc_pct, round(100.0 * sum(lots) OVER (ORDER BY low) / q, 6) AS cum_btc_pct, bid_trades, ask_trades, round(bid_lots / 1000.0, 3) AS bid_btc, round(ask_lots / 1000.0, 3) AS ask_btc
FROM per, tot""")
def a4_level_table(spark, sf_dir):
    return _rounded(penetration.level_table(_deep(spark, sf_dir)))


@query("c2_level_report", ORACLE_SQL["a4_level_table"])
def c2_level_report(spark, sf_dir):
    """The level table of the job, where overflow is one beyond the stored levels (50 here)."""
    return _rounded(reports.level_report(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir))["level_table"])


# Trade sizes

SIZES = BASE + f", t AS (SELECT *, {BUCKET_CASE} AS bucket FROM trades), dim(bucket, label, k) AS (VALUES ('dust','0.000-0.001',0),('micro','0.001-0.010',1),('small','0.010-0.100',2),('medium','0.100-1.000',3),('large','1.000-10.000',4),('whale','10.000-100.000',5),('mega','100.000+',6))"


@query("a5_size_table", SIZES + """, per AS (SELECT dim.bucket, label, k, count(t.symbol) AS trades, coalesce(sum(qty_lots), 0) AS lots, coalesce(max(qty_lots), 0) AS top FROM dim LEFT JOIN t ON t.bucket = dim.bucket GROUP BY ALL)
SELECT bucket, label, trades, round(100.0 * trades / sum(trades) OVER (), 6) AS pct, round(100.0 * sum(trades) OVER (ORDER BY k) / sum(trades) OVER (), 6) AS cum_pct, round(lots / 1000.0, 3) AS btc,
  round(100.0 * lots / sum(lots) OVER (), 6) AS btc_pct, round(100.0 * sum(lots) OVER (ORDER BY k) / sum(lots) OVER (), 6) AS cum_btc_pct, round_even(coalesce(lots / 1000.0 / nullif(trades, 0), 0), 4) AS avg_btc, round(top / 1000.0, 4) AS max_btc FROM per""")
def a5_size_table(spark, sf_dir):
    return _rounded(sizes.size_table(market.trades(spark, sf_dir)))


def _heat(value: str) -> str:
    return SIZES + " SELECT dim.bucket, " + ", ".join(value.format(h=h) + f" AS h{h:02d}" for h in range(24)) + " FROM dim LEFT JOIN t ON t.bucket = dim.bucket GROUP BY dim.bucket"


@query("a6_hourly_heatmap", _heat("count(*) FILTER (hour = {h})"))
def a6_hourly_heatmap(spark, sf_dir):
    return sizes.hourly_heatmap(market.trades(spark, sf_dir))


@query("a7_hourly_volume", _heat("round_even(coalesce(sum(qty_lots) FILTER (hour = {h}), 0) / 1000.0, 1)"))
def a7_hourly_volume(spark, sf_dir):
    return sizes.hourly_heatmap(market.trades(spark, sf_dir), volume=True)


# Price mismatch

STATS = """count(*) AS matched, round(avg(abs(deviation)), 6) AS mean_abs, round(stddev_pop(abs(deviation)), 6) AS std_abs, max(abs(deviation)) AS max_abs, round(quantile_cont(abs(deviation), 0.5), 6) AS median_abs, min(deviation) AS min_signed, max(deviation) AS max_signed,
  count(*) FILTER (deviation <> 0) AS outside, count(*) FILTER (abs(deviation) > 10) AS over_10, count(*) FILTER (abs(deviation) > 100) AS over_100, count(*) FILTER (abs(deviation) > 500) AS over_500, count(*) FILTER (abs(deviation) > 1000) AS over_1000,
  round(100.0 * count(*) FILTER (deviation <> 0) / count(*), 6) AS outside_pct, round(100.0 * count(*) FILTER (abs(deviation) > 100) / count(*), 6) AS over_100_pct, round(avg(time_diff_ms), 6) AS mean_time_diff_ms, round(max(time_diff_ms), 6) AS max_time_diff_ms"""


@query("a22_mismatch_report", SPREADS + f"SELECT symbol, {STATS} FROM spread WHERE w = 1 GROUP BY symbol")
def a22_mismatch_report(spark, sf_dir):
    return _rounded(mismatch.report(mismatch.match_spread(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir)), ["symbol"]))


@query("a23_mismatch_by_hour", SPREADS + "SELECT hour, count(*) AS trades, round(avg(abs(deviation)), 6) AS mean_abs, max(abs(deviation)) AS max_abs, round(avg(time_diff_ms), 6) AS mean_time_diff_ms, count(*) FILTER (abs(deviation) > 100) AS over_100 FROM spread WHERE w = 1 GROUP BY hour")
def a23_mismatch_by_hour(spark, sf_dir):
    return _rounded(mismatch.by_hour(mismatch.match_spread(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir))))


@query("a24_window_sweep", SPREADS + """, per AS (SELECT w, round(100.0 * count(*) FILTER (deviation <> 0) / count(*), 6) AS outside_pct, round(100.0 * count(*) FILTER (abs(deviation) > 100) / count(*), 6) AS over_100_pct, round(100.0 * count(*) FILTER (abs(deviation) > 500) / count(*), 6) AS over_500_pct FROM spread GROUP BY w)
SELECT CAST(w AS INT) AS w, outside_pct, over_100_pct, over_500_pct, w = (SELECT arg_min(w, (outside_pct, w)) FROM per) AS is_best, CASE WHEN w > 1 THEN CAST(w AS INT) * 50 ELSE 0 END AS drift_ms FROM per""")
def a24_window_sweep(spark, sf_dir):
    return _rounded(mismatch.window_sweep(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir)))


@query("o4_largest_deviations", SPREADS + "SELECT symbol, agg_trade_id, deviation, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%f') AS trade_time FROM spread WHERE w = 1 AND abs(deviation) > 3 ORDER BY abs(deviation) DESC, ts_ns, agg_trade_id LIMIT 20")
def o4_largest_deviations(spark, sf_dir):
    found = mismatch.match_spread(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir))
    return mismatch.large(found, over=3, top=20).select("symbol", "agg_trade_id", "deviation", "trade_time")


# Quality


@query("a12_gap_report", STEPS + f""", per AS (SELECT symbol, count(*) AS snapshots, count(*) FILTER (delta_ms > {GAP_MS}) AS gaps, coalesce(max(delta_ms) FILTER (delta_ms > {GAP_MS}), 0) AS max_gap_ms, coalesce(sum(delta_ms) FILTER (delta_ms > {GAP_MS}), 0) AS gap_ms, (max(ts_ns) - min(ts_ns)) / 1e6 AS span_ms FROM timed GROUP BY symbol)
SELECT symbol, snapshots, gaps, round(max_gap_ms, 4) AS max_gap_ms, round(gap_ms / 1000, 4) AS total_gap_s, round(100 * (1 - gap_ms / (snapshots * 3600000.0)), 4) AS completeness_by_time, round(CASE WHEN snapshots < 2 THEN 0 ELSE least(100, coalesce(100.0 * snapshots / (nullif(span_ms, 0) / 3600000.0), 100)) END, 4) AS completeness_by_count FROM per""")
def a12_gap_report(spark, sf_dir):
    return _rounded(quality.gap_report(market.snapshots(spark, sf_dir), ["symbol"], 3_600_000.0, GAP_MS - 3_600_000.0), 4)


@query("o2_largest_gaps", STEPS + f"SELECT symbol, prev_ts_ns AS start_ns, ts_ns AS end_ns, delta_ms FROM timed WHERE delta_ms > {GAP_MS} ORDER BY delta_ms DESC, symbol, ts_ns LIMIT 10")
def o2_largest_gaps(spark, sf_dir):
    return quality.largest_gaps(market.snapshots(spark, sf_dir), ["symbol"], 3_600_000.0, GAP_MS - 3_600_000.0)


IDS = BASE + ", ids AS (SELECT symbol, agg_trade_id AS id, lag(agg_trade_id) OVER (PARTITION BY symbol ORDER BY agg_trade_id) AS prev FROM trades WHERE agg_trade_id > 0)"


@query("a14_id_gaps", IDS + " SELECT symbol, prev + 1 AS start, id AS \"end\", id - prev - 1 AS missing FROM ids WHERE id - prev > 1")
def a14_id_gaps(spark, sf_dir):
    return quality.id_gaps(market.trades(spark, sf_dir), ["symbol"])


@query("a15_id_report", IDS + """ SELECT symbol, count(*) AS ids, count(DISTINCT id) AS unique_ids, count(*) - count(DISTINCT id) AS duplicates, min(id) AS first_id, max(id) AS last_id, max(id) - min(id) + 1 AS expected,
  max(id) - min(id) + 1 - count(DISTINCT id) AS missing_ids, count(*) FILTER (id - prev > 1) AS gap_ranges, CASE WHEN count(*) < 2 THEN 100.0 ELSE 100.0 * count(*) / (max(id) - min(id) + 1) END AS completeness FROM ids GROUP BY symbol""")
def a15_id_report(spark, sf_dir):
    return quality.id_report(market.trades(spark, sf_dir), ["symbol"])


@query("a17_file_id_gaps", BASE + """, f AS (SELECT symbol, min(agg_trade_id) AS low, max(agg_trade_id) AS high, count(*) AS n FROM trades WHERE agg_trade_id > 0 GROUP BY symbol, date, hour // 12),
g AS (SELECT *, low - max(high) OVER (PARTITION BY symbol ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM f)
SELECT symbol, count(*) AS files, sum(n)::BIGINT AS ids, count(*) FILTER (step > 1) AS gap_ranges, coalesce(sum(step - 1) FILTER (step > 1), 0)::BIGINT AS missing_between_files FROM g GROUP BY symbol""")
def a17_file_id_gaps(spark, sf_dir):
    rows = layout.with_files(lake.read_table(spark, _lake(spark, sf_dir), "trades"))
    return quality.file_id_gaps(rows, F.col("file_path"), ["symbol"])


@query("a18_spread_report", BASE + """, s AS (SELECT symbol, best_ask_ticks - best_bid_ticks AS s FROM snapshots)
SELECT symbol, count(*) FILTER (s < 0) AS crossed, count(*) FILTER (s = 0) AS zero, coalesce(min(s) FILTER (s > 0), 0) AS min_spread, coalesce(max(s) FILTER (s > 0), 0) AS max_spread, round(coalesce(avg(s) FILTER (s > 0), 0), 6) AS avg_spread FROM s GROUP BY symbol""")
def a18_spread_report(spark, sf_dir):
    return _rounded(quality.spread_report(market.snapshots(spark, sf_dir), ["symbol"]))


@query("o6_crossed_books", BASE + "SELECT symbol, ts_ns, u, best_bid_ticks, best_ask_ticks FROM snapshots WHERE best_ask_ticks < best_bid_ticks ORDER BY ts_ns, u LIMIT 10")
def o6_crossed_books(spark, sf_dir):
    return quality.crossed_books(market.snapshots(spark, sf_dir), ["symbol"])


@query("a21_span", BASE + "SELECT symbol, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, round((max(ts_ns) - min(ts_ns)) / 3600000000000.0, 6) AS duration_h FROM (SELECT symbol, ts_ns FROM trades UNION ALL SELECT symbol, ts_ns FROM snapshots) GROUP BY symbol")
def a21_span(spark, sf_dir):
    return _rounded(quality.span(market.snapshots(spark, sf_dir), market.trades(spark, sf_dir), ["symbol"]))


@query("j5_compare_ids", BASE + """, a AS (SELECT symbol, agg_trade_id FROM trades WHERE agg_trade_id > 0 AND agg_trade_id % 10 <> 3), b AS (SELECT symbol, agg_trade_id FROM trades WHERE agg_trade_id > 0 AND agg_trade_id % 17 <> 5)
SELECT symbol, count(a.agg_trade_id) AS local_ids, count(b.agg_trade_id) AS reference_ids, count(*) FILTER (a.agg_trade_id IS NULL) AS missing_here, count(*) FILTER (b.agg_trade_id IS NULL) AS extra_here, round(100 * (1 - count(*) FILTER (a.agg_trade_id IS NULL) / count(b.agg_trade_id)), 6) AS completeness
FROM a FULL JOIN b USING (symbol, agg_trade_id) GROUP BY symbol""")
def j5_compare_ids(spark, sf_dir):
    t = market.trades(spark, sf_dir)
    return _rounded(quality.compare_ids(t.where("agg_trade_id % 10 <> 3"), t.where("agg_trade_id % 17 <> 5"), ["symbol"]))


@query("j6_cross_check", BASE + """, edge AS (SELECT symbol, min(agg_trade_id) AS a, max(agg_trade_id) AS b FROM trades WHERE agg_trade_id > 0 GROUP BY symbol)
SELECT t.symbol, agg_trade_id, CASE WHEN agg_trade_id % 3 = 0 THEN 'not_found' WHEN agg_trade_id % 3 = 1 THEN 'mismatch' ELSE 'verified' END AS status FROM trades t JOIN edge e ON t.symbol = e.symbol AND agg_trade_id IN (a, b)""")
def j6_cross_check(spark, sf_dir):
    t = market.trades(spark, sf_dir)
    reference = t.where("agg_trade_id % 3 <> 0").withColumn("price_ticks", F.col("price_ticks") + (F.col("agg_trade_id") % 3 == 1).cast("long"))
    return quality.cross_check(quality.edge_ids(t, ["symbol"]), reference)


@query("a25_plausibility", BASE + "SELECT symbol, round(avg(best_bid_ticks / 10.0), 6) AS avg_price, min(best_bid_ticks / 10.0) AS min_price, max(best_bid_ticks / 10.0) AS max_price, round(max(best_bid_ticks / 10.0) - min(best_bid_ticks / 10.0), 6) AS price_range, avg(best_bid_ticks / 10.0) BETWEEN 500 AND 550 AS price_ok FROM snapshots GROUP BY symbol")
def a25_plausibility(spark, sf_dir):
    return _rounded(quality.plausibility(market.snapshots(spark, sf_dir), ["symbol"], 500, 550))


@query("a26_consistency", BASE + """, o AS (SELECT symbol, ts_ns, price_ticks, qty_lots, lag(ts_ns) OVER (PARTITION BY symbol ORDER BY agg_trade_id) AS p FROM trades WHERE agg_trade_id > 0),
x AS (SELECT symbol, bool_and(price_ticks > 0) AS trade_prices_ok, bool_and(qty_lots > 0) AS quantities_ok FROM trades GROUP BY symbol), y AS (SELECT symbol, bool_and(best_bid_ticks > 0 AND best_ask_ticks > 0) AS book_prices_ok FROM snapshots GROUP BY symbol),
z AS (SELECT symbol, count(*) FILTER (ts_ns < p) AS inversions FROM o GROUP BY symbol)
SELECT symbol, book_prices_ok, trade_prices_ok, quantities_ok, inversions, coalesce(inversions, 0) = 0 AS monotonic FROM x FULL JOIN y USING (symbol) LEFT JOIN z USING (symbol)""")
def a26_consistency(spark, sf_dir):
    return quality.consistency(market.snapshots(spark, sf_dir), market.trades(spark, sf_dir), ["symbol"])


@query("a27_symbols", BASE + "SELECT string_agg(symbol, ',' ORDER BY symbol) AS symbols, bool_and(symbol IN ('S0','S1','S2')) AS only_expected FROM (SELECT symbol FROM trades UNION SELECT symbol FROM snapshots)")
def a27_symbols(spark, sf_dir):
    return quality.symbols_seen(market.snapshots(spark, sf_dir), market.trades(spark, sf_dir), ["S0", "S1", "S2"])


SUMMARY = BASE + """, d AS (SELECT strftime(DATE '2023-12-30' + CAST(k AS INT), '%Y-%m-%d') AS date FROM range(40) r(k)),
i AS (SELECT date, count(*) AS ids, count(*) - count(DISTINCT agg_trade_id) AS duplicates, max(agg_trade_id) - min(agg_trade_id) + 1 - count(DISTINCT agg_trade_id) AS missing_ids FROM trades WHERE agg_trade_id > 0 GROUP BY date),
p AS (SELECT date, round(avg(best_bid_ticks / 10.0), 6) AS avg_price, avg(best_bid_ticks / 10.0) BETWEEN 500 AND 550 AS price_ok FROM snapshots GROUP BY date),
s AS (SELECT d.date, coalesce(ids, 0) AS ids, coalesce(duplicates, -1) AS duplicates, coalesce(missing_ids, -1) AS missing_ids, coalesce(avg_price, 0) AS avg_price, coalesce(price_ok, false) AS price_ok FROM d LEFT JOIN i USING (date) LEFT JOIN p USING (date))
"""


def _asked_dates(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.date_format(F.date_add(F.lit("2023-12-30").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.source_summary(_dated(market.trades(spark, sf_dir)), _dated(market.snapshots(spark, sf_dir)), _asked_dates(spark), 500, 550)


@query("a28_source_summary", SUMMARY + "SELECT * FROM s")
def a28_source_summary(spark, sf_dir):
    return _rounded(_summary(spark, sf_dir))


@query("a28_overall", SUMMARY + "SELECT count(*) AS dates, coalesce(sum(missing_ids) FILTER (missing_ids >= 0), 0)::BIGINT AS missing_ids, coalesce(sum(duplicates) FILTER (duplicates >= 0), 0)::BIGINT AS duplicates, bool_and(price_ok) AS all_ok, round(avg(avg_price) FILTER (avg_price > 0), 4) AS mean_price FROM s")
def a28_overall(spark, sf_dir):
    return _rounded(quality.overall(_summary(spark, sf_dir)), 4)


RESYNCS = """
WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(epoch_us(date_trunc('second', ts)) // 1000000 AS BIGINT) AS at_s, event_type, 'sequence gap: step ' || (event_id % 3) AS reason FROM events),
r AS (SELECT a.date, a.at_s, a.reason, (SELECT min(b.at_s) FROM l b WHERE b.event_type = 'signup' AND b.date = a.date AND b.at_s > a.at_s) AS live_s FROM l a WHERE a.event_type = 'error')
"""


@query("j4_next_live", RESYNCS + "SELECT date, at_s, reason, live_s FROM r")
def j4_next_live(spark, sf_dir):
    return quality.resyncs(market.recorder_log(spark, sf_dir))


@query("a20_resync_report", RESYNCS + """, per AS (SELECT date, reason, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT date, string_agg(reason || '=' || n, ';' ORDER BY reason) AS reasons FROM per GROUP BY date)
SELECT date, count(*) AS resyncs, any_value(reasons) AS reasons, round(coalesce(avg(live_s - at_s), 0), 6) AS mean_resync_s FROM r JOIN m USING (date) GROUP BY date""")
def a20_resync_report(spark, sf_dir):
    rows = quality.resync_report(quality.resyncs(market.recorder_log(spark, sf_dir)))
    text = F.array_join(F.transform(F.sort_array(F.map_entries("resync_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _rounded(rows.select("date", "resyncs", text.alias("reasons"), "mean_resync_s"))


@query("o5_reasons", "SELECT 'sequence gap: step ' || (event_id % 3) AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def o5_reasons(spark, sf_dir):
    return quality.reason_counts(quality.resyncs(market.recorder_log(spark, sf_dir)))


DAILY = BASE + ", " + RESYNCS.strip().removeprefix("WITH ") + f""",
g0 AS (SELECT symbol, date, ts_ns, (ts_ns - lag(ts_ns) OVER (PARTITION BY symbol, date ORDER BY ts_ns, u)) / 1e6 AS delta_ms, best_ask_ticks - best_bid_ticks AS s FROM snapshots),
g AS (SELECT symbol, date, count(*) AS snapshots, count(*) FILTER (delta_ms > {GAP_MS}) AS gaps, coalesce(max(delta_ms) FILTER (delta_ms > {GAP_MS}), 0) AS max_gap_ms,
  CASE WHEN count(*) < 2 THEN 0 ELSE least(100, coalesce(100.0 * count(*) / (nullif((max(ts_ns) - min(ts_ns)) / 1e6, 0) / 3600000.0), 100)) END AS snapshot_completeness,
  count(*) FILTER (s < 0) AS crossed, count(*) FILTER (s = 0) AS zero, min(s) FILTER (s > 0) AS min_spread, max(s) FILTER (s > 0) AS max_spread, avg(s) FILTER (s > 0) AS avg_spread FROM g0 GROUP BY symbol, date),
i0 AS (SELECT symbol, date, CASE WHEN agg_trade_id > 0 THEN agg_trade_id END AS id, lag(agg_trade_id) OVER (PARTITION BY symbol, date ORDER BY agg_trade_id) AS prev FROM trades),
i AS (SELECT symbol, date, count(id) AS trade_ids, CASE WHEN count(id) > 0 THEN count(*) FILTER (prev > 0 AND id - prev > 1) ELSE -1 END AS gap_ranges,
  CASE WHEN count(id) = 0 THEN -1 WHEN count(id) < 2 THEN 100.0 ELSE 100.0 * count(id) / (max(id) - min(id) + 1) END AS trade_completeness FROM i0 GROUP BY symbol, date),
sp AS (SELECT symbol, date, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM (SELECT symbol, date, ts_ns FROM trades UNION ALL SELECT symbol, date, ts_ns FROM snapshots) GROUP BY ALL),
m AS (SELECT date, '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS resync_reasons FROM (SELECT date, reason, count(*) AS n FROM r GROUP BY ALL) GROUP BY date),
z AS (SELECT date, count(*) AS resyncs, coalesce(avg(live_s - at_s), 0) AS mean_resync_s FROM r GROUP BY date),
day AS (SELECT sp.symbol, sp.date, coalesce(snapshots, 0) AS snapshots, coalesce(gaps, 0) AS gaps, coalesce(max_gap_ms, 0) AS max_gap_ms, coalesce(snapshot_completeness, 0) AS snapshot_completeness, coalesce(trade_ids, 0) AS trade_ids,
  coalesce(gap_ranges, -1) AS gap_ranges, coalesce(trade_completeness, -1) AS trade_completeness, coalesce(crossed, 0) AS crossed, coalesce(zero, 0) AS zero, coalesce(min_spread, 0) AS min_spread, coalesce(max_spread, 0) AS max_spread,
  coalesce(avg_spread, 0) AS avg_spread, start_ns, end_ns, (end_ns - start_ns) / 3.6e12 AS duration_h, coalesce(resyncs, 0) AS resyncs, resync_reasons, coalesce(mean_resync_s, 0) AS mean_resync_s
  FROM sp LEFT JOIN g USING (symbol, date) LEFT JOIN i USING (symbol, date) LEFT JOIN z ON z.date = sp.date LEFT JOIN m ON m.date = sp.date),
judged AS (SELECT *, concat_ws(',', CASE WHEN crossed > 0 THEN 'crossed books' END, CASE WHEN snapshot_completeness < 95 THEN 'snapshot completeness' END, CASE WHEN trade_completeness > 0 AND trade_completeness < 99 THEN 'trade completeness' END,
  CASE WHEN resyncs > 50 THEN 'resyncs' END, CASE WHEN max_gap_ms > 60000 THEN 'long gap' END) AS issues FROM day)
SELECT * REPLACE (round(max_gap_ms, 4) AS max_gap_ms, round(snapshot_completeness, 4) AS snapshot_completeness, round(trade_completeness, 4) AS trade_completeness, round(avg_spread, 4) AS avg_spread, round(duration_h, 4) AS duration_h,
  round(mean_resync_s, 4) AS mean_resync_s), CASE WHEN issues = '' THEN 'HEALTHY' WHEN length(issues) - length(replace(issues, ',', '')) < 2 THEN 'WARNING' ELSE 'CRITICAL' END AS verdict FROM judged"""


@query("c9_daily_report", DAILY)
def c9_daily_report(spark, sf_dir):
    """The daily report, reasons as JSON and issues as one text."""
    trades, snapshots, lines = market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), market.recorder_log(spark, sf_dir)
    report = reports.daily_report(trades, snapshots, lines, interval_ms=3_600_000.0, tolerance_ms=GAP_MS - 3_600_000.0)["daily"]
    return _rounded(report.withColumns({"resync_reasons": F.to_json("resync_reasons"), "issues": F.concat_ws(",", "issues")}), 4)


# Calibration and healing


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.calibrate(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), ["symbol"], window_ns=10 * X.NS_DAY, margin_ns=12 * NS_HOUR, range_ms=6 * 3_600_000, step_ms=1_800_000, least=10, bin_ns=6 * NS_HOUR)


CURVE = BASE + """, t0 AS (SELECT symbol, min(ts_ns) AS t0, max(ts_ns) AS t1 FROM (SELECT symbol, ts_ns FROM trades UNION ALL SELECT symbol, ts_ns FROM snapshots) GROUP BY symbol),
win AS (SELECT symbol, w, t0 + w * 864000000000000 AS s FROM t0, range(10) r(w) WHERE t0 + w * 864000000000000 < t1),
wt AS (SELECT win.symbol, w, s, t.ts_ns, t.price_ticks, agg_trade_id FROM win JOIN trades t ON t.symbol = win.symbol AND t.ts_ns >= s AND t.ts_ns < s + 864000000000000),
ws AS (SELECT win.symbol, w, b.ts_ns, b.u, b.best_bid_ticks, b.best_ask_ticks FROM win JOIN snapshots b ON b.symbol = win.symbol AND b.ts_ns >= s - 43200000000000 AND b.ts_ns < s + 864000000000000 + 43200000000000),
n AS (SELECT symbol, w, s, trade_count, snapshot_count FROM (SELECT symbol, w, any_value(s) AS s, count(*) AS trade_count FROM wt GROUP BY ALL) JOIN (SELECT symbol, w, count(*) AS snapshot_count FROM ws GROUP BY ALL) USING (symbol, w) WHERE trade_count >= 10 AND snapshot_count >= 10),
o AS (SELECT (k - 12) * 1800000 AS o FROM range(25) r(k)),
tt AS (SELECT wt.symbol, wt.w, wt.price_ticks, o, wt.symbol || '/' || wt.w AS key, wt.ts_ns - o * 1000000 AS moved FROM wt JOIN n USING (symbol, w), o),
ss AS (SELECT symbol || '/' || w AS key, ts_ns, best_bid_ticks, best_ask_ticks FROM ws),
rate AS (SELECT tt.symbol, tt.w, o, sum(CASE WHEN price_ticks < best_bid_ticks OR price_ticks > best_ask_ticks THEN 1 ELSE 0 END) AS outside, count(*) AS trades FROM tt ASOF LEFT JOIN ss ON tt.key = ss.key AND tt.moved >= ss.ts_ns GROUP BY ALL),
best AS (SELECT symbol, w, CASE WHEN min(outside / trades) < 1 THEN arg_min(o, (outside / trades, o)) ELSE 0 END AS o, min(outside / trades) AS r FROM rate GROUP BY ALL),
curve AS (SELECT symbol, s AS window_start_ns, s + 864000000000000 AS window_end_ns, strftime(make_timestamp(s // 1000), '%Y-%m-%d %H:%M:%S') AS window_start_time, best.o::DOUBLE AS optimal_offset_ms, r AS outside_spread_rate, trade_count, snapshot_count FROM best JOIN n USING (symbol, w))
"""


@query("a10_calibration", CURVE + "SELECT symbol, window_start_ns, window_end_ns, window_start_time, optimal_offset_ms, round(outside_spread_rate, 9) AS outside_spread_rate, trade_count, snapshot_count FROM curve")
def a10_calibration(spark, sf_dir):
    return _rounded(_curve(spark, sf_dir), 9)


@query("a9_offset_rates", CURVE + "SELECT symbol, w AS win, o AS offset_ms, outside::BIGINT AS outside, trades FROM rate")
def a9_offset_rates(spark, sf_dir):
    own, near, _ = calibration.windows(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), 10 * X.NS_DAY, 12 * NS_HOUR, ["symbol"])
    keys = ["symbol", "win"]
    enough = own.groupBy(*keys).agg(F.count("*").alias("a")).join(near.groupBy(*keys).agg(F.count("*").alias("b")), keys).where("a >= 10 and b >= 10").select(*keys)
    return calibration.outside_rates(own.join(enough, keys), near.join(enough, keys), keys, 6 * 3_600_000, 1_800_000, 6 * NS_HOUR)


@query("a11_curve_statistics", CURVE + """, c AS (SELECT *, row_number() OVER w - 1 AS idx, abs(optimal_offset_ms - lag(optimal_offset_ms) OVER w) AS change FROM curve WINDOW w AS (PARTITION BY symbol ORDER BY window_start_ns))
SELECT symbol, count(*) AS windows, round(avg(optimal_offset_ms), 4) AS mean_offset, round(stddev_pop(optimal_offset_ms), 4) AS std_offset, min(optimal_offset_ms) AS min_offset, max(optimal_offset_ms) AS max_offset, quantile_cont(optimal_offset_ms, 0.5) AS median_offset,
  round(avg(outside_spread_rate), 4) AS mean_rate, round(min(outside_spread_rate), 4) AS min_rate, round(max(outside_spread_rate), 4) AS max_rate, CASE WHEN count(*) > 10 THEN avg(change) END AS mean_change, CASE WHEN count(*) > 10 THEN max(change) END AS max_change, CASE WHEN count(*) > 10 THEN regr_slope(optimal_offset_ms, idx) END AS trend_per_window
FROM c GROUP BY symbol""")
def a11_curve_statistics(spark, sf_dir):
    return _rounded(calibration.curve_statistics(_curve(spark, sf_dir), ["symbol"]), 4)


HEALED = CURVE + """, p AS (SELECT symbol, (window_start_ns + window_end_ns) // 2 AS c, optimal_offset_ms * 1000000 AS o, lead((window_start_ns + window_end_ns) // 2) OVER w AS c2, lead(optimal_offset_ms * 1000000) OVER w AS o2, row_number() OVER w AS k FROM curve WINDOW w AS (PARTITION BY symbol ORDER BY window_start_ns)),
healed AS (
  SELECT s.symbol, s.u, s.ts_ns AS ts_ns_original, s.best_bid_ticks, s.best_ask_ticks,
    CAST(trunc(CASE WHEN p.c IS NULL THEN coalesce((SELECT first(o ORDER BY c) FROM p q WHERE q.symbol = s.symbol), 0) WHEN p.c2 IS NULL THEN p.o ELSE p.o + (p.o2 - p.o) * (s.ts_ns - p.c) / (p.c2 - p.c) END) AS BIGINT) AS offset_applied_ns
  FROM snapshots s ASOF LEFT JOIN p ON s.symbol = p.symbol AND s.ts_ns >= p.c)
"""


@query("j7_heal", HEALED + "SELECT symbol, u, ts_ns_original, CAST(trunc(offset_applied_ns / 1000000.0) AS BIGINT) AS offset_ms FROM healed")
def j7_heal(spark, sf_dir):
    healed = calibration.heal(market.snapshots(spark, sf_dir), _curve(spark, sf_dir), ["symbol"])
    return healed.select("symbol", "u", "ts_ns_original", X.whole(F.col("offset_applied_ns"), 1_000_000).alias("offset_ms"))


@query("j11_verify_healing", HEALED + """, x AS (SELECT t.symbol, avg(CASE WHEN price_ticks < best_bid_ticks OR price_ticks > best_ask_ticks THEN 1 ELSE 0 END) AS a FROM trades t ASOF JOIN snapshots s ON t.symbol = s.symbol AND t.ts_ns >= s.ts_ns GROUP BY t.symbol),
y AS (SELECT t.symbol, avg(CASE WHEN price_ticks < best_bid_ticks OR price_ticks > best_ask_ticks THEN 1 ELSE 0 END) AS b FROM trades t ASOF JOIN (SELECT *, ts_ns_original + offset_applied_ns AS m FROM healed) s ON t.symbol = s.symbol AND t.ts_ns >= s.m GROUP BY t.symbol)
SELECT symbol, round(a, 6) AS rate_before, round(b, 6) AS rate_after, round(a - b, 6) AS improvement FROM x JOIN y USING (symbol)""")
def j11_verify_healing(spark, sf_dir):
    t, s = market.trades(spark, sf_dir), market.snapshots(spark, sf_dir)
    return _rounded(calibration.verify_healing(t, s, calibration.heal(s, _curve(spark, sf_dir), ["symbol"]), ["symbol"]))


# Files and hours

PROFILE = BASE + """, st AS (SELECT symbol, date, hour // 12 * 12 AS hour, (ts_ns - lag(ts_ns) OVER (PARTITION BY symbol, date, hour // 12 ORDER BY ts_ns)) / 1e6 AS step, ts_ns FROM trades),
prof AS (SELECT symbol, date, hour, 1 AS files, count(*) AS rows, count(*)::DOUBLE AS avg_rows, count(*) AS min_rows, count(*) AS max_rows, round((max(ts_ns) - min(ts_ns)) / 6e10, 6) AS duration_min, count(*) FILTER (step > 600000) AS gaps, round(coalesce(max(step), 0), 6) AS max_step_ms, 0 AS overlaps FROM st GROUP BY ALL)
"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.with_files(lake.read_table(spark, _lake(spark, sf_dir), "trades"))
    return layout.hour_profile(rows, ["symbol", "date", "hour"], gap_ms=600_000)


@query("a29_hour_profile", PROFILE + "SELECT * FROM prof")
def a29_hour_profile(spark, sf_dir):
    return _rounded(_profile(spark, sf_dir).drop("missing_parts", "extra_parts").withColumn("hour", F.col("hour").cast("int")))


@query("a29_parts", BASE + """, p AS (SELECT DISTINCT symbol, date, hour, agg_trade_id % 70 AS part FROM trades)
SELECT symbol, date, hour, count(*) AS files, CAST(max(part) + 1 - count(*) AS INT) AS missing_parts, count(*) FILTER (part >= 60) AS extra_parts FROM p GROUP BY ALL""")
def a29_parts(spark, sf_dir):
    """Missing and extra parts of every hour, where a trade's id tells its part."""
    part = (F.col("agg_trade_id") % 70).cast("int")
    rows = feeds.with_partitions(market.trades(spark, sf_dir)).withColumn("part", part).withColumn("file_path", part.cast("string"))
    profile = layout.hour_profile(rows.withColumn("hour", F.col("hour").cast("int")), ["symbol", "date", "hour"], gap_ms=600_000)
    return profile.select("symbol", "date", "hour", "files", "missing_parts", "extra_parts")


@query("a31_fragmentation", PROFILE + ", c AS (SELECT symbol, date, count(*) FILTER (hour = 0) AS a, count(*) FILTER (hour = 12) AS b FROM prof WHERE hour IN (0, 12) GROUP BY ALL) SELECT round(avg(a), 6) AS avg_files_a, round(avg(b), 6) AS avg_files_b, avg(a) > 5 * avg(b) AS fragmented FROM c")
def a31_fragmentation(spark, sf_dir):
    return _rounded(layout.fragmentation(layout.compare_two_hours(_profile(spark, sf_dir), ["symbol", "date"], "00", "12"), a="00", b="12"))


@query("d7_missing_hours", BASE + "SELECT symbol, date, CAST(h AS INT) AS hour FROM (SELECT DISTINCT symbol, date FROM trades), range(24) r(h) EXCEPT SELECT symbol, date, hour FROM trades")
def d7_missing_hours(spark, sf_dir):
    rows = feeds.with_partitions(market.trades(spark, sf_dir))
    return layout.missing_hours(rows, ["symbol", "date"]).withColumn("hour", F.col("hour").cast("int"))


# Books


@query("t1_latest_levels", """SELECT 'S' || (l_suppkey % 5) AS symbol, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, l_partkey % 200 AS price_ticks, arg_max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END, (l_orderkey * 10 + l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END)) AS qty_lots
FROM lineitem GROUP BY 1, 2, 3 HAVING qty_lots > 0""")
def t1_latest_levels(spark, sf_dir):
    return book.latest_levels(market.depth(spark, sf_dir))


LEVELS = "WITH v AS (" + ORACLE_SQL["t1_latest_levels"] + ")"


@query("o7_top_levels", LEVELS + " SELECT symbol, side, price_ticks, qty_lots, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price_ticks ELSE price_ticks END) AS INT) AS level FROM v QUALIFY level <= 5")
def o7_top_levels(spark, sf_dir):
    return book.top_levels(book.latest_levels(market.depth(spark, sf_dir)), 5)


@query("o8_best_levels", LEVELS + " SELECT symbol, max(price_ticks) FILTER (side = 'bid') AS best_bid_ticks, arg_max(qty_lots, price_ticks) FILTER (side = 'bid') AS best_bid_lots, min(price_ticks) FILTER (side = 'ask') AS best_ask_ticks, arg_min(qty_lots, price_ticks) FILTER (side = 'ask') AS best_ask_lots FROM v GROUP BY symbol")
def o8_best_levels(spark, sf_dir):
    return book.best_levels(book.latest_levels(market.depth(spark, sf_dir)))


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as a difference log whose pu skips the views between trades."""
    return market.trades(spark, sf_dir).select("symbol", F.col("agg_trade_id").alias("u"), (F.col("agg_trade_id") - 1 - F.col("agg_trade_id") % 4).alias("pu"))


@query("w6_sequence_audit", BASE + """, g AS (SELECT symbol, agg_trade_id AS u, agg_trade_id - 1 - agg_trade_id % 4 AS pu, coalesce(agg_trade_id - 1 - agg_trade_id % 4 <> lag(agg_trade_id) OVER (PARTITION BY symbol ORDER BY agg_trade_id), false) AS gap FROM trades)
SELECT symbol, u, pu, gap, (sum(gap::INT) OVER (PARTITION BY symbol ORDER BY u))::BIGINT AS epoch FROM g""")
def w6_sequence_audit(spark, sf_dir):
    return book.sequence_audit(_diffs(spark, sf_dir))


@query("w7_epoch_boundaries", BASE + "SELECT symbol, ts_ns, u, resync_epoch FROM (SELECT *, lag(resync_epoch) OVER (PARTITION BY symbol ORDER BY ts_ns, u) AS p FROM snapshots) WHERE resync_epoch <> p")
def w7_epoch_boundaries(spark, sf_dir):
    return features.epoch_boundaries(market.snapshots(spark, sf_dir))


def _depth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as depth events: a whole book per symbol, then one difference per line item, with a break of
    sequence every 997th and a new whole book after it."""
    d = market.depth(spark, sf_dir)
    level = F.array(F.struct(F.col("price_ticks").alias("p"), F.col("qty_lots").cast("long").alias("q")))
    none = F.lit(None).cast("array<struct<p:bigint,q:bigint>>")
    placed = asof.positions(d, ["u"], ["symbol"], X.whole(F.col("u"), 10_000))
    n = F.col("pos") + 1
    diff = F.struct((n * 2).alias("at"), F.lit("diff").alias("kind"), (n * 40).alias("E"), n.alias("first_u"), n.alias("u"), F.when(n % 997 == 0, n - 2).otherwise(n - 1).alias("pu"), F.when(F.col("side") == "bid", level).otherwise(none).alias("bids"), F.when(F.col("side") == "ask", level).otherwise(none).alias("asks"))
    whole_book = F.struct((n * 2 - 1).alias("at"), F.lit("book").alias("kind"), (n * 40).alias("E"), n.alias("first_u"), n.alias("u"), n.alias("pu"), none.alias("bids"), none.alias("asks"))
    # one pass over the numbered rows gives both
    return placed.select("symbol", F.inline(F.when((n % 997 == 1) | (n == 1), F.array(whole_book, diff)).otherwise(F.array(diff))))


@query("t1_replay")
def t1_replay(spark, sf_dir):
    """Books of depth 20 and state changes of the replayed depth log."""
    plain = ["symbol", "row", "ts_ns", "u", "best_bid_ticks", "best_ask_ticks", "resync_epoch", "state", "reason"]
    found = book.replay(_depth_events(spark, sf_dir), depth=20, span=20_000, columns=[*plain, "bids_qty_lots"])
    return found.select(*plain, F.aggregate("bids_qty_lots", F.lit(0).cast("long"), lambda a, x: a + x).alias("bid_lots"))


@query("t4_every_tick", BASE + """, g AS (SELECT symbol, unnest(range(min(ts_ns) // 3600000000000, max(ts_ns) // 3600000000000 + 1)) AS tick FROM snapshots GROUP BY symbol)
SELECT g.symbol, g.tick, s.ts_ns AS book_ns, s.u, s.best_bid_ticks FROM g ASOF JOIN snapshots s ON g.symbol = s.symbol AND (g.tick + 1) * 3600000000000 - 1 >= s.ts_ns""")
def t4_every_tick(spark, sf_dir):
    """One book an hour of every symbol, the one before repeated in quiet hours."""
    found = feeds.every_tick(market.snapshots(spark, sf_dir), ["best_bid_ticks"], NS_HOUR)
    return found.select("symbol", "tick", F.col("snap.ts_ns").alias("book_ns"), "snap.u", "snap.best_bid_ticks")


@query("t4_sample_ticks", BASE + "SELECT ts_ns // 3600000000000 AS tick, symbol, max(ts_ns) AS ts_ns, arg_max(u, (ts_ns, u)) AS u, arg_max(best_bid_ticks, (ts_ns, u)) AS best_bid_ticks FROM snapshots GROUP BY 1, 2")
def t4_sample_ticks(spark, sf_dir):
    return feeds.sample_ticks(market.snapshots(spark, sf_dir).select("symbol", "ts_ns", "u", "best_bid_ticks"), NS_HOUR).select("tick", "symbol", "ts_ns", "u", "best_bid_ticks")


# Features


@query("d1_windows", BASE + """, b AS (SELECT symbol, (ts_ns // 3600000000000 - k) * 3600000000000 AS start_ns, best_ask_ticks - best_bid_ticks AS s, (bids_qty_lots[1] - asks_qty_lots[1]) / nullif(bids_qty_lots[1] + asks_qty_lots[1], 0) AS im, resync_epoch AS e FROM snapshots, range(6) r(k)),
v AS (SELECT symbol, (ts_ns // 3600000000000 - k) * 3600000000000 AS start_ns, sum(qty_lots) FILTER (is_buyer_maker) AS bl, sum(qty_lots) FILTER (NOT is_buyer_maker) AS al FROM trades, range(6) r(k) GROUP BY 1, 2),
w AS (SELECT symbol, start_ns, count(*) AS snapshots, round(avg(s), 6) AS avg_spread, round(avg(im), 6) AS imbalance, min(e) AS min_epoch, max(e) AS max_epoch FROM b GROUP BY 1, 2)
SELECT symbol, start_ns, snapshots, avg_spread, imbalance, min_epoch, max_epoch, coalesce(bl, 0)::BIGINT AS bid_lots, coalesce(al, 0)::BIGINT AS ask_lots, min_epoch <> max_epoch AS crosses_epoch FROM w LEFT JOIN v USING (symbol, start_ns)""")
def d1_windows(spark, sf_dir):
    return _rounded(features.sliding_windows(market.snapshots(spark, sf_dir), market.trades(spark, sf_dir), 6 * NS_HOUR, NS_HOUR))


@query("d3_price_move", BASE + """, e AS (SELECT symbol, max(ts_ns) AS t1 FROM snapshots GROUP BY symbol), a AS (SELECT symbol, ts_ns AS own, u, best_bid_ticks AS now, ts_ns + 14400000000000 AS ts_ns FROM snapshots),
m AS (SELECT a.symbol, own, a.u, CASE WHEN a.ts_ns <= t1 THEN s.best_bid_ticks - now END AS mv FROM a ASOF LEFT JOIN snapshots s ON a.symbol = s.symbol AND a.ts_ns >= s.ts_ns JOIN e ON e.symbol = a.symbol)
SELECT symbol, own AS ts_ns, u, mv AS move_ticks, CASE WHEN mv IS NOT NULL THEN greatest(-10, least(10, mv)) END AS target FROM m""")
def d3_price_move(spark, sf_dir):
    rows = features.price_move(market.snapshots(spark, sf_dir), 4 * NS_HOUR)
    return rows.withColumn("target", F.when(F.col("move_ticks").isNotNull(), F.col("target")))


@query("d4_split", BASE + """, z AS (SELECT min(ts_ns) AS t0, max(ts_ns) AS t1 FROM snapshots), c AS (SELECT t0 + CAST(trunc((t1 - t0) * 0.5) AS BIGINT) AS a, t0 + CAST(trunc((t1 - t0) * 0.75) AS BIGINT) AS b FROM z)
SELECT u, symbol, CASE WHEN ts_ns < a THEN 'train' WHEN ts_ns >= a + 21600000000000 AND ts_ns < b THEN 'validation' WHEN ts_ns >= b + 21600000000000 THEN 'test' END AS split, CASE WHEN date >= '2024-01-15' THEN 'post_fix' ELSE 'pre_fix' END AS data_epoch FROM snapshots, c
WHERE ts_ns < a OR (ts_ns >= a + 21600000000000 AND ts_ns < b) OR ts_ns >= b + 21600000000000""")
def d4_split(spark, sf_dir):
    rows = features.chronological_split(market.snapshots(spark, sf_dir), 0.5, 0.25, 6 * NS_HOUR)
    return features.data_epoch(rows, "2024-01-15").select("u", "symbol", "split", "data_epoch")


@query("d6_price_impact", MATCHED + """, w AS (SELECT symbol, agg_trade_id, qty_lots, CASE WHEN is_buyer_maker THEN best_bid_ticks ELSE best_ask_ticks END AS best,
  (SELECT sum(greatest(0, least(x, qty_lots - before)) * (i - 1)) FROM (SELECT x, i, coalesce(sum(x) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT unnest(q) AS x, generate_subscripts(q, 1) AS i))) AS paid, list_sum(q) AS total FROM matched WHERE snap_u IS NOT NULL)
SELECT symbol, agg_trade_id, CASE WHEN total >= qty_lots THEN round(paid / qty_lots / best * 10000, 6) END AS impact_bps FROM w""")
def d6_price_impact(spark, sf_dir):
    t = market.trades(spark, sf_dir).select("symbol", "ts_ns", "agg_trade_id", "qty_lots", "is_buyer_maker")
    found = asof.asof_backward(t, market.snapshots(spark, sf_dir), ["best_bid_ticks", "best_ask_ticks"]).where("snap is not null")
    books = market.snapshots(spark, sf_dir).select("symbol", F.col("u").alias("snap_u"), "bids_qty_lots", "asks_qty_lots", "bids_price_delta", "asks_price_delta")
    rows = found.withColumn("snap_u", F.col("snap.u")).join(books, ["symbol", "snap_u"])
    maker = F.col("is_buyer_maker")
    rows = rows.select("symbol", "agg_trade_id", "qty_lots", X.side_levels(maker, F.col("bids_qty_lots"), F.col("asks_qty_lots")).alias("q"), X.side_levels(maker, F.col("bids_price_delta"), F.col("asks_price_delta")).alias("d"), X.side_levels(maker, F.col("snap.best_bid_ticks"), F.col("snap.best_ask_ticks")).alias("best"))
    return _rounded(rows.select("symbol", "agg_trade_id", penetration.price_impact_bps("qty_lots", "q", "d", "best").alias("impact_bps")))


# Live intervals, prices and samples


@query("j9_only_live", BASE + """, e AS (SELECT symbol, ts_ns, CASE WHEN u % 3 = 0 THEN 'LIVE' ELSE 'BUFFERING' END AS state, lead(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, u) AS to_ns FROM snapshots)
SELECT t.symbol, t.agg_trade_id FROM trades t WHERE EXISTS (SELECT 1 FROM e WHERE e.symbol = t.symbol AND state = 'LIVE' AND t.ts_ns >= e.ts_ns AND (to_ns IS NULL OR t.ts_ns < to_ns))""")
def j9_only_live(spark, sf_dir):
    sync = market.snapshots(spark, sf_dir).select("symbol", "ts_ns", F.lit(0).alias("resync_epoch"), F.when(F.col("u") % 3 == 0, "LIVE").otherwise("BUFFERING").alias("state"))
    return feeds.only_live(market.trades(spark, sf_dir), feeds.live_intervals(sync)).select("symbol", "agg_trade_id")


@query("f6_large_deviations", SPREADS + "SELECT symbol, agg_trade_id, deviation FROM spread WHERE w = 1 AND abs(deviation) > 2")
def f6_large_deviations(spark, sf_dir):
    return mismatch.large(mismatch.match_spread(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir)), 2).select("symbol", "agg_trade_id", "deviation")


@query("f10_sample", BASE + "SELECT ts_ns, symbol, price_ticks, qty_lots, is_buyer_maker, agg_trade_id, agg_trade_id AS first_trade_id, agg_trade_id AS last_trade_id FROM trades ORDER BY substring(md5(concat_ws('|', symbol, ts_ns::VARCHAR, agg_trade_id::VARCHAR, '42')), 1, 15), symbol, ts_ns, agg_trade_id LIMIT 500")
def f10_sample(spark, sf_dir):
    return mismatch.sample(market.trades(spark, sf_dir), 500)


@query("a8_outside_share", BASE + "SELECT t.symbol, round(avg(CASE WHEN price_ticks < best_bid_ticks OR price_ticks > best_ask_ticks THEN 1 ELSE 0 END), 6) AS outside_share FROM trades t ASOF JOIN snapshots s ON t.symbol = s.symbol AND t.ts_ns >= s.ts_ns GROUP BY t.symbol")
def a8_outside_share(spark, sf_dir):
    return _rounded(calibration.outside_share(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), ["symbol"], "outside_share"))


@query("a16_daily_ids", BASE + """, d AS (SELECT symbol, date, agg_trade_id AS id, lag(agg_trade_id) OVER (PARTITION BY symbol, date ORDER BY agg_trade_id) AS prev FROM trades WHERE agg_trade_id > 0)
SELECT symbol, date, count(*) AS ids, count(*) FILTER (id - prev > 1) AS gap_ranges, CASE WHEN count(*) < 2 THEN 100.0 ELSE 100.0 * count(*) / (max(id) - min(id) + 1) END AS completeness FROM d GROUP BY symbol, date""")
def a16_daily_ids(spark, sf_dir):
    report = quality.id_report(_dated(market.trades(spark, sf_dir)).where("agg_trade_id > 0"), ["symbol", "date"])
    return report.select("symbol", "date", "ids", "gap_ranges", "completeness")


@query("w1_time_steps", STEPS + "SELECT symbol, ts_ns, prev_ts_ns, delta_ms FROM timed")
def w1_time_steps(spark, sf_dir):
    return quality.time_gaps(market.snapshots(spark, sf_dir), ["symbol"])


@query("a33_healing_totals", HEALED + "SELECT count(*) AS snapshots, count(DISTINCT symbol) AS groups, count(*) FILTER (offset_applied_ns <> 0) AS moved FROM healed")
def a33_healing_totals(spark, sf_dir):
    tables = reports.healing_report(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), _curve(spark, sf_dir), ("symbol",))
    return tables["totals"].drop("mean_improvement")


@query("c7_validation", BASE + "SELECT symbol, date, count(*) FILTER (best_ask_ticks < best_bid_ticks) AS crossed, count(*) FILTER (best_ask_ticks = best_bid_ticks) AS zero FROM snapshots GROUP BY ALL")
def c7_validation(spark, sf_dir):
    return reports.validation_report(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir))["spreads"].select("symbol", "date", "crossed", "zero")


def _validation(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the job; ids that leave 5 modulo 17 are absent from its reference trades."""
    trades = market.trades(spark, sf_dir)
    return reports.validation_report(trades, market.snapshots(spark, sf_dir), trades.where("agg_trade_id % 17 <> 5"), 3_600_000.0, GAP_MS - 3_600_000.0)[table]


DAY_STEPS = BASE + """,
steps AS (SELECT symbol, date, ts_ns, u, lag(ts_ns) OVER (PARTITION BY symbol, date ORDER BY ts_ns, u) AS prev_ts_ns FROM snapshots),
timed AS (SELECT *, (ts_ns - prev_ts_ns) / 1e6 AS delta_ms FROM steps)
"""


@query("c7_gaps", DAY_STEPS + f"""SELECT symbol, date, count(*) AS snapshots, count(*) FILTER (delta_ms > {GAP_MS}) AS gaps, round(coalesce(max(delta_ms) FILTER (delta_ms > {GAP_MS}), 0), 4) AS max_gap_ms,
  round(coalesce(sum(delta_ms) FILTER (delta_ms > {GAP_MS}), 0) / 1000, 4) AS total_gap_s FROM timed GROUP BY symbol, date""")
def c7_gaps(spark, sf_dir):
    return _rounded(_validation(spark, sf_dir, "gaps").select("symbol", "date", "snapshots", "gaps", "max_gap_ms", "total_gap_s"), 4)


@query("c7_largest_gaps", DAY_STEPS + f"SELECT symbol, date, prev_ts_ns AS start_ns, ts_ns AS end_ns, delta_ms FROM timed WHERE delta_ms > {GAP_MS} ORDER BY delta_ms DESC, symbol, date, ts_ns LIMIT 10")
def c7_largest_gaps(spark, sf_dir):
    return _validation(spark, sf_dir, "largest_gaps")


@query("c7_ids", BASE + """, d AS (SELECT symbol, date, agg_trade_id AS id, lag(agg_trade_id) OVER (PARTITION BY symbol, date ORDER BY agg_trade_id) AS prev FROM trades WHERE agg_trade_id > 0)
SELECT symbol, date, count(*) AS ids, count(DISTINCT id) AS unique_ids, count(*) - count(DISTINCT id) AS duplicates, min(id) AS first_id, max(id) AS last_id, max(id) - min(id) + 1 - count(DISTINCT id) AS missing_ids,
  count(*) FILTER (id - prev > 1) AS gap_ranges FROM d GROUP BY symbol, date""")
def c7_ids(spark, sf_dir):
    found = _validation(spark, sf_dir, "ids").where("ids > 0")
    return found.select("symbol", "date", "ids", "unique_ids", "duplicates", "first_id", "last_id", "missing_ids", "gap_ranges")


@query("c7_crossed", BASE + "SELECT symbol, date, ts_ns, u, best_bid_ticks, best_ask_ticks FROM snapshots WHERE best_ask_ticks < best_bid_ticks ORDER BY ts_ns, u LIMIT 10")
def c7_crossed(spark, sf_dir):
    return _validation(spark, sf_dir, "crossed")


@query("c7_reference", BASE + """, b AS (SELECT symbol, date, agg_trade_id FROM trades WHERE agg_trade_id > 0 AND agg_trade_id % 17 <> 5), a AS (SELECT symbol, date, agg_trade_id FROM trades WHERE agg_trade_id > 0)
SELECT symbol, date, count(DISTINCT a.agg_trade_id) AS local_ids, count(DISTINCT b.agg_trade_id) AS reference_ids, 0::BIGINT AS missing_here, count(DISTINCT a.agg_trade_id) - count(DISTINCT b.agg_trade_id) AS extra_here, 100.0::DOUBLE AS completeness
FROM a LEFT JOIN b USING (symbol, date, agg_trade_id) GROUP BY symbol, date""")
def c7_reference(spark, sf_dir):
    return _rounded(_validation(spark, sf_dir, "reference"))


@query("c1_skipped", MATCHED + "SELECT count(*) AS trades, count(snap_u) AS matched, count(*) - count(snap_u) AS skipped FROM matched")
def c1_skipped(spark, sf_dir):
    return reports.penetration_report(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), MAX_LEVEL)["unmatched"]


@query("c3_size_percentiles", BASE + "SELECT quantile_cont(qty_lots, 0.5) AS p50, quantile_cont(qty_lots, 0.9) AS p90, round(quantile_cont(qty_lots, 0.99), 6) AS p99, round(quantile_cont(qty_lots, 0.999), 6) AS p99_9, max(qty_lots) AS max FROM trades")
def c3_size_percentiles(spark, sf_dir):
    return _rounded(reports.size_report(market.trades(spark, sf_dir))["percentiles"])


# Whole jobs

FINE = CURVE.replace("864000000000000", str(2 * X.NS_DAY)).replace("range(10)", "range(400)")


@query("c4_calibration_statistics", FINE + """, c AS (SELECT *, row_number() OVER w - 1 AS idx, abs(optimal_offset_ms - lag(optimal_offset_ms) OVER w) AS change FROM curve WINDOW w AS (PARTITION BY symbol ORDER BY window_start_ns))
SELECT symbol, count(*) AS windows, round(avg(optimal_offset_ms), 4) AS mean_offset, CASE WHEN count(*) > 10 THEN round(avg(change), 4) END AS mean_change, CASE WHEN count(*) > 10 THEN max(change) END AS max_change,
  CASE WHEN count(*) > 10 THEN round(regr_slope(optimal_offset_ms, idx), 4) END AS trend_per_window FROM c GROUP BY symbol""")
def c4_calibration_statistics(spark, sf_dir):
    """Changes and trend of curves with two-day windows, of which there are more than ten."""
    options = {"window_ns": 2 * X.NS_DAY, "margin_ns": 12 * NS_HOUR, "range_ms": 6 * 3_600_000, "step_ms": 1_800_000, "least": 10, "bin_ns": 6 * NS_HOUR}
    tables = reports.calibration_report(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), ("symbol",), **options)
    return _rounded(tables["statistics"].select("symbol", "windows", "mean_offset", "mean_change", "max_change", "trend_per_window"), 4)


@query("c5_mean_improvement", ORACLE_SQL["j11_verify_healing"].replace("SELECT symbol, round(a, 6) AS rate_before, round(b, 6) AS rate_after, round(a - b, 6) AS improvement", "SELECT round(avg(a - b), 6) AS mean_improvement"))
def c5_mean_improvement(spark, sf_dir):
    tables = reports.healing_report(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), _curve(spark, sf_dir), ("symbol",))
    return _rounded(tables["totals"].select("mean_improvement"))


@query("c6_mismatch_report", SPREADS + f"SELECT {STATS} FROM spread WHERE w = 1")
def c6_mismatch_report(spark, sf_dir):
    return _rounded(reports.mismatch_report(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir))["report"])


@query("c7_first_id_gaps", BASE + """, d AS (SELECT symbol, date, agg_trade_id AS id, lag(agg_trade_id) OVER (PARTITION BY symbol, date ORDER BY agg_trade_id) AS prev FROM trades WHERE agg_trade_id > 0)
SELECT symbol, date, prev + 1 AS start FROM d WHERE id - prev > 1 ORDER BY start, symbol, date LIMIT 10""")
def c7_first_id_gaps(spark, sf_dir):
    tables = reports.validation_report(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir))
    return tables["first_id_gaps"].select("symbol", "date", "start")


@query("c10_trade_hours", PROFILE.replace("step > 600000", "step > 1000") + "SELECT * FROM prof")
def c10_trade_hours(spark, sf_dir):
    trades, snapshots = (layout.with_files(lake.read_table(spark, _lake(spark, sf_dir), kind)) for kind in ("trades", "snapshots"))
    found = reports.hour_report(snapshots, trades)["trade_hours"]
    return _rounded(found.drop("missing_parts", "extra_parts").withColumn("hour", F.col("hour").cast("int")))


@query("c8_source_overall", ORACLE_SQL["a28_overall"])
def c8_source_overall(spark, sf_dir):
    tables = reports.source_report(market.trades(spark, sf_dir), market.snapshots(spark, sf_dir), _asked_dates(spark), ["S0", "S1", "S2", "S3", "S4"], 500, 550)
    return _rounded(tables["overall"], 4)
