"""Live feeds: decoding, rolling table writers, event-time sampling, live matching and monitors."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from tidebook import schemas
from tidebook.functions import expressions as X
from tidebook.operators.asof import asof_backward
from tidebook.streaming.book import scaled_levels


@contextmanager
def exact_names(spark: SparkSession) -> Iterator[None]:
    """Column names keep their case (u and U differ) while a plan is built here; the session is left as it was."""
    name = "spark.sql.caseSensitive"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def decode(lines: DataFrame, schema: str, metrics: str | None = None) -> DataFrame:
    """``event`` parsed from JSON ``value``; lines that are no JSON objects are left out (undecodable keeps them).
    Works on batches and streams. With ``metrics`` the query observes, under that name, how many ``lines`` came and how
    many were ``bad``: a stream reports it with every trigger (FeedCounts, feed_counts)."""
    with exact_names(lines.sparkSession):
        parsed = _parsed(lines, schema)
        if metrics:
            parsed = parsed.observe(metrics, F.count("*").alias("lines"), F.count_if(~F.col("good")).alias("bad"))
        return parsed.where("good").select("event")


def feed_counts(progress, name: str) -> tuple[int, int] | None:
    """(lines, bad) of one trigger's progress, or None where nothing was observed under ``name``."""
    found = progress.observedMetrics.get(name)
    return None if found is None else (found["lines"], found["bad"])


class FeedCounts(StreamingQueryListener):
    """Listener that adds up lines and bad lines of a feed over all triggers, and warns where a trigger has bad ones.
    Register it with spark.streams.addListener."""

    def __init__(self, name: str, warn=None):
        self.name, self.warn, self.lines, self.bad = name, warn, 0, 0
        self.triggers: list[tuple[int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = feed_counts(event.progress, self.name)
        if found:
            self.lines, self.bad = self.lines + found[0], self.bad + found[1]
            self.triggers.append((event.progress.batchId, *found))
            if self.warn and found[1]:
                self.warn(f"{self.name}: {found[1]} of {found[0]} lines could not be decoded")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    event = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    an_object = F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    return lines.select(event.alias("event"), "value").withColumn("good", F.coalesce(F.col("event").isNotNull() & an_object, F.lit(False)))


def undecodable(lines: DataFrame, schema: str) -> DataFrame:
    """The lines (value) that decode leaves out; null lines count too."""
    with exact_names(lines.sparkSession):
        return _parsed(lines, schema).where("not good").select("value")


def trade_rows(events: DataFrame, scale: schemas.Scale = schemas.Scale(), symbol: str | None = None) -> DataFrame:
    """Trade rows of parsed TRADE_EVENT structs: trade time in ns, ticks and lots; absent ids are 0 and an absent
    flag is false. Works on batches and streams."""
    e = "event."
    columns = (
        X.ms_to_ns(F.coalesce(F.col(e + "T"), F.lit(0))).alias("ts_ns"), F.lit(symbol).alias("symbol") if symbol else F.col(e + "s").alias("symbol"), X.price_to_ticks(F.coalesce(F.col(e + "p").cast("double"), F.lit(0.0)), scale).alias("price_ticks"),
        X.qty_to_lots(F.coalesce(F.col(e + "q").cast("double"), F.lit(0.0)), scale).alias("qty_lots"), F.coalesce(F.col(e + "m"), F.lit(False)).alias("is_buyer_maker"),
        F.coalesce(F.col(e + "a"), F.lit(0)).alias("agg_trade_id"), F.coalesce(F.col(e + "f"), F.lit(0)).alias("first_trade_id"), F.coalesce(F.col(e + "l"), F.lit(0)).alias("last_trade_id"),
    )
    with exact_names(events.sparkSession):
        return events.select(*columns)


def depth_rows(events: DataFrame, scale: schemas.Scale = schemas.Scale()) -> DataFrame:
    """Replay events of parsed DEPTH_EVENT structs, arriving at their event time."""
    e = "event."
    none = F.lit(0).cast("long")
    columns = (
        F.col(e + "s").alias("symbol"), F.col(e + "E").alias("at"), F.lit("diff").alias("kind"), F.coalesce(e + "E", none).alias("E"), F.coalesce(e + "U", none).alias("first_u"), F.coalesce(e + "u", none).alias("u"), F.coalesce(e + "pu", none).alias("pu"),
        F.coalesce(scaled_levels(F.col(e + "b"), scale), F.array()).alias("bids"), F.coalesce(scaled_levels(F.col(e + "a"), scale), F.array()).alias("asks"),
    )
    with exact_names(events.sparkSession):
        return events.select(*columns)


def book_rows(events: DataFrame, symbol: str, at: str = "at", scale: schemas.Scale = schemas.Scale()) -> DataFrame:
    """Replay events of parsed BOOK_EVENT structs, whole books of ``symbol``. The messages carry no time: column ``at``
    says in milliseconds when each came. Absent ids are 0 and absent sides are empty. Works on batches and streams."""
    side = lambda c: F.coalesce(scaled_levels(F.col(f"event.{c}"), scale), F.array())
    u, none = F.coalesce("event.lastUpdateId", F.lit(0).cast("long")), F.lit(0).cast("long")
    with exact_names(events.sparkSession):
        return events.select(
            F.lit(symbol).alias("symbol"), F.col(at).cast("long").alias("at"), F.lit("book").alias("kind"), F.col(at).cast("long").alias("E"), u.alias("first_u"), u.alias("u"), none.alias("pu"), side("bids").alias("bids"), side("asks").alias("asks")
        )


def with_partitions(rows: DataFrame) -> DataFrame:
    """``rows`` with the UTC partition columns date and hour of ts_ns."""
    return rows.withColumn("date", X.date_of(F.col("ts_ns"))).withColumn("hour", X.part_hour(F.col("ts_ns")))


def write_lake(rows: DataFrame, path: str) -> None:
    """Append a batch to the lake as zstd Parquet by symbol, date and hour."""
    with_partitions(rows).repartition("symbol", "date", "hour").write.mode("append").partitionBy("symbol", "date", "hour").option("compression", "zstd").parquet(path)


def record(rows: DataFrame, path: str, checkpoint: str, interval: str = "60 seconds"):
    """Start a streaming query that appends to the lake once per ``interval``, exactly once per row."""
    out = with_partitions(rows).writeStream.format("parquet").option("compression", "zstd").option("path", path).option("checkpointLocation", checkpoint)
    return out.partitionBy("symbol", "date", "hour").outputMode("append").trigger(processingTime=interval).start()


def sample_ticks(books: DataFrame, tick_ns: int = 100_000_000) -> DataFrame:
    """The last row of each symbol and tick, by (ts_ns, u), with ``tick``. Works on batches; on streams give rows
    that have an event-time watermark."""
    tick = X.whole(F.col("ts_ns"), tick_ns)
    return books.withColumn("tick", tick).groupBy("symbol", "tick").agg(F.max_by(F.struct(*books.columns), F.struct("ts_ns", "u")).alias("r")).select("tick", "r.*")


def every_tick(books: DataFrame, columns: list[str], tick_ns: int = 100_000_000) -> DataFrame:
    """(symbol, tick, ts_ns, snap): for every tick from a symbol's first book to its last, the last book (a struct of
    ts_ns, u and ``columns``) at or before the tick's end, which is ts_ns; a quiet tick repeats the book before it.
    only_live leaves out the ticks while a book was not LIVE. Works on batches."""
    hour = max(1, X.NS_HOUR // tick_ns) * tick_ns
    spans = books.groupBy("symbol").agg(F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
    hours = spans.withColumn("h", F.explode(F.sequence(X.whole(F.col("t0"), hour), X.whole(F.col("t1"), hour))))
    first, last = F.greatest(F.col("h") * hour, F.col("t0")), F.least((F.col("h") + 1) * hour - 1, F.col("t1"))
    ticks = hours.select("symbol", F.explode(F.sequence(X.whole(first, tick_ns), X.whole(last, tick_ns))).alias("tick"))
    return asof_backward(ticks.withColumn("ts_ns", (F.col("tick") + 1) * tick_ns - 1), books, columns)


_MATCHED = (
    "kind string, symbol string, trade_ns long, agg_trade_id long, price_ticks long, snap_ns long, snap_u long, "
    "best_bid_ticks long, best_ask_ticks long"
)
_MATCHED_COLUMNS = [c.split()[0] for c in _MATCHED.split(", ")]


class _AsOf(StatefulProcessor):
    """Of a symbol the snapshots that a trade can still meet, in order, and the trades that still wait."""

    def __init__(self, max_age_ns: int | None):
        self.max_age_ns = max_age_ns

    def init(self, handle) -> None:
        self.handle = handle
        self.snaps = handle.getListState("snaps", "ts_ns long, u long, bid long, ask long")
        self.trades = handle.getListState("trades", "ts_ns long, id long, price long")

    def _settled(self, symbol: str, snaps: list[tuple], trades: list[tuple], water_ns: int) -> list[tuple]:
        """Rows of the trades before the watermark; what is left goes back to the state."""
        snaps, trades = sorted(snaps), sorted(trades)
        out, at = [], -1
        done = bisect_left(trades, (water_ns,))
        for ts, number, price in trades[:done]:
            while at + 1 < len(snaps) and snaps[at + 1][0] <= ts:
                at += 1
            fits = at >= 0 and (self.max_age_ns is None or ts - snaps[at][0] <= self.max_age_ns)
            out.append(("match", symbol, ts, number, price, *(snaps[at] if fits else (None,) * 4)))
        first = max(0, bisect_left(snaps, (water_ns,)) - 1)
        for state, rows in ((self.snaps, snaps[first:]), (self.trades, trades[done:])):
            state.clear()
            if rows:
                state.put(rows)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if done < len(trades):
            self.handle.registerTimer(trades[done][0] // 1_000_000 + 1)
        return out

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_MATCHED_COLUMNS, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        water = timerValues.getCurrentWatermarkInMs() * 1_000_000
        snaps, trades, late = list(self.snaps.get()), list(self.trades.get()), []
        for r in pd.concat(list(rows)).itertuples():
            ts = int(r.ts_ns)
            if r.is_trade:
                one = (ts, int(r.number), int(r.price_ticks))
                late.append(("late_trade", key[0], *one, None, None, None, None)) if ts < water else trades.append(one)
            elif ts < water:
                late.append(("late_snapshot", key[0], None, None, None, ts, int(r.number), int(r.best_bid_ticks), int(r.best_ask_ticks)))
            else:
                snaps.append((ts, int(r.number), int(r.best_bid_ticks), int(r.best_ask_ticks)))
        yield self._frame(late + self._settled(key[0], snaps, trades, water))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._settled(key[0], list(self.snaps.get()), list(self.trades.get()), timerValues.getCurrentWatermarkInMs() * 1_000_000))

    def close(self) -> None:
        pass


def live_asof(trades: DataFrame, snapshots: DataFrame, late: str = "10 seconds", max_age_ns: int | None = None) -> DataFrame:
    """Streams joined as of: one row (kind = match) per trade once the watermark, ``late`` behind the newest row, has
    passed it, with the last snapshot at or before it (of one time the one with the largest u), nulls if there is none or it
    is older than ``max_age_ns``. Rows behind the watermark come out as late_trade or late_snapshot and change nothing.

    The state of a symbol is what arrived within ``late``, and one snapshot before it. Trades without a time or symbol,
    and snapshots without one, are left out; absent numbers count as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    t = trades.select("symbol", "ts_ns", F.lit(True).alias("is_trade"), n("agg_trade_id").alias("number"), n("price_ticks").alias("price_ticks"), zero.alias("best_bid_ticks"), zero.alias("best_ask_ticks"))
    s = snapshots.select("symbol", "ts_ns", F.lit(False).alias("is_trade"), n("u").alias("number"), zero.alias("price_ticks"), n("best_bid_ticks").alias("best_bid_ticks"), n("best_ask_ticks").alias("best_ask_ticks"))
    both = t.unionByName(s).where("symbol is not null and ts_ns is not null").withColumn("time", X.ns_to_timestamp(F.col("ts_ns"))).withWatermark("time", late).drop("time")
    return both.groupBy("symbol").transformWithStateInPandas(_AsOf(max_age_ns), _MATCHED, "append", "EventTime")


class _Monitor(StatefulProcessor):
    def __init__(self, limit_ns: int):
        self.limit_ns = limit_ns

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "ts_ns long, u long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        ts, u = self.last.get() if self.last.exists() else (None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_ns", "u"], kind="stable").itertuples():
            if ts is not None and r.ts_ns - ts > self.limit_ns:
                out.append((key[0], "time", int(ts), int(r.ts_ns)))
            if u is not None and r.pu != u:
                out.append((key[0], "sequence", int(u), int(r.pu)))
            ts, u = int(r.ts_ns), int(r.u)
        self.last.update((ts, u))
        yield pd.DataFrame(out, columns=["symbol", "kind", "before", "after"])

    def close(self) -> None:
        pass


def monitor(rows: DataFrame, limit_ms: float = 150) -> DataFrame:
    """Alerts of a stream (symbol, ts_ns, u, pu): steps longer than ``limit_ms``, and breaks where pu is not the u
    before. The last row of each symbol is kept in the state store."""
    return rows.select("symbol", "ts_ns", "u", "pu").groupBy("symbol").transformWithStateInPandas(_Monitor(int(limit_ms * 1e6)), "symbol string, kind string, before long, after long", "append", "None")


def live_intervals(sync: DataFrame) -> DataFrame:
    """(symbol, from_ns, to_ns) of the LIVE stretches in replay's sync rows; an open one has a null end. A symbol has
    as many rows as it changed state."""
    order = Window.partitionBy("symbol").orderBy("ts_ns", "resync_epoch", F.when(F.col("state") == "LIVE", 1).otherwise(0))
    rows = sync.withColumn("to_ns", F.lead("ts_ns").over(order))
    return rows.where("state = 'LIVE'").select("symbol", F.col("ts_ns").alias("from_ns"), "to_ns")


def only_live(trades: DataFrame, intervals: DataFrame) -> DataFrame:
    """Trades inside a LIVE interval of their symbol: those whose last interval to begin has not ended. Intervals of a
    symbol do not overlap."""
    starts = intervals.select("symbol", F.col("from_ns").alias("ts_ns"), F.coalesce("to_ns", F.lit((1 << 63) - 1)).alias("u"))
    found = asof_backward(trades, starts, [])
    return found.where("ts_ns < snap.u").drop("snap")
