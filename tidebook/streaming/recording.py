"""The recording job: whole books, differences and trades of any number of symbols in, sampled books and trades out.

One stateful processor per symbol takes all three in order of arrival. Trades pass while the book is LIVE. While it is LIVE, every tick
has a book: an event of a later tick, or a timer once the watermark has passed the tick's end, sends the last book
for each tick in between. Rows older than the watermark are left out and come out as rows of their own.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidebook.streaming.feeds import record
from tidebook.streaming.machine import BUFFER, EVENTS, OUTPUT, Replay

TRADE = "ts_ns long, price_ticks long, qty_lots long, is_buyer_maker boolean, agg_trade_id long, first_trade_id long, last_trade_id long"
INPUT = f"{EVENTS}, trade struct<{TRADE}>"
_TRADE_COLUMNS = [c.split()[0] for c in TRADE.split(", ")]
_OWN = "tick long, " + ", ".join(c for c in TRADE.split(", ") if not c.startswith("ts_ns"))
RECORDED = f"{OUTPUT}, {_OWN}"
_COLUMNS = [c.split()[0] for c in RECORDED.split(", ")]
SNAPSHOT_COLUMNS = ["ts_ns", "symbol", "u", "best_bid_ticks", "best_ask_ticks", "bids_price_delta", "bids_qty_lots", "asks_price_delta", "asks_qty_lots", "resync_epoch"]


class Sampler(Replay):
    """A book that tells its view for every tick whose end it sees while it is LIVE. ``sent`` is the last tick told."""

    sent: int | None = None

    def tick_of(self, ms: int) -> int:
        return ms * 1_000_000 // self.tick_ns

    def until(self, tick: int) -> Iterator[tuple]:
        """Views of the ticks after the last one told and before ``tick``."""
        if self.state == "LIVE" and self.sent is not None:
            while self.sent < tick - 1:
                self.sent += 1
                yield (*self.view(), self.sent)

    def flush(self) -> Iterator[tuple]:
        self.touched = False
        return iter(())

    def step(self, event: tuple) -> Iterator[tuple]:
        was = self.state
        if event[0] != "book":
            yield from self.until(self.tick_of(event[1]))
        yield from super().step(event)
        if self.state != "LIVE":
            self.sent = None
        elif was != "LIVE" or self.sent is None:
            self.sent = self.ts_ns // self.tick_ns - 1

    def next_end(self) -> int | None:
        """When the tick after the last one told has ended, in ms."""
        return None if self.sent is None else -(-(self.sent + 2) * self.tick_ns // 1_000_000)


def trade_events(trades: DataFrame) -> DataFrame:
    """Rows of INPUT of trade rows (feeds.trade_rows). Works on batches and streams."""
    ms = F.expr("ts_ns div 1000000")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("array<struct<p:bigint,q:bigint>>")
    return trades.select(
        "symbol", ms.alias("at"), F.lit("trade").alias("kind"), ms.alias("E"), zero.alias("first_u"), zero.alias("u"), zero.alias("pu"),
        none.alias("bids"), none.alias("asks"), F.struct(*_TRADE_COLUMNS).alias("trade"),
    )


def merged(books: DataFrame, differences: DataFrame, trades: DataFrame) -> DataFrame:
    """One stream of INPUT from feeds.book_rows, feeds.depth_rows and feeds.trade_rows."""
    no_trade = F.lit(None).cast(f"struct<{TRADE}>")
    return books.unionByName(differences).withColumn("trade", no_trade).unionByName(trade_events(trades))


class _Recorder(StatefulProcessor):
    def __init__(self, depth: int, tick_ns: int):
        self.depth, self.tick_ns = depth, tick_ns

    def init(self, handle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "side string, p long", "q long")
        self.scalars = handle.getValueState("sync", "state string, prev_u long, book_id long, epoch int, ts_ns long, sent long")
        self.waiting = handle.getListState("buffer", "event string")

    def _restored(self, symbol: str) -> Sampler:
        r = Sampler(symbol, self.depth, self.tick_ns)
        if self.scalars.exists():
            r.state, r.prev_u, r.book_id, r.epoch, r.ts_ns, sent = self.scalars.get()
            r.sent = None if sent is None or sent < 0 else int(sent)
        for (side, p), (q,) in self.levels.iterator():
            (r.bids if side == "b" else r.asks)[p] = q
        r.buffer = deque((tuple(json.loads(e)) for (e,) in self.waiting.get()), BUFFER)
        return r

    def _kept(self, r: Sampler, before: dict) -> None:
        after = self._sides(r)
        for k in before.keys() - after.keys():
            self.levels.removeKey(k)
        for k, q in after.items():
            if before.get(k) != q:
                self.levels.updateValue(k, (q,))
        self.scalars.update((r.state, r.prev_u, r.book_id, r.epoch, r.ts_ns, -1 if r.sent is None else r.sent))
        self.waiting.clear()
        if r.buffer:
            self.waiting.put([(json.dumps(e),) for e in r.buffer])

    def _timer(self, r: Sampler) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (at := r.next_end()) is not None:
            self.handle.registerTimer(at)

    @staticmethod
    def _sides(r: Replay) -> dict:
        return {("b", p): q for p, q in r.bids.items()} | {("a", p): q for p, q in r.asks.items()}

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([r + (None,) * (len(_COLUMNS) - len(r)) for r in rows], columns=_COLUMNS, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        r, water = self._restored(key[0]), timerValues.getCurrentWatermarkInMs()
        before = self._sides(r)
        out: list[tuple] = []
        table = pd.concat(list(rows))
        table = table.assign(is_trade=table["kind"] == "trade").sort_values(["at", "is_trade", "u"], kind="stable")
        for x in table.itertuples():
            if x.E < water:
                out.append((key[0], "late", int(x.E) * 1_000_000, int(x.u), 0, 0, [], [], [], [], r.epoch, r.state, x.kind))
            elif x.is_trade:
                if r.state == "LIVE":
                    t = x.trade if isinstance(x.trade, dict) else x.trade.asDict()
                    out.append((key[0], "trade", t["ts_ns"], r.prev_u, 0, 0, [], [], [], [], r.epoch, r.state, "", None, *(t[c] for c in _TRADE_COLUMNS[1:])))
            else:
                sides = ([(y["p"], y["q"]) for y in (side if side is not None else ())] for side in (x.bids, x.asks))
                out += r.step((x.kind, int(x.E), int(x.first_u), int(x.u), int(x.pu), *sides))
        self._kept(r, before)
        self._timer(r)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        r = self._restored(key[0])
        before = self._sides(r)
        out = list(r.until(timerValues.getCurrentWatermarkInMs() * 1_000_000 // self.tick_ns))
        self._kept(r, before)
        self._timer(r)
        yield self._frame(out)

    def close(self) -> None:
        pass


def recorded(events: DataFrame, depth: int = 1000, tick_ns: int = 100_000_000, late: str = "10 seconds") -> DataFrame:
    """RECORDED rows of a stream of INPUT: ``book`` for each tick while LIVE (``tick`` is its number, ts_ns the time of the
    book's last event), ``sync`` for state changes, ``trade`` for trades that meet a LIVE book, and ``late`` for rows whose event time
    (E, in ms) is over ``late`` behind the newest; what they were is in ``reason``."""
    timed = events.withColumn("time", F.timestamp_millis("E")).withWatermark("time", late).drop("time")
    return timed.groupBy("symbol").transformWithStateInPandas(_Recorder(depth, tick_ns), RECORDED, "append", "EventTime")


def snapshot_rows(rows: DataFrame) -> DataFrame:
    """Rows of the snapshots table, one a tick."""
    return rows.where("row = 'book'").select(*SNAPSHOT_COLUMNS)


def trade_rows(rows: DataFrame) -> DataFrame:
    """Rows of the trades table."""
    return rows.where("row = 'trade'").select("ts_ns", "symbol", *_TRADE_COLUMNS[1:])


def notes(rows: DataFrame) -> DataFrame:
    """State changes and late rows."""
    return rows.where("row in ('sync', 'late')").select("ts_ns", "symbol", "row", "state", "reason", "u", "resync_epoch")


def late_counts(rows: DataFrame) -> DataFrame:
    """(symbol, kind, rows) of the late rows among recorded or notes rows."""
    return rows.where("row = 'late'").groupBy("symbol", F.col("reason").alias("kind")).agg(F.count("*").alias("rows"))


def start(events: DataFrame, root: str, checkpoint: str, depth: int = 1000, tick_ns: int = 100_000_000, late: str = "10 seconds", interval: str = "60 seconds") -> list[StreamingQuery]:
    """Start recording a stream of INPUT into the lake at ``root``: tables snapshots, trades and notes.

    Spark's file sink writes each table exactly once, over restarts from the same ``checkpoint`` too; it takes one query a
    table, and each follows the books by itself, so they agree whatever their pace."""
    rows = recorded(events, depth, tick_ns, late)
    return [record(f(rows), f"{root}/{name}", f"{checkpoint}/{name}", interval) for name, f in (("snapshots", snapshot_rows), ("trades", trade_rows), ("notes", notes))]
