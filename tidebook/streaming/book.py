"""Order-book replay from depth events: the sync state machine and the book, in batch and as a stream.

Events of one symbol come in order of arrival: ``book`` rows hold a whole book, ``diff`` rows absolute
quantities per level. The book takes only differences that continue each other; a break starts a new
epoch, and the book waits for the next whole book and the difference that contains its id.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidebook.functions.expressions import price_to_ticks, qty_to_lots, whole
from tidebook.operators.asof import previous
from tidebook.schemas import Scale
from tidebook.storage import cut
from tidebook.streaming.machine import BUFFER, COLUMNS, EVENTS, OUTPUT, Compact, Outline, Replay

__all__ = ["BUFFER", "COLUMNS", "EVENTS", "OUTPUT", "Replay", "replay", "replay_stream"]

_DEALT = ["symbol", "slice", "start", "kind", "E", "first_u", "u", "pu", "bids", "asks"]
_STATES = "symbol string, slice long, state string, resyncs int"
_SEEDS = "symbol string, slice long, start string, resyncs int, sure boolean"
_LEVELS_AT_ONCE = 400_000
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _levels(levels) -> list[tuple[int, int]]:
    return [] if levels is None else [(x["p"], x["q"]) if isinstance(x, dict) else (x[0], x[1]) for x in levels]


def _event(r) -> tuple:
    return (r.kind, int(r.E), int(r.first_u), int(r.u), int(r.pu), _levels(r.bids), _levels(r.asks))


def _list(column: pa.Array) -> list:
    """The longs of a column, None for null; by NumPy, which is many times faster than to_pylist."""
    values = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    if column.null_count:
        for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            values[k] = None
    return values


def _texts(column: pa.Array) -> list:
    """The texts of a column of few different ones."""
    coded = column.dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    return [names[k] for k in coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]


def _side(column: pa.Array) -> list[list[tuple[int, int]]]:
    """The (p, q) of each row's levels; none for null."""
    inner = column.flatten()
    pairs = list(zip(_list(inner.field("p")), _list(inner.field("q")), strict=True))
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [pairs[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(symbol, slice, start, event) of each row in order; the row that brings the start has no event."""
    for b in batches:
        c = {n: b.column(n) for n in b.schema.names}
        events = zip(_texts(c["kind"]), *(_list(c[n]) for n in ("E", "first_u", "u", "pu")), _side(c["bids"]), _side(c["asks"]), strict=True)
        yield from zip(_texts(c["symbol"]), _list(c["slice"]), _texts(c["start"]), events, strict=True)


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _padded(levels: list[int], sizes: list[int], books: np.ndarray, base: np.ndarray, depth: int, kind: pa.DataType) -> pa.Array:
    """One list a row: of the rows marked as ``books`` their levels less their base, filled up with zeros to the depth; else none."""
    size = np.array(sizes, np.int64)[books]
    flat = np.zeros((len(size), depth), np.int64)
    flat[np.arange(depth) < size[:, None]] = np.array(levels, np.int64) - np.repeat(base[books], size)
    ends = np.cumsum(np.r_[0, books * depth])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.ravel()).cast(kind))


def _rows(rows: list[tuple], levels: tuple[list[int], ...], depth: int, columns: list[str]) -> pa.RecordBatch:
    """A batch of ``columns`` of OUTPUT from the notes and books of ``Compact``."""
    if not rows:
        return _arrow([], OUTPUT).select(columns)
    symbol, row, ts_ns, u, bid, ask, *sizes, epoch, state, reason = zip(*rows, strict=True)
    books = np.array([r == "book" for r in row])
    bid, ask, none = np.array(bid, np.int64), np.array(ask, np.int64), np.zeros(len(rows), np.int64)
    sizes = [[n or 0 for n in size] for size in sizes]  # a note's sides are empty lists
    names = ("bids_price_delta", "bids_qty_lots", "asks_price_delta", "asks_qty_lots")
    found = {c: _padded(*x, books, base, depth, kind) for c, *x, base, kind in zip(names, levels, sizes, (bid, none, ask, none), (pa.int32(), pa.int64()) * 2, strict=True) if c in columns}
    found |= {c: pa.array(x, pa.string()) for c, x in (("symbol", symbol), ("row", row), ("state", state), ("reason", reason))}
    found |= {c: pa.array(x, pa.int64()) for c, x in (("ts_ns", ts_ns), ("u", u), ("best_bid_ticks", bid), ("best_ask_ticks", ask))}
    found["resync_epoch"] = pa.array(epoch, pa.int32())
    return pa.RecordBatch.from_arrays([found[c] for c in columns], names=columns)


def _outlines(depth: int, tick_ns: int):
    """(symbol, slice, state): of each slice, as JSON, what it does to a live book that it continues, and to one that waits."""

    def told(live: Outline, waiting: Outline, whole_books: int) -> str:
        live.settle()
        sides = [sorted(side.items()) for side in (live.bids, live.asks)]
        return json.dumps([live.first_pu, live.fresh, live.save(), sides, live.epoch, whole_books, waiting.save(), waiting.epoch])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live, waiting, books, joined, more = None, None, None, 0, False, 0

        def end() -> pa.RecordBatch:
            if joined:  # one machine went on for both
                waiting.restore(live.save())
                waiting.epoch = live.epoch + more
            return _arrow([(*key, told(live, waiting, books), 0)], _STATES)

        for symbol, slice_, _, event in _slices(batches):
            if key != (symbol, slice_):
                if key:
                    yield end()
                key, books, joined = (symbol, slice_), 0, False
                live, waiting = (Outline(symbol, depth, tick_ns, state) for state in ("LIVE", "BUFFERING"))
            if not live.follow(event):
                books += event[0] == "book"
                for _ in live.step(event):
                    pass
            if not joined and not waiting.follow(event):
                for _ in waiting.step(event):
                    pass
                if waiting.state == "LIVE" and live.joined(waiting):
                    joined, more = True, waiting.epoch - live.epoch
        if key:
            yield end()

    return run


def _combined(depth: int, tick_ns: int):
    """From the outlines of a symbol's slices in order the state in which each begins. It is sure where no trimming
    inside the slices before, and no doubt about their sync, could have made it another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, now, sync, levels = None, None, True, True
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.symbol != symbol:
                    symbol, now, sync, levels = r.symbol, Replay(r.symbol, depth, tick_ns), True, True
                pu, fresh, end, sides, live_resyncs, books, waiting_end, waiting_resyncs = json.loads(r.state)
                begin, sure, resyncs = now.save(), sync and levels, 0
                if now.state == "LIVE" and (pu is None or pu == now.prev_u):
                    then = Replay(r.symbol, depth, tick_ns).restore(end)
                    resyncs = live_resyncs
                    if fresh or then.state != "LIVE":
                        now, levels = then, True
                    elif pu is not None:
                        for own, changes in ((now.bids, sides[0]), (now.asks, sides[1])):
                            levels = levels and len(own.keys() | {p for p, _ in changes}) <= depth
                            own.update(changes)
                            for p in [p for p, q in changes if not q]:
                                del own[p]
                        now._trim()
                        now.prev_u, now.ts_ns, now.touched = then.prev_u, then.ts_ns, True
                elif now.state == "BUFFERING" and not books:
                    for e in Replay(r.symbol).restore(waiting_end).buffer:
                        now.buffer.append(e)
                else:
                    sync = sync and now.state == "BUFFERING" and not now.buffer
                    before = now
                    now, levels, resyncs = Replay(r.symbol, depth, tick_ns).restore(waiting_end), True, waiting_resyncs + (before.state == "LIVE")
                    if not now.prev_u and not now.ts_ns:  # nothing was applied: the notes go on telling the last event
                        now.prev_u, now.ts_ns = before.prev_u, before.ts_ns
                    sync = sync and not (before.prev_u or before.ts_ns)
                out.append((symbol, r.slice, begin, resyncs, sure))
            yield pd.DataFrame(out, columns=["symbol", "slice", "start", "resyncs", "sure"])

    return run


def _ends(depth: int, tick_ns: int):
    """(symbol, slice, state, resyncs): the state after each slice, from the one it starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for symbol, slice_, start, event in _slices(batches):
            if start is not None:
                if key:
                    yield _arrow([(*key, now.save(), now.epoch)], _STATES)
                key, now = (symbol, slice_), Replay(symbol, depth, tick_ns).restore(start)
                now.view = lambda: None  # books are not asked for
            elif not now.follow(event):
                for _ in now.step(event):
                    pass
        if key:
            yield _arrow([(*key, now.save(), now.epoch)], _STATES)

    return run


def _books(depth: int, tick_ns: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, out, sides = None, False, [], tuple([] for _ in range(4))
        for symbol, _, start, event in _slices(batches):
            if start is not None:
                if last:
                    out += now.flush()
                now = Compact(symbol, depth, tick_ns).restore(start)
                now.sides = sides
                now.epoch, last = event[1], event[2] == 1  # the start's row has the epoch in E, and whether the slice is the last in first_u
            elif not now.follow(event):
                out += now.step(event)
                if len(out) * depth > _LEVELS_AT_ONCE:
                    yield _rows(out, sides, depth, columns)
                    out, sides = [], tuple([] for _ in range(4))
                    now.sides = sides
        if last:
            out += now.flush()
        yield _rows(out, sides, depth, columns)

    return run


def _by_slice(rows: DataFrame, *order) -> DataFrame:
    """Each slice in one task and in order. The number of partitions is given: left to itself, Spark would merge small ones,
    and Python's work on them with them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "symbol", "slice").sortWithinPartitions("symbol", "slice", *order).select(*_DEALT)


def _started(dealt: DataFrame, starts: DataFrame) -> DataFrame:
    """Events by slice and in order, each slice after the row of ``starts`` (symbol, slice, start, E, first_u) that begins it."""
    none = [F.lit(None).cast(dealt.schema[c].dataType).alias(c) for c in ("at", "kind", "u", "pu", "bids", "asks")]
    rows = dealt.withColumn("start", F.lit(None).cast("string")).unionByName(starts.select("symbol", "slice", "start", "E", "first_u", *none))
    return _by_slice(rows, F.col("start").isNull(), "at", "u")


def replay(events: DataFrame, depth: int = 1000, tick_ns: int = 100_000_000, span: int = 3_600_000, columns: list[str] | None = None) -> DataFrame:
    """Books (row = book) and state changes (row = sync) of all symbols, from a table of EVENTS in order of ``at``
    then ``u``; rows without a symbol are left out, rows without ``at`` come first.

    The log is cut into slices of ``span`` units of ``at``, which tasks replay side by side, each as a stream. What a slice
    starts from is found beforehand: every slice tells what it does to a book it does not know (the last quantity of each
    level, and all of the book once a whole one came), and these outlines, one row a slice, are put together in order.
    That is exact unless the depth trims levels in between or a slice begins out of sync; such slices are run for their
    end, without books, and where an end is not what the next slice starts from, that one is run again from it,
    until all agree. Every round settles at least one more slice of a symbol, mostly all of them.

    ``columns`` names those of OUTPUT that are wanted (all): Spark can't leave out what Python makes.
    """
    key = ["symbol", "slice"]
    slice_ = F.coalesce(whole(F.col("at"), span), F.lit(-(1 << 62)))
    dealt = cut(events.where("symbol is not null").select("symbol", slice_.alias("slice"), "at", "kind", "E", "first_u", "u", "pu", "bids", "asks"))
    inside = dealt.withColumn("start", F.lit(None).cast("string"))
    outlines = _by_slice(inside, "at", "u").mapInArrow(_outlines(depth, tick_ns), _STATES)
    seeds = outlines.repartition("symbol").sortWithinPartitions(*key).mapInPandas(_combined(depth, tick_ns), _SEEDS)
    following = Window.partitionBy("symbol").orderBy("slice")
    seeds = cut(seeds.withColumn("then", F.lead("slice").over(following)).withColumn("_sure", F.lead("sure").over(following)))
    asked = seeds.where("then is not null and not _sure").select(*key, "start", "then")
    while not asked.isEmpty():
        starts = asked.select(*key, "start", F.lit(0).cast("long").alias("E"), F.lit(0).cast("long").alias("first_u"))
        ends = cut(_started(dealt.join(asked.select(*key), key, "left_semi"), starts).mapInArrow(_ends(depth, tick_ns), _STATES))
        after = ends.join(asked.select(*key, "then"), key).select("symbol", F.col("then").alias("slice"), F.col("state").alias("_state"))
        counts = ends.select(*key, F.col("resyncs").alias("_resyncs"))
        both = seeds.join(after, key, "left").join(counts, key, "left")
        moved = F.coalesce(F.col("_state") != F.col("start"), F.lit(False))
        start = F.coalesce("_state", "start")
        seeds = cut(both.select(*key, start.alias("start"), F.coalesce("_resyncs", "resyncs").alias("resyncs"), "then", moved.alias("moved")))
        asked = seeds.where("moved and then is not null").select(*key, "start", "then")
    before = F.sum("resyncs").over(following.rowsBetween(Window.unboundedPreceding, -1))
    starts = seeds.select(*key, "start", F.coalesce(before, F.lit(0)).cast("long").alias("E"), F.when(F.col("then").isNull(), 1).otherwise(0).cast("long").alias("first_u"))
    columns = [c for c in COLUMNS if columns is None or c in columns]
    kept = ", ".join(f for f in OUTPUT.split(", ") if f.split()[0] in columns)
    return _started(dealt, starts).mapInArrow(_books(depth, tick_ns, columns), kept)


def replay_stream(events: DataFrame, depth: int = 1000, tick_ns: int = 100_000_000) -> DataFrame:
    """The same over a stream of EVENTS, with the levels, the buffer and the sync state in Spark's state store.
    Events of a trigger are ordered by ``at`` then ``u``; a book comes out when its tick has passed."""
    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.levels = handle.getMapState("levels", "side string, p long", "q long")
            self.scalars = handle.getValueState("sync", "state string, prev_u long, book_id long, epoch int, ts_ns long, touched boolean")
            self.waiting = handle.getListState("buffer", "kind string, E long, first_u long, u long, pu long, b string, a string")

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            r = Replay(key[0], depth, tick_ns)
            if self.scalars.exists():
                r.state, r.prev_u, r.book_id, r.epoch, r.ts_ns, r.touched = self.scalars.get()
            for (side, p), (q,) in self.levels.iterator():
                (r.bids if side == "b" else r.asks)[p] = q
            before = {("b", p): q for p, q in r.bids.items()} | {("a", p): q for p, q in r.asks.items()}
            r.buffer = deque(((k, E, U, u, pu, json.loads(b), json.loads(a)) for k, E, U, u, pu, b, a in self.waiting.get()), BUFFER)
            out: list[tuple] = []
            for row in pd.concat(list(rows)).sort_values(["at", "u"], kind="stable").itertuples():
                out += r.step(_event(row))
            after = {("b", p): q for p, q in r.bids.items()} | {("a", p): q for p, q in r.asks.items()}
            for k in before.keys() - after.keys():
                self.levels.removeKey(k)
            for k, q in after.items():
                if before.get(k) != q:
                    self.levels.updateValue(k, (q,))
            self.scalars.update((r.state, r.prev_u, r.book_id, r.epoch, r.ts_ns, r.touched))
            self.waiting.clear()
            if r.buffer:
                self.waiting.put([(k, E, U, u, pu, json.dumps(b), json.dumps(a)) for k, E, U, u, pu, b, a in r.buffer])
            yield pd.DataFrame(out, columns=COLUMNS)

        def close(self) -> None:
            pass

    return events.groupBy("symbol").transformWithStateInPandas(Processor(), OUTPUT, "append", "None")


def latest_levels(changes: DataFrame) -> DataFrame:
    """(symbol, side, price_ticks, qty_lots): the last quantity of each level by ``u`` (of equal ones the
    largest), deleted levels left out.
    The book without trimming: levels that a depth limit would have forgotten stay."""
    last = changes.groupBy("symbol", "side", "price_ticks").agg(F.max_by("qty_lots", F.struct("u", "qty_lots")).alias("qty_lots"))
    return last.where("qty_lots > 0")


def best_levels(levels: DataFrame) -> DataFrame:
    """Best bid and ask of each symbol with their quantities."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    p = F.col("price_ticks")
    return levels.groupBy("symbol").agg(
        F.max(F.when(bid, p)).alias("best_bid_ticks"), F.max_by("qty_lots", F.when(bid, p)).alias("best_bid_lots"), F.min(F.when(ask, p)).alias("best_ask_ticks"), F.min_by("qty_lots", F.when(ask, p)).alias("best_ask_lots")
    )


def top_levels(levels: DataFrame, depth: int) -> DataFrame:
    """The best ``depth`` levels per symbol and side, numbered from 1."""
    order = F.when(F.col("side") == "bid", -F.col("price_ticks")).otherwise(F.col("price_ticks"))
    rank = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(order))
    return levels.withColumn("level", rank).where(F.col("level") <= depth)


def sequence_audit(diffs: DataFrame) -> DataFrame:
    """(symbol, u, pu, gap, epoch) of a difference log (symbol, U, u, pu): gap where pu is not the u before it; the
    epoch counts the gaps so far."""
    bucket = whole(F.col("u"), 1_000_000)
    rows = previous(diffs.select("symbol", "u", "pu"), ["u"], ["u"], ["symbol"], bucket)
    rows = rows.withColumn("gap", F.coalesce(F.col("pu") != F.col("prev.u"), F.lit(False))).drop("prev").withColumn("bucket", bucket)
    sums = rows.groupBy("symbol", "bucket").agg(F.count_if("gap").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(F.col("gap").cast("long")).over(Window.partitionBy("symbol", "bucket").orderBy("u").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(sums.select("symbol", "bucket", base.alias("base")), ["symbol", "bucket"]).select("symbol", "u", "pu", "gap", (F.col("base") + F.col("_own")).alias("epoch"))


def scaled_levels(levels: Column, scale: Scale = Scale()) -> Column:
    """Levels [[price, qty], ...] of text as structs (p, q) in ticks and lots."""
    return F.transform(levels, lambda x: F.struct(price_to_ticks(x[0].cast("double"), scale).alias("p"), qty_to_lots(x[1].cast("double"), scale).alias("q")))
