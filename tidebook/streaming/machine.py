"""The book of one symbol and its sync state machine, one event at a time."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

BUFFER = 1000
LATER = 20_000
EVENTS = (
    "symbol string, at long, kind string, E long, first_u long, u long, pu long, bids array<struct<p:long,q:long>>, "
    "asks array<struct<p:long,q:long>>"
)
OUTPUT = (
    "symbol string, row string, ts_ns long, u long, best_bid_ticks long, best_ask_ticks long, bids_price_delta array<int>, bids_qty_lots array<long>, "
    "asks_price_delta array<int>, asks_qty_lots array<long>, resync_epoch int, state string, reason string"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class Replay:
    """The book of one symbol and where it stands in its synchronisation.

    ``state`` is BUFFERING until a whole book arrives, SYNCING until a difference contains that book's id
    (U <= id <= u), then LIVE. A difference whose pu is not the u before it triggers a resync: the epoch
    rises, the buffer empties and the state is BUFFERING again. The buffer keeps the newest BUFFER
    differences. Every applied event refreshes the book's time, and so does a break: state
    changes carry it.
    """

    def __init__(self, symbol: str, depth: int = 1000, tick_ns: int = 100_000_000):
        self.symbol, self.depth, self.tick_ns = symbol, depth, tick_ns
        self.bids: dict[int, int] = {}
        self.asks: dict[int, int] = {}
        self.buffer: deque[tuple] = deque(maxlen=BUFFER)
        self.state, self.prev_u, self.book_id, self.epoch, self.ts_ns, self.touched = "BUFFERING", 0, 0, 0, 0, False

    def _trim(self) -> None:
        for side, high in ((self.bids, True), (self.asks, False)):
            over = len(side) - self.depth
            if over > 4:
                for p in sorted(side, reverse=high)[self.depth :]:
                    del side[p]
            else:
                for _ in range(over):
                    del side[min(side) if high else max(side)]

    def load(self, bids, asks) -> None:
        self.bids = {int(p): int(q) for p, q in bids if q > 0}
        self.asks = {int(p): int(q) for p, q in asks if q > 0}
        self._trim()

    def change(self, bids, asks) -> None:
        for side, levels in ((self.bids, bids), (self.asks, asks)):
            for p, q in levels:
                if q > 0:
                    side[int(p)] = int(q)
                else:
                    side.pop(int(p), None)
        self._trim()

    def _note(self, state: str, reason: str = "") -> tuple:
        self.state = state
        return (self.symbol, "sync", self.ts_ns, self.prev_u, 0, 0, [], [], [], [], self.epoch, state, reason)

    def _resync(self, reason: str, ts_ns: int) -> Iterator[tuple]:
        yield from self.flush()
        self.epoch += 1
        self.ts_ns = ts_ns
        self.buffer = deque(maxlen=BUFFER)
        yield self._note("RESYNCING", reason)
        yield self._note("BUFFERING")

    def view(self) -> tuple:
        """The book as a snapshot row; sides are padded to the depth with zeros."""
        bids, asks = sorted(self.bids, reverse=True)[: self.depth], sorted(self.asks)[: self.depth]
        best_bid, best_ask = bids[0] if bids else 0, asks[0] if asks else 0
        pad = lambda x: x + [0] * (self.depth - len(x))
        return (
            self.symbol, "book", self.ts_ns, self.prev_u, best_bid, best_ask, pad([p - best_bid for p in bids]), pad([self.bids[p] for p in bids]),
            pad([p - best_ask for p in asks]), pad([self.asks[p] for p in asks]), self.epoch, self.state, "",
        )

    def flush(self) -> Iterator[tuple]:
        """The last book of the current tick, if any event changed it."""
        if self.touched:
            self.touched = False
            yield self.view()

    def _past(self, E: int) -> bool:
        """Whether the event's time is in another tick than the book's."""
        return E * 1_000_000 // self.tick_ns != self.ts_ns // self.tick_ns

    def _apply(self, event: tuple) -> Iterator[tuple]:
        _, E, _, u, _, bids, asks = event
        if self._past(E):
            yield from self.flush()
        self.change(bids, asks)
        self.prev_u, self.ts_ns, self.touched = u, E * 1_000_000, True

    def follow(self, event: tuple) -> bool:
        """Take a difference that continues a live book and gives no row, which most do; false, and nothing done, for any other event."""
        kind, E, _, u, pu, bids, asks = event
        if self.state != "LIVE" or pu != self.prev_u or kind == "book":
            return False
        if self.touched and self._past(E):
            return False
        self.change(bids, asks)
        self.prev_u, self.ts_ns, self.touched = u, E * 1_000_000, True
        return True

    def step(self, event: tuple) -> Iterator[tuple]:
        """Rows that the event (kind, E, U, u, pu, bids, asks) gives: state changes, and books of ticks past."""
        kind, _, U, u, pu, bids, asks = event
        if kind == "book":
            if self.state == "LIVE":
                return
            self.load(bids, asks)
            self.book_id = u
            yield self._note("SYNCING")
            waiting, self.buffer = self.buffer, deque(maxlen=BUFFER)
            for e in waiting:
                yield from self.step(e)
                if self.state == "BUFFERING":
                    break
        elif self.state == "BUFFERING":
            self.buffer.append(event)
        elif self.state == "SYNCING":
            if u >= self.book_id and U <= self.book_id:
                yield from self._apply(event)
                yield self._note("LIVE")
        elif pu != self.prev_u:
            yield from self._resync(f"sequence gap: pu={pu} != prev_u={self.prev_u}", event[1] * 1_000_000)
        else:
            yield from self._apply(event)

    def save(self) -> str:
        """What the next events depend on, without the epoch, as JSON: equal states give equal texts. A book that
        waits for whole levels forgets its own, and only a waiting book has a buffer."""
        waits = self.state not in ("LIVE", "SYNCING")
        sides = ([], []) if waits else (sorted(self.bids.items()), sorted(self.asks.items()))
        buffer = list(self.buffer) if waits else []
        return json.dumps([self.state, self.prev_u, self.book_id if self.state == "SYNCING" else 0, self.ts_ns, self.touched, *sides, buffer])

    def restore(self, text: str) -> Replay:
        """Take on a saved state."""
        self.state, self.prev_u, self.book_id, self.ts_ns, self.touched, bids, asks, buffer = json.loads(text)
        self.bids, self.asks, self.buffer = dict(bids), dict(asks), deque((tuple(e) for e in buffer), BUFFER)
        return self


class Compact(Replay):
    """A replay that keeps its prices in order (``high``: the bids', negated) instead of sorting them for every book. Its book
    rows have numbers of levels for sides; the levels' prices and quantities go to ``sides``, end to end and without padding."""

    sides: tuple[list[int], ...]

    def _order(self) -> None:
        self.high, self.low = sorted(-p for p in self.bids), sorted(self.asks)

    def load(self, bids, asks) -> None:
        super().load(bids, asks)
        self._order()

    def restore(self, text: str) -> Compact:
        super().restore(text)
        self._order()
        return self

    def _turn(self, side: dict[int, int], prices: list[int], levels, sign: int) -> None:
        for p, q in levels:
            p = int(p)
            if q > 0:
                if p not in side:
                    insort(prices, sign * p)
                side[p] = int(q)
            elif p in side:
                del side[p], prices[bisect_left(prices, sign * p)]
        while len(prices) > self.depth:
            del side[sign * prices.pop()]

    def change(self, bids, asks) -> None:
        if bids:
            self._turn(self.bids, self.high, bids, -1)
        if asks:
            self._turn(self.asks, self.low, asks, 1)

    def view(self) -> tuple:
        bids, asks = [-p for p in self.high], self.low
        for side, levels in zip(self.sides, (bids, map(self.bids.__getitem__, bids), asks, map(self.asks.__getitem__, asks)), strict=True):
            side += levels
        n, m = len(bids), len(asks)
        return (self.symbol, "book", self.ts_ns, self.prev_u, bids[0] if n else 0, asks[0] if m else 0, n, n, m, m, self.epoch, self.state, "")


class Outline(Replay):
    """What a slice of a log does to a book that is not known: levels keep their last quantity, 0 where they were
    deleted, and are not trimmed until a whole book makes all of them known (``fresh``). From then on changes are only
    noted, at most LATER of them, and made when the levels are asked for: the next whole book makes them needless."""

    def __init__(self, symbol: str, depth: int, tick_ns: int, state: str):
        super().__init__(symbol, depth, tick_ns)
        self.state, self.fresh, self.first_pu = state, False, None
        self.later: list[tuple] = []

    def settle(self) -> None:
        """Make the changes noted."""
        later, self.later = self.later, []
        for bids, asks in later:
            super().change(bids, asks)

    def load(self, bids, asks) -> None:
        self.fresh, self.later = True, []
        super().load(bids, asks)

    def change(self, bids, asks) -> None:
        if self.fresh:
            self.later.append((bids, asks))
            if len(self.later) >= LATER:
                self.settle()
            return
        for side, levels in ((self.bids, bids), (self.asks, asks)):
            for p, q in levels:
                side[int(p)] = max(0, int(q))

    def flush(self) -> Iterator[tuple]:
        self.touched = False
        return iter(())

    def _past(self, E: int) -> bool:
        return False  # no books come out

    def save(self) -> str:
        self.settle()
        return super().save()

    def follow(self, event: tuple) -> bool:
        if self.first_pu is None:
            return False
        return super().follow(event)

    def step(self, event: tuple) -> Iterator[tuple]:
        if self.first_pu is None and event[0] != "book":
            self.first_pu = event[4]
            if self.state == "LIVE":
                self.prev_u = event[4]
        return super().step(event)

    def joined(self, other: Outline) -> bool:
        """Whether both go on alike, but for their epochs: live, on the same known book."""
        if not (self.fresh and other.fresh and self.state == other.state == "LIVE" and (self.prev_u, self.ts_ns) == (other.prev_u, other.ts_ns)):
            return False
        self.settle()
        other.settle()
        return self.touched == other.touched and self.bids == other.bids and self.asks == other.asks
