import random


from tidebook.schemas import DEPTH_EVENT, TRADE_EVENT, Scale
from tidebook.streaming import book, feeds

BIDS = [(500000, 1500), (499999, 2000), (499998, 3000), (499997, 1000), (499996, 500)]
ASKS = [(500001, 1200), (500002, 2500), (500003, 1800), (500004, 3000), (500005, 800)]


def diff(E, U, u, pu, bids=(), asks=()):
    return ("diff", E, U, u, pu, list(bids), list(asks))


def live(depth=10):
    r = book.Replay("S", depth)
    list(r.step(("book", 0, 0, 1000, 0, BIDS, ASKS)))
    list(r.step(diff(1700000000100, 998, 1002, 997, [(500000, 1800)])))
    return r


def test_snapshot_then_differences():
    r = live()
    assert r.state == "LIVE" and r.bids[500000] == 1800 and len(r.bids) == len(r.asks) == 5
    list(r.step(diff(1700000000200, 1003, 1005, 1002, (), [(500001, 1000)])))
    assert r.asks[500001] == 1000 and r.prev_u == 1005
    list(r.step(diff(1700000000300, 1006, 1008, 1005, [(500000, 0), (500010, 7)])))
    row = dict(zip(book.COLUMNS, r.view(), strict=True))
    assert row["best_bid_ticks"] == 500010 and row["bids_price_delta"][:3] == [0, -11, -12] and row["asks_price_delta"][:2] == [0, 1]
    assert len(row["bids_qty_lots"]) == 10 and row["bids_qty_lots"][5:] == [0] * 5


def test_trim_forgets_deep_levels():
    r = live(depth=3)
    assert sorted(r.bids) == [499998, 499999, 500000]
    list(r.step(diff(1700000000200, 1003, 1005, 1002, [(500000, 0)])))
    assert sorted(r.bids) == [499998, 499999]


def test_gap_starts_a_new_epoch_and_waits_for_a_book():
    r = live()
    rows = list(r.step(diff(1700000000200, 1010, 1012, 1009, [(1, 1)])))
    assert [x[11] for x in rows if x[1] == "sync"] == ["RESYNCING", "BUFFERING"] and r.epoch == 1
    assert "pu=1009 != prev_u=1002" in [x[12] for x in rows if x[1] == "sync"][0]
    list(r.step(diff(1700000000300, 1013, 1015, 1012)))
    list(r.step(diff(1700000000400, 1016, 1018, 1015, [(500009, 4)])))
    assert r.state == "BUFFERING" and len(r.buffer) == 2
    rows = list(r.step(("book", 0, 0, 1014, 0, BIDS, ASKS)))
    assert r.state == "LIVE" and r.prev_u == 1018 and r.bids[500009] == 4
    assert [x[11] for x in rows if x[1] == "sync"] == ["SYNCING", "LIVE"]


def test_late_sync_point_and_dropped_differences():
    r = book.Replay("S")
    list(r.step(diff(1, 1, 5, 0)))
    list(r.step(("book", 0, 0, 100, 0, BIDS, ASKS)))
    assert r.state == "SYNCING" and not r.buffer
    list(r.step(diff(2, 90, 95, 89)))
    list(r.step(diff(3, 101, 105, 95)))
    assert r.state == "SYNCING"
    list(r.step(diff(4, 98, 103, 97)))
    assert r.state == "LIVE" and r.prev_u == 103


def _events(spark):
    rows = []
    for s in ("A", "B"):
        rows.append((s, 0, "book", 0, 1, 1, 1, [(100, 5), (99, 6)], [(101, 4)]))
        for n in range(1, 60):
            pu = n - 2 if n == 31 else n - 1
            rows.append((s, n, "diff", 40 * n, n, n, pu, [(90 + n % 12, n % 5)], [(101 + n % 7, n % 4)]))
        rows.append((s, 40, "book", 0, 39, 39, 39, [(100, 5)], [(101, 4)]))
    return spark.createDataFrame(rows, book.EVENTS)


def test_batch_equals_stream(spark, tmp_path):
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = _events(spark)
    key = lambda df: sorted((r.symbol, r.row, r.ts_ns, r.u, r.best_bid_ticks, r.best_ask_ticks, r.resync_epoch, r.state, tuple(r.bids_qty_lots)) for r in df.collect())
    batch = key(book.replay(events, depth=4))
    source = str(tmp_path / "in")
    for k in range(3):
        events.where(f"at >= {20 * k} and at < {20 * k + 20 if k < 2 else 999}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = book.replay_stream(stream, depth=4).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = key(spark.table("replayed"))
    last = {max(x for x in batch if x[0] == s and x[1] == "book") for s in ("A", "B")}
    assert set(got) <= set(batch) and set(batch) - set(got) <= last
    assert {x[7] for x in batch} >= {"LIVE", "SYNCING", "RESYNCING", "BUFFERING"}


def test_decoding(spark):
    lines = spark.createDataFrame([('{"T": 5, "p": "50000.05", "q": "0.0015", "m": true, "a": 7}',), ("{oops",), ('{"T": 6, "p": "1", "q": "2"}',), (None,)], "value string")
    rows = feeds.trade_rows(feeds.decode(lines, TRADE_EVENT), Scale(), "S").collect()
    assert [(r.ts_ns, r.price_ticks, r.qty_lots, r.is_buyer_maker, r.agg_trade_id, r.first_trade_id) for r in rows] == [(5000000, 500000, 2, True, 7, 0), (6000000, 10, 2000, False, 0, 0)]
    text = '{"e":"depthUpdate","E":17,"T":17,"s":"S","U":1,"u":2,"pu":0,"b":[["50000.0","1.5"]],"a":[]}'
    r = feeds.depth_rows(feeds.decode(spark.createDataFrame([(text,)], "value string"), DEPTH_EVENT)).first()
    assert (r.E, r.first_u, r.u, r.pu, r.bids[0].p, r.bids[0].q, r.asks) == (17, 1, 2, 0, 500000, 1500, [])



def test_replay_by_epoch_equals_one_pass(spark):
    rng, rows = random.Random(5), []
    for symbol in ("A", "B", "C"):
        u = at = 0
        for k in range(4000 if symbol == "A" else 600):
            at += 1
            if rng.random() < 0.01:  # a whole book, older than the last differences or ahead of them
                rows.append((symbol, at, "book", k * 40, 0, max(0, u + rng.choice([-20, -1, 1, 2, 3])), 0, [(100 - i, 5) for i in range(4)], [(101 + i, 5) for i in range(4)]))
                continue
            first, pu = u + 1, u if rng.random() > (0.01 if symbol == "A" else 0.05) else u - 1
            u += rng.randrange(1, 4)
            rows.append((symbol, at, "diff", k * 40, first, u, pu, [(rng.randrange(90, 101), rng.randrange(3))], [(rng.randrange(101, 111), rng.randrange(3))]))
    rows += [("D", k, "diff", 40 * k, k, k, k - 1, [(9, 1)], None) for k in range(1, 1500)] + [("D", 1500, "book", 60000, 0, 3, 0, [(9, 1)], [(10, 1)])]
    rows += [(None, 1, "diff", 1, 1, 1, 0, None, None)]
    want = []
    for symbol in "ABCD":
        one = book.Replay(symbol, 5)
        for r in rows:
            if r[0] == symbol:
                want += one.step((*r[2:7], r[7] or [], r[8] or []))
        want += one.flush()
    events = spark.createDataFrame(rows, book.EVENTS)
    got = book.replay(events.repartition(7), 5, span=100).collect()
    plain = lambda x: sorted((repr(tuple(r)) for r in x))
    assert plain(got) == plain(want) and len({r.resync_epoch for r in got if r.symbol == "A"}) > 3
    assert book.replay(events.where("symbol = 'none'"), 5).count() == 0


def one_pass(rows, depth):
    want = []
    for symbol in sorted({r[0] for r in rows}):
        one = book.Replay(symbol, depth)
        for r in rows:
            if r[0] == symbol:
                want += one.step((*r[2:7], r[7] or [], r[8] or []))
        want += one.flush()
    return want


def unbroken(seed, n, prices, alive):
    """One epoch of one symbol: no break, so no whole book after the first; the depth trims all the time."""
    rng = random.Random(seed)
    rows = [("U", 0, "book", 0, 1, 1, 1, [(500 - k, 5) for k in range(prices)], [(501 + k, 5) for k in range(prices)])]
    for k in range(1, n):
        far = int(rng.random() ** 3 * prices)
        q = rng.randrange(1, 9) if rng.random() < alive else 0
        side = [(500 - far, q)], []
        rows.append(("U", k, "diff", 35 * k, k, k, k - 1, side[k % 2], [(501 + far, q)] if k % 2 else []))
    return rows


def test_one_unbroken_epoch_is_replayed_in_slices(spark):
    plain = lambda x: sorted(repr(tuple(r)) for r in x)
    for seed, n, prices, alive, depth, span in ((1, 2500, 60, 0.5, 8, 50), (2, 1500, 200, 0.7, 30, 100), (3, 1200, 10, 0.5, 100, 100)):
        rows = unbroken(seed, n, prices, alive)
        events = spark.createDataFrame(rows, book.EVENTS)
        got = book.replay(events, depth, span=span).collect()
        assert plain(got) == plain(one_pass(rows, depth)) and {r.resync_epoch for r in got} == {0}


def test_slices_that_begin_out_of_sync(spark):
    rng, rows = random.Random(9), []
    u = 0
    for k in range(3000):
        if rng.random() < 0.004:
            rows.append(("A", k, "book", k, 0, u + rng.choice([-30, -2, 0, 1, 3]), 0, [(100 - i, 5) for i in range(6)], [(101 + i, 5) for i in range(6)]))
        pu = u if rng.random() > 0.006 else u - 1
        first, u = u + 1, u + rng.randrange(1, 3)
        rows.append(("A", k, "diff", 30 * k, first, u, pu, [(rng.randrange(80, 101), rng.randrange(3))], [(rng.randrange(101, 121), rng.randrange(3))]))
    rows += [("A", None, "diff", 1, 1, 1, 0, None, None), ("B", 7, "book", 0, 0, 5, 0, None, None)]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[5]))
    plain = lambda x: sorted(repr(tuple(r)) for r in x)
    want = plain(one_pass(rows, 4))
    for span in (40, 333, 10**6):
        assert plain(book.replay(spark.createDataFrame(rows, book.EVENTS).repartition(6), 4, span=span).collect()) == want


def test_monitor_and_recording_streams(spark, tmp_path):
    rows = spark.createDataFrame([("S", 1000 * k * 1_000_000, k, k - 1 - (k == 7)) for k in range(1, 10)] + [("S", 60_000_000_000, 10, 9)], "symbol string, ts_ns long, u long, pu long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = feeds.monitor(stream, 2000).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.kind, r.before, r.after) for r in spark.table("alerts").collect()) == [("sequence", 6, 5), ("time", 9_000_000_000, 60_000_000_000)]
    q = feeds.record(stream, str(tmp_path / "lake"), str(tmp_path / "c2"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "lake")).where("date = '1970-01-01' and hour = 0").count() == 10


def test_live_gating(spark):
    sync = spark.createDataFrame([("S", 10, 0, "SYNCING"), ("S", 10, 0, "LIVE"), ("S", 50, 1, "RESYNCING"), ("S", 50, 1, "BUFFERING"), ("S", 90, 1, "LIVE")], "symbol string, ts_ns long, resync_epoch int, state string")
    trades = spark.createDataFrame([("S", t) for t in (5, 10, 49, 50, 89, 95)], "symbol string, ts_ns long")
    assert sorted(r.ts_ns for r in feeds.only_live(trades, feeds.live_intervals(sync)).collect()) == [10, 49, 95]



def test_outlines_make_no_changes_that_a_whole_book_replaces():
    """After a whole book the levels are only noted, and both machines of a slice are soon one; ends are as of plain steps."""
    rows, pu = [("book", 0, 0, 0, 0, BIDS, ASKS)], 0
    for n in range(1, 400):
        rows.append(diff(40 * n, n, n, pu, [(499990 + n % 17, n % 3)], [(500001 + n % 5, n % 4)]))
        pu = n - 7 if n % 150 == 0 else n
        if n % 150 == 1 and n > 1:
            rows.append(("book", 40 * n, 0, n + 1, 0, BIDS, ASKS))
    plain, lazy, waiting = book.Replay("S", 4), book.Outline("S", 4, 100_000_000, "BUFFERING"), book.Outline("S", 4, 100_000_000, "LIVE")
    for e in rows:
        list(plain.step(e))
        for machine in (lazy, waiting):
            if not machine.follow(e):
                list(machine.step(e))
    assert lazy.later and lazy.epoch == plain.epoch > 0 and lazy.joined(waiting) and not lazy.later
    assert lazy.save() == plain.save()


def test_replay_gives_the_wanted_columns(spark):
    events = spark.createDataFrame([("S", k, "book" if k % 50 == 0 else "diff", 40 * k, k, k + (k % 50 == 0), k - 1 - (k % 50 == 49), [(100 + k % 7, k % 3)], [(110 + k % 5, k % 4)]) for k in range(300)], book.EVENTS)
    some = ["symbol", "ts_ns", "u", "bids_qty_lots", "state"]
    every = book.replay(events, depth=3, span=90)
    assert every.columns == book.COLUMNS and book.replay(events, depth=3, span=90, columns=some).columns == some
    got = sorted(map(tuple, book.replay(events, depth=3, span=90, columns=some).collect()))
    assert got == sorted(map(tuple, every.select(some).collect())) and len(got) > 50
