import json

import pytest
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.operators import calibration, penetration
from tidebook.sources import market, sinks
from tidebook.streaming import book, feeds

BOOK = {"lastUpdateId": 1000, "bids": [["50000.0", "1.5"], ["49999.9", "2.0"]], "asks": [["50000.1", "1.2"], ["50000.2", "2.5"]]}
DIFFS = [
    {"e": "depthUpdate", "E": 1700000000100, "s": "BTCUSDT", "U": 998, "u": 1002, "pu": 997, "b": [["50000.0", "1.8"]], "a": []},
    {"e": "depthUpdate", "E": 1700000000200, "s": "BTCUSDT", "U": 1003, "u": 1005, "pu": 1002, "b": [], "a": [["50000.1", "1.0"]]},
]


def lines(spark, *items):
    return spark.createDataFrame([(x if x is None or isinstance(x, str) else json.dumps(x),) for x in items], "value string")


def test_feed_of_books_and_differences_goes_live(spark):
    diffs = feeds.depth_rows(feeds.decode(lines(spark, *DIFFS, "{broken"), schemas.DEPTH_EVENT))
    books = feeds.book_rows(feeds.decode(lines(spark, BOOK), schemas.BOOK_EVENT).withColumn("at", F.lit(1700000000050)), "BTCUSDT")
    rows = book.replay(books.unionByName(diffs), depth=10).orderBy("ts_ns").collect()
    assert [r.state for r in rows if r.row == "sync"][-1] == "LIVE"
    last = [r for r in rows if r.row == "book"][-1]
    assert (last.u, last.best_bid_ticks, last.best_ask_ticks) == (1005, 500000, 500001)
    assert last.bids_qty_lots[:2] == [1800, 2000] and last.asks_qty_lots[:2] == [1000, 2500]


def test_decoding_leaves_the_session_alone_and_counts_bad_lines(spark):
    name = "spark.sql.caseSensitive"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        text = lines(spark, *DIFFS, "{broken", "[1]", "7", None)
        assert feeds.depth_rows(feeds.decode(text, schemas.DEPTH_EVENT)).agg(F.sum("u").alias("U")).first()[0] == 2007
        assert spark.conf.get(name) == "false"
        bad = {r.value for r in feeds.undecodable(text, schemas.DEPTH_EVENT).collect()}
        assert bad == {"{broken", "[1]", "7", None}
        assert feeds.decode(text, schemas.DEPTH_EVENT).count() + feeds.undecodable(text, schemas.DEPTH_EVENT).count() == text.count()
    finally:
        spark.conf.set(name, before)


def test_quiet_ticks_repeat_the_last_book(spark):
    rows = spark.createDataFrame([("A", 5, 1), ("A", 17, 2), ("A", 18, 3), ("A", 51, 4), ("B", 3, 1)], "symbol string, ts_ns long, u long")
    got = sorted((r.symbol, r.tick, r.snap.u) for r in feeds.every_tick(rows, [], 10).collect())
    assert got == [("A", 0, 1), ("A", 1, 3), ("A", 2, 3), ("A", 3, 3), ("A", 4, 3), ("A", 5, 4), ("B", 0, 1)]


def test_only_live_equals_plain_search(spark):
    spans = [("A", 10, 20), ("A", 30, None), ("B", 5, 6)]
    trades = [(s, t) for s in "ABC" for t in range(0, 40, 3)] + [("A", 10), ("A", 20), ("A", 10), ("B", 5), ("B", 6)]
    want = sorted((s, t) for s, t in trades if any(s == x and a <= t and (b is None or t < b) for x, a, b in spans))
    found = feeds.only_live(spark.createDataFrame(trades, "symbol string, ts_ns long"), spark.createDataFrame(spans, "symbol string, from_ns long, to_ns long"))
    assert sorted(map(tuple, found.collect())) == want


def test_healed_rows_never_go_over_their_source(spark, tmp_path):
    rows = spark.createDataFrame([("S", "2024-01-01", "05", 7)], "symbol string, date string, hour string, ts_ns long")
    rows.write.partitionBy("symbol", "date", "hour").parquet(str(tmp_path / "lake/snapshots"))
    read = spark.read.schema("ts_ns long, symbol string, date string, hour string").parquet(str(tmp_path / "lake/snapshots"))
    for source, target in ((f"{tmp_path}/lake/snapshots", f"{tmp_path}/lake"), ("/elsewhere", f"{tmp_path}/lake"), (f"{tmp_path}/lake", f"file://{tmp_path}/lake/"), ("/elsewhere", f"{tmp_path}/lake/snapshots/symbol=S")):
        with pytest.raises(ValueError):
            sinks.write_healed(read, source, target)
    sinks.write_healed(read, f"{tmp_path}/lake", f"{tmp_path}/healed")
    back = spark.read.option("basePath", str(tmp_path / "healed/snapshots")).schema("ts_ns long, symbol string, date string, hour string").parquet(str(tmp_path / "healed/snapshots"))
    assert [(r.symbol, r.date, r.hour, r.ts_ns) for r in back.collect()] == [("S", "2024-01-01", "05", 7)] and read.count() == 1


def test_levels_of_shallow_deep_and_overflowing_trades(spark):
    qty = [10] * 40
    snaps = spark.createDataFrame([("A", 0, 1, qty, qty), ("A", 9, 2, [], None)], "symbol string, ts_ns long, u long, bids_qty_lots array<long>, asks_qty_lots array<long>")
    trades = spark.createDataFrame([("A", 1, k, q, True) for k, q in enumerate((5, 10, 11, 160, 161, 400, 401))] + [("A", 9, 7, 3, True), ("A", 9, 8, 3, False)], "symbol string, ts_ns long, agg_trade_id long, qty_lots long, is_buyer_maker boolean")
    for top, beyond, empty in ((1000, 1001, 1001), (None, 41, 1), (5, 6, 6)):
        got = {r.agg_trade_id: (r.penetration_level, r.is_overflow) for r in penetration.penetrations(trades, snaps, top).collect()}
        want = [1, 1, 2, 16, 17, 40, beyond] if top != 5 else [1, 1, 2, 6, 6, 6, 6]
        assert [got[k][0] for k in range(7)] == want
        assert [got[k][1] for k in range(7)] == [w == beyond for w in want]
        assert got[7] == (empty, True) and got[8][0] is None


def test_no_shuffle_carries_whole_arrays_of_unmatched_books(spark, sf):
    found = penetration.penetrations(market.trades(spark, sf).where("qty_lots < 50"), market.snapshots(spark, sf))
    assert found.where("is_overflow").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_healing_equals_plain_interpolation(spark):
    points = [(0, 1000, 2.0), (1000, 2000, -4.0), (5000, 6000, 8.0)]
    curve = spark.createDataFrame([("A", a, b, o) for a, b, o in points], "symbol string, window_start_ns long, window_end_ns long, optimal_offset_ms double")
    times = [*range(-100, 7000, 37), 500, 1500, 5500]
    snaps = spark.createDataFrame([("A", t, "x") for t in times] + [("B", 7, "y"), (None, 8, "z"), ("A", None, "n")], "symbol string, ts_ns long, note string")
    centres = [((a + b) // 2, o * 1e6) for a, b, o in points]

    def plain(t):
        if t < centres[0][0]:
            return int(centres[0][1])
        for (a, p), (b, q) in zip(centres, centres[1:], strict=False):
            if a <= t < b:
                return int(p + (q - p) * (t - a) / (b - a))
        return int(centres[-1][1])

    for slot in (1, 700, 10**9):
        rows = calibration.heal(snaps, curve, ["symbol"], slot).collect()
        assert len(rows) == len(times) + 3
        assert sorted((r.ts_ns_original, r.offset_applied_ns, r.ts_ns) for r in rows if r.note == "x") == sorted((t, plain(t), t + plain(t)) for t in times)
        assert [r.offset_applied_ns for r in rows if r.note in "yz"] == [0, 0]
