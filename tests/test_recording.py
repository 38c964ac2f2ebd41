import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.operators.asof import asof_backward
from tidebook.plans import reports
from tidebook.streaming import book, feeds, recording

MS = 1_000_000


@pytest.fixture
def states(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # files of one second come in no order


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def diff(symbol, E, u, pu=None, bids=(), asks=()):
    return (symbol, E, "diff", E, u, u, u - 1 if pu is None else pu, list(bids), list(asks), None)


def whole(symbol, E, u):
    return (symbol, E, "book", E, u, u, 0, [(100, 5), (99, 6)], [(101, 4)], None)


def trade(symbol, E, n):
    return (symbol, E, "trade", E, 0, 0, 0, None, None, (E * MS, 100, n, n % 2 == 0, n, n, n))


BATCHES = [
    [trade("A", 1000, 1), whole("A", 1010, 1), diff("A", 1020, 1), trade("A", 1030, 2), whole("B", 1010, 1), diff("B", 1050, 1)],
    [diff("A", 1330, 2, bids=[(100, 7)]), diff("A", 1340, 3), trade("A", 1345, 3)],
    [diff("A", 1760, 9, 8), trade("A", 1770, 4), diff("A", 1830, 10), diff("A", 1900, 11)],
    [whole("A", 2010, 10), trade("A", 2020, 5), trade("A", 1000, 6), diff("A", 2110, 12, bids=[(98, 1)])],
    [diff("A", 3990, 13)],
]


def batch_ticks(spark, rows):
    """The same ticks from the batch: replayed books, the last one repeated in quiet ticks, cut to the LIVE intervals."""
    replayed = book.replay(spark.createDataFrame([r[:9] for r in rows if r[2] != "trade"], book.EVENTS), 5).cache()
    every = feeds.every_tick(replayed.where("row = 'book'").select("symbol", "ts_ns", "u"), []).withColumnRenamed("snap", "held")
    live = feeds.only_live(every, feeds.live_intervals(replayed.where("row = 'sync'")))
    return {(r.symbol, r.tick): (r.held.ts_ns, r.held.u) for r in live.collect()}


def test_ticks_timers_gates_and_late_rows(states, tmp_path):
    spark, path = states, str(tmp_path / "in")
    for b in BATCHES:
        put(spark, path, b, recording.INPUT)
    rows = recording.recorded(stream(spark, path, recording.INPUT), depth=5, late="500 milliseconds")
    q = rows.writeStream.format("memory").queryName("recorded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    found = spark.table("recorded").collect()
    got = {(r.symbol, r.tick): (r.ts_ns, r.u) for r in found if r.row == "book"}
    want = batch_ticks(spark, [x for b in BATCHES for x in b])
    last = max(t for s, t in want if s == "A")
    assert {k: v for k, v in got.items() if k[0] == "A"} == {k: v for k, v in want.items() if k[0] == "A" and k[1] < last}
    quiet = {("B", t): (1050 * MS, 1) for t in range(10, 34)}  # timers tell them up to the watermark, 3990 - 500 ms
    assert {k: v for k, v in got.items() if k[0] == "B"} == quiet and want["B", 10] == quiet["B", 10]
    assert ("A", 15) in got and ("A", 17) not in got and len(got) == sum(r.row == "book" for r in found)
    assert sorted(r.agg_trade_id for r in found if r.row == "trade") == [2, 3, 5]
    assert [(r.symbol, r.kind, r.rows) for r in recording.late_counts(spark.table("recorded")).collect()] == [("A", "trade", 1)]
    assert [r.state for r in found if r.row == "sync" and r.symbol == "A"] == ["SYNCING", "LIVE", "RESYNCING", "BUFFERING", "SYNCING", "LIVE"]


def test_feed_to_lake_exactly_once_over_a_restart(states, tmp_path):
    spark, path = states, str(tmp_path / "in")
    books = [{"at": 1700000000050, "m": json.dumps({"lastUpdateId": 1000, "bids": [["50000.0", "1.5"], ["49999.9", "2.0"]], "asks": [["50000.1", "1.2"]]})}]
    diffs = [{"e": "depthUpdate", "E": 1700000000100 + 100 * k, "s": "BTCUSDT", "U": 998 + 5 * k, "u": 1002 + 5 * k, "pu": 997 + 5 * k, "b": [["50000.0", f"1.{k}"]], "a": []} for k in range(4)]
    trades = [{"T": 1700000000120 + 100 * k, "s": "BTCUSDT", "p": "50000.1", "q": "0.5", "m": k % 2 == 0, "a": k} for k in range(-1, 4)]
    far = [{**diffs[-1], "E": 1700000060000, "U": 1018, "u": 1019, "pu": 1017}]
    schema = "kind string, at long, value string"
    put(spark, path, [("book", b["at"], b["m"]) for b in books] + [("diff", None, json.dumps(d)) for d in diffs[:2]] + [("trade", None, json.dumps(t)) for t in trades[:3]], schema)

    def run():
        lines = stream(spark, path, schema)
        part = lambda kind: lines.where(F.col("kind") == kind)
        events = (
            feeds.book_rows(part("book").select("at", F.from_json("value", schemas.BOOK_EVENT).alias("event")), "BTCUSDT"),
            feeds.depth_rows(feeds.decode(part("diff"), schemas.DEPTH_EVENT)), feeds.trade_rows(feeds.decode(part("trade"), schemas.TRADE_EVENT)),
        )
        for q in reports.record(*events, str(tmp_path / "lake"), str(tmp_path / "checkpoint"), depth=10, late="1 second", interval="0 seconds"):
            q.processAllAvailable()
            q.stop()

    run()
    put(spark, path, [("diff", None, json.dumps(d)) for d in diffs[2:]] + [("trade", None, json.dumps(t)) for t in trades[3:]], schema)
    run()
    put(spark, path, [("diff", None, json.dumps(d)) for d in far], schema)
    run()
    run()
    read = lambda name: spark.read.parquet(str(tmp_path / "lake" / name)).collect()
    assert sorted(r.agg_trade_id for r in read("trades")) == [0, 1, 2, 3]
    snapshots = sorted((r.ts_ns, r.u) for r in read("snapshots"))
    assert len(snapshots) == 599 and [s for s in snapshots if s[1] < 1017] == [(d["E"] * MS, d["u"]) for d in diffs[:3]]
    assert {(str(r.date), int(r.hour)) for r in read("snapshots")} == {("2023-11-14", 22)}
    assert [r.state for r in read("notes")] in (["SYNCING", "LIVE"], ["LIVE", "SYNCING"])


def test_live_asof_equals_the_batch(states, tmp_path):
    spark, rng = states, random.Random(6)
    at = lambda lo: rng.randrange(lo, lo + 40) * 100 * MS
    trades = [[(rng.choice("ABC"), at(40 * k), rng.randrange(1000), 5) for _ in range(30)] for k in range(4)]
    snaps = [[(rng.choice("AB"), at(40 * k), n, n, n + 1) for n in range(100 * k, 100 * k + 12)] for k in range(4)]
    trades[0] += [("A", None, 1, 1), (None, 5, 1, 1)]
    trades[3] += [("A", 100 * MS, 777, 5)]
    snaps[3] += [("A", 100 * MS, 888, 1, 2)]
    t_schema, s_schema = "symbol string, ts_ns long, agg_trade_id long, price_ticks long", "symbol string, ts_ns long, u long, best_bid_ticks long, best_ask_ticks long"
    far = 10**6 * MS
    for k in range(5):
        put(spark, str(tmp_path / "t"), trades[k] if k < 4 else [("Z", far, 0, 0)], t_schema)
        put(spark, str(tmp_path / "s"), snaps[k] if k < 4 else [("Z", far, 0, 0, 0)], s_schema)
    for age in (None, 500 * MS):
        found = feeds.live_asof(stream(spark, str(tmp_path / "t"), t_schema), stream(spark, str(tmp_path / "s"), s_schema), "5 seconds", age)
        q = found.writeStream.format("memory").queryName("matched").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{age}")).start()
        q.processAllAvailable()
        state = [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
        q.stop()
        rows = spark.table("matched").collect()
        got = sorted((r.symbol, r.trade_ns, r.agg_trade_id, r.snap_ns or -1, r.snap_u or -1) for r in rows if r.kind == "match")
        t = spark.createDataFrame([x for b in trades for x in b if None not in x and x[2] != 777], t_schema)
        s = spark.createDataFrame([x for b in snaps for x in b if x[2] != 888], s_schema)
        batch = asof_backward(t, s, [], max_age_ns=age).collect()
        assert got == sorted((r.symbol, r.ts_ns, r.agg_trade_id, r.snap.ts_ns if r.snap else -1, (r.snap.u or -1) if r.snap else -1) for r in batch)
        assert sorted((r.kind, r.agg_trade_id, r.snap_u) for r in rows if r.kind != "match") == [("late_snapshot", None, 888), ("late_trade", 777, None)]
        assert state[-1] < 60


def test_bad_lines_are_counted_per_trigger(states, tmp_path):
    spark, path = states, str(tmp_path / "in")
    good = json.dumps({"T": 5, "p": "1", "q": "2"})
    put(spark, path, [(good,), ("{oops",), (None,)], "value string")
    put(spark, path, [(good,), (good,)], "value string")
    put(spark, path, [("[1]",)], "value string")
    counts, said = feeds.FeedCounts("trades"), []
    counts.warn = said.append
    spark.streams.addListener(counts)
    rows = feeds.trade_rows(feeds.decode(stream(spark, path, "value string"), schemas.TRADE_EVENT, "trades"), symbol="S")
    q = rows.writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    per = [feeds.feed_counts(p, "trades") for p in q.recentProgress if p.numInputRows]
    assert per == [(3, 2), (2, 0), (1, 1)] and spark.table("decoded").count() == 3
    for _ in range(50):
        if len(counts.triggers) >= 3:
            break
        time.sleep(0.1)
    spark.streams.removeListener(counts)
    assert (counts.lines, counts.bad, len(said)) == (6, 3, 2)
