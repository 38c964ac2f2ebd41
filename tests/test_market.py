import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.functions import expressions as X
from tidebook.operators import asof, calibration, layout, mismatch, penetration, quality, sizes
from tidebook.plans import market_queries
from tidebook.sources import lake, market, sinks
from tidebook.streaming import feeds

FAST = [n for n in market_queries.ORACLE_SQL if n not in ("a31_fragmentation", "s14_inventory")]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("events", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def same(x):
    if isinstance(x, float):
        return f"{x:.8g}"
    return str(float(x)) if type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, sf, name):
    df = market_queries.QUERIES[name](spark, sf)
    cursor = duck.execute(market_queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted([same(r[columns.index(c)]) for c in sorted(columns)] for r in cursor.fetchall())
    got = sorted([same(r[c]) for c in sorted(columns)] for r in df.collect())
    assert got == want


def test_penetration_values(spark):
    book = [100] * 5 + [0] * 995
    rows = [(q, book) for q in (50, 100, 150, 500, 600, 0, -1)] + [(150, [100, 0, 0, 100, 100]), (1, [])]
    got = [r.n for r in spark.createDataFrame(rows, "q long, l array<long>").select(X.penetration_level(F.col("q"), F.col("l")).alias("n")).collect()]
    assert got == [1, 1, 2, 5, 1001, 1, 1, 4, 1001]


def test_rounding_is_half_even(spark):
    r = spark.createDataFrame([(0.25, 0.0005), (0.35, 0.0015)], "p double, q double").select(X.price_to_ticks(F.col("p")).alias("t"), X.qty_to_lots(F.col("q")).alias("l")).collect()
    assert [(x.t, x.l) for x in r] == [(2, 0), (4, 2)]


@pytest.mark.parametrize("bucket_ns", [1, 7, 1000])
def test_bucket_size_does_not_change_the_match(spark, bucket_ns):
    s = spark.createDataFrame([("A", t, u) for t, u in ((5, 1), (5, 2), (9, 3), (900, 4))] + [("B", 3, 1)], "symbol string, ts_ns long, u long")
    t = spark.createDataFrame([("A", x) for x in (1, 5, 6, 9, 899, 900, 5000)] + [("B", 2), ("B", 4), ("C", 4), (None, 4), ("A", None)], "symbol string, ts_ns long")
    got = {(r.symbol, r.ts_ns): r.snap.u if r.snap else None for r in asof.asof_backward(t, s, [], bucket_ns).collect()}
    assert got == {("A", 1): None, ("A", 5): 2, ("A", 6): 2, ("A", 9): 3, ("A", 899): 3, ("A", 900): 4, ("A", 5000): 4, ("B", 2): None, ("B", 4): 1, ("C", 4): None, (None, 4): None, ("A", None): None}
    old = {r.ts_ns: r.snap for r in asof.asof_backward(t.where("symbol = 'A' and ts_ns = 5000"), s, [], bucket_ns, max_age_ns=100).collect()}
    assert old == {5000: None}


def test_offset_search_equals_brute_force(spark, sf):
    t, s = market.trades(spark, sf).limit(150).cache(), market.snapshots(spark, sf).select("symbol", "ts_ns", "u", "best_bid_ticks", "best_ask_ticks").cache()
    hour = 3_600_000
    got = {(r.symbol, r.offset_ms): r.outside for r in calibration.outside_rates(t, s, ["symbol"], 3 * hour, hour, 2 * X.NS_HOUR).collect()}
    books = {}
    for r in sorted(s.collect(), key=lambda r: (r.ts_ns, r.u)):
        books.setdefault(r.symbol, []).append(r)
    want = {}
    for r in t.collect():
        for o in range(-3 * hour, 3 * hour + 1, hour):
            before = [b for b in books.get(r.symbol, []) if b.ts_ns + o * 1_000_000 <= r.ts_ns]
            hit = bool(before) and not before[-1].best_bid_ticks <= r.price_ticks <= before[-1].best_ask_ticks
            want[r.symbol, o] = want.get((r.symbol, o), 0) + hit
    assert got == want


def test_flat_curve_heals_nothing_and_halfway_is_interpolated(spark):
    s = spark.createDataFrame([("A", t, t) for t in (0, 100, 150, 200, 900)] + [("B", 5, 5)], "symbol string, ts_ns long, u long")
    curve = spark.createDataFrame([("A", 50, 150, 1.0), ("A", 150, 250, 3.0)], "symbol string, window_start_ns long, window_end_ns long, optimal_offset_ms double")
    moved = {r.u: r.offset_applied_ns for r in calibration.heal(s, curve, ["symbol"]).collect()}
    assert moved == {0: 1_000_000, 100: 1_000_000, 150: 2_000_000, 200: 3_000_000, 900: 3_000_000, 5: 0}
    still = calibration.heal(s, curve.withColumn("optimal_offset_ms", F.lit(0.0)), ["symbol"]).collect()
    assert all(r.ts_ns == r.ts_ns_original for r in still)


def test_summaries_agree(spark, sf):
    found = penetration.penetrations(market.trades(spark, sf), market.snapshots(spark, sf), 50).cache()
    rows = sorted(penetration.threshold_summary(found, None, 50, (1, 5, 20)).collect(), key=lambda r: r.threshold)
    counts = [r.trades_exceeding for r in rows]
    assert counts == sorted(counts, reverse=True)
    assert sum(r.trades for r in penetration.level_table(found).collect()) == found.count()
    sides = penetration.threshold_summary(found, ["side"], 50).groupBy("threshold").agg(F.sum("trades_exceeding").alias("n")).collect()
    assert {r.threshold: r.n for r in sides} == {r.threshold: r.trades_exceeding for r in penetration.threshold_summary(found, None, 50).collect()}
    assert sum(r.trades for r in sizes.size_table(market.trades(spark, sf)).collect()) == market.trades(spark, sf).count()
    sample = mismatch.sample(market.trades(spark, sf), 10)
    assert sample.count() == 10 and sorted(sample.collect()) == sorted(mismatch.sample(market.trades(spark, sf), 10).collect())


def test_lake_round_trip(spark, sf, tmp_path):
    root = str(tmp_path / "lake")
    t = market.trades(spark, sf).where("ts_ns < 1704240000000000000")
    feeds.write_lake(t, f"{root}/trades")
    back = lake.read_table(spark, root, "trades")
    assert back.where("symbol = 'S1'").count() == t.where("symbol = 'S1'").count() == lake.read_table(spark, root, "trades", symbol="S1").count()
    assert set(lake.read_table(spark, root, "trades", date="2024-01-01").select("date").distinct().collect()) == {("2024-01-01",)}
    assert dict(back.dtypes)["hour"] == "string"
    plan = lake.read_table(spark, root, "trades", "S1", "2024-01-01")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan
    per_file = layout.file_counts(layout.with_files(back), ["symbol"])
    assert per_file.agg(F.sum("rows")).first()[0] == t.count() and per_file.where("part is not null").count() == per_file.count()


def test_plain_lake_and_old_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", 5, 6, True)], "ts_ns long, symbol string, price_ticks long, qty_lots long, is_buyer_maker boolean")
    rows.write.parquet(str(tmp_path / "trades/BTC/2024-01-02/hour=03"))
    r = lake.read_plain_lake(spark, str(tmp_path), "trades").first()
    assert (r.symbol, r.date, r.hour, r.agg_trade_id) == ("BTC", "2024-01-02", "03", 0)
    rows.write.parquet(str(tmp_path / "old/trades/symbol=BTC/date=2024-01-02/hour=03"))
    (tmp_path / "old/trades/symbol=BTC/date=2024-01-02/hour=03/part-bad.parquet").write_bytes(b"junk")
    got = lake.read_table(spark, str(tmp_path / "old"), "trades").collect()
    assert [(r.symbol, r.agg_trade_id, r.hour) for r in got] == [("BTC", 0, "03")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 1, {"a": 2})], "date string, n long, m map<string,long>")
    sinks.write_result(rows, str(tmp_path / "r"), csv=True)
    assert spark.read.parquet(str(tmp_path / "r.parquet")).count() == 1 and spark.read.csv(str(tmp_path / "r.csv"), header=True).first().m == '{"a":2}'
    sinks.write_reports(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().n == 1
    assert not sinks.write_csv_if_any(rows.limit(0).select("n"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        sinks.write_healed(rows, "/a", "/a/")
    curve = spark.createDataFrame([(1, 2, "t", 0.5, 0.1, 3, 4)], schemas.CALIBRATION)
    curve.write.parquet(str(tmp_path / "c.parquet"))
    curve.write.csv(str(tmp_path / "c.csv"), header=True)
    assert lake.read_calibration(spark, str(tmp_path / "c.parquet")).collect() == lake.read_calibration(spark, str(tmp_path / "c.csv")).collect()
    with pytest.raises(ValueError):
        lake.read_calibration(spark, "x.json")


def test_log_lines(spark):
    lines = ["2026-03-26 08:34:00 | WARNING  | recorder.sync | Resync triggered: sequence gap: pu=5 != prev_u=3 ", "2026-03-26 08:34:04 | INFO     | recorder.sync | Sync state transition: SYNCING -> LIVE", "noise", ""]
    found = quality.resyncs(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = quality.resync_report(found).first()
    assert (r.date, r.resyncs, r.resync_reasons, r.mean_resync_s) == ("2026-03-26", 1, {"sequence gap: pu=5 != prev_u=3": 1}, 4.0)


def test_missing_ids_and_verdict(spark):
    rows = spark.createDataFrame([("A", 0), ("A", None), ("B", 5), ("B", 5), ("B", 9)], "symbol string, agg_trade_id long")
    got = {r.symbol: r for r in quality.id_report(rows, ["symbol"]).collect()}
    assert (got["A"].missing_ids, got["A"].gap_ranges, got["B"].missing_ids, got["B"].duplicates, got["B"].gap_ranges) == (-1, -1, 3, 1, 1)
    v = spark.createDataFrame([(0, 99.0, 100.0, 0, 10.0), (1, 99.0, 98.0, 0, 10.0), (1, 90.0, -1.0, 51, 70000.0)], "crossed long, snapshot_completeness double, trade_completeness double, resyncs long, max_gap_ms double")
    assert [r.verdict for r in quality.verdict(v).collect()] == ["HEALTHY", "WARNING", "CRITICAL"]


def test_hour_profile_parts(spark):
    rows = spark.createDataFrame([("A", "01", f"f{p}", p, t) for p, t in ((0, 0), (0, 50), (2, 40), (2, 90), (61, 200))], "symbol string, hour string, file_path string, part int, ts_ns long")
    r = layout.hour_profile(rows, ["symbol", "hour"], gap_ms=0.00005).first()
    assert (r.files, r.overlaps, r.missing_parts, r.extra_parts, r.gaps) == (3, 1, 59, 1, 1)


def test_empty_tables(spark, sf):
    t, s = market.trades(spark, sf).limit(0), market.snapshots(spark, sf).limit(0)
    assert penetration.level_table(penetration.penetrations(t, s)).count() == 0
    assert sizes.size_table(t).count() == 7
    assert quality.gap_report(s, ["symbol"]).count() == 0
    assert mismatch.match_spread(t, s).count() == 0


def test_forward_frames_across_stretches(spark):
    rng = random.Random(8)
    rows = [(s, 10 * k, k, rng.randrange(50), rng.randrange(50)) for s, n in (("A", 60), ("B", 3), ("C", 1)) for k in range(n)]
    snaps = spark.createDataFrame(rows, "symbol string, ts_ns long, u long, best_bid_ticks long, best_ask_ticks long")
    want = {}
    for s in "ABC":
        own = [r for r in rows if r[0] == s]
        for k in range(len(own)):
            for w in (0, 2, 5):
                frame = own[k : k + w + 1]
                want[s, own[k][2], w] = (min(r[3] for r in frame), max(r[4] for r in frame), frame[-1][1])
    for stretch, bucket in ((1, 70), (7, 10**9), (1000, 35)):
        found = asof.forward_frames(snaps, [0, 2, 5], bucket_ns=bucket, stretch=stretch)
        got = {(r.symbol, r.u, x.w): (x.ext_bid, x.ext_ask, x.last_ts_ns) for r in found.collect() for x in r.spreads}
        assert got == want
    plan = mismatch.match_spread(snaps.selectExpr("symbol", "ts_ns", "u as agg_trade_id", "best_bid_ticks as price_ticks", "u as qty_lots"), snaps)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "collect_list" not in plan


def test_sample_takes_the_rows_of_least_hash(spark):
    trades = spark.range(5000).selectExpr("concat('S', id % 3) as symbol", "id * 7 as ts_ns", "id as agg_trade_id")
    digest = lambda i: hashlib.md5(f"S{i % 3}|{i * 7}|{i}|42".encode()).hexdigest()[:15]
    ordered = sorted(range(5000), key=digest)
    for n in (0, 1, 777, 4999, 5000, 9000):
        assert sorted(r.agg_trade_id for r in mismatch.sample(trades, n).collect()) == sorted(ordered[:n])
    assert mismatch.sample(trades.unionAll(trades), 6000).count() == 6000 and mismatch.sample(trades.limit(0), 5).count() == 0


def test_logs_reference_trades_and_reasons(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-01-01 10:00:00 | x\n2024-01-02 10:00:00 | y\n")
    assert [r.value[-1] for r in lake.read_log(spark, str(tmp_path / "a.log"), "2024-01-02").collect()] == ["y"]
    assert lake.read_log(spark, str(tmp_path / "a.log")).count() == 2
    (tmp_path / "ref.json").write_text("\n".join('{"ts_ns": %d, "symbol": "S", "agg_trade_id": %d}' % (k, k) for k in range(5)))
    assert sorted(r.agg_trade_id for r in lake.read_reference_trades(spark, str(tmp_path / "ref.json"), 1, 4).collect()) == [1, 2, 3]
    assert lake.read_reference_trades(spark, str(tmp_path / "ref.json")).count() == 5
    found = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "reason string")
    assert [tuple(r) for r in quality.reason_counts(found).collect()] == [("c", 2), ("a", 1), ("b", 1)]


def test_reports_read_only_the_columns_they_need(spark, sf, tmp_path):
    market.snapshots(spark, sf).withColumn("date", F.lit("2024-01-02")).write.parquet(str(tmp_path / "s"))
    market.trades(spark, sf).withColumn("date", F.lit("2024-01-02")).write.parquet(str(tmp_path / "t"))
    snaps, trades = spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "t"))
    read = lambda df: [x.split("ReadSchema: ")[1] for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x]
    for df in (quality.gap_report(snaps, ["symbol"]), quality.spread_report(snaps, ["symbol"]), quality.id_report(trades, ["symbol"]), asof.asof_backward(trades, snaps, [])):
        assert read(df) and not any("qty_lots:array" in x or "price_delta" in x for x in read(df))
    assert all(x == "struct<symbol:string,agg_trade_id:bigint>" for x in read(quality.id_report(trades, ["symbol"])))


def test_next_live_is_ordered_once(spark):
    """In buckets, without a frame to the end of the day for every row; ties, other dates and nulls match nothing."""
    a = [("d", 5), ("d", 5), ("d", 599), ("d", 600), ("d", 3000), ("d", 9000), ("e", 5), (None, 5), ("d", None)]
    b = [("d", 5), ("d", 600), ("d", 601), ("d", 8999), ("d", 9000), (None, 7), ("d", None)]
    rows, events = (spark.createDataFrame(x, "date string, at_s long") for x in (a, b))
    found = asof.next_after(rows, events, "date", "at_s", "live_s")
    want = [(d, s, min((t for e, t in b if d is not None and e == d and None not in (s, t) and t > s), default=None)) for d, s in a]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_offset_rates_of_dense_bins(spark):
    """Trades meet the snapshots of a bin by search, not each with each; 30,000 of both within six hours."""
    hour, n = 3_600_000, 30_000
    s = spark.range(n).selectExpr("'A' as symbol", "id * 720000000 + 1 as ts_ns", "id as u", "id % 7 as best_bid_ticks", "id % 7 + id % 3 as best_ask_ticks")
    t = spark.range(n).selectExpr("'A' as symbol", "id * 720000000 + 5 as ts_ns", "id % 11 as price_ticks")
    rates = calibration.outside_rates(t, s, ["symbol"], hour, hour // 2, 6 * X.NS_HOUR)
    want = {}
    for o in range(-hour, hour + 1, hour // 2):
        back = o * 1_000_000 // 720_000_000
        want[o] = sum(1 for k in range(n) if (j := min(k - back, n - 1)) >= 0 and not j % 7 <= k % 11 <= j % 7 + j % 3)
    assert {r.offset_ms: r.outside for r in rates.collect()} == want
    plan = rates._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "bin#" in line for line in plan.splitlines())


def test_offset_search_keeps_its_tasks(spark, capsys):
    """Adaptive merging of small partitions would leave the search to a few tasks."""
    rows = spark.createDataFrame([("A", k * 10**9, k, 5, 6, 5) for k in range(50)], "symbol string, ts_ns long, u long, best_bid_ticks long, best_ask_ticks long, price_ticks long")
    calibration.outside_rates(rows.select("symbol", "ts_ns", "price_ticks"), rows.drop("price_ticks"), ["symbol"]).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_offset_search_counts_repeated_trades_but_sends_them_once(spark, monkeypatch):
    """60 trades of one time and price, and 60 snapshots of one time, are one row each of the search."""
    minute = 60 * 10**9
    seconds = range(-150, 151, 30)  # bins before, around and after time 0
    t = spark.createDataFrame([("A", s * 10**9, 10 + s // 30 % 2) for s in seconds for _ in range(60)], "symbol string, ts_ns long, price_ticks long")
    s = spark.createDataFrame([("A", (s + 7) * 10**9, u, 9 + (u == 59) * (s % 4 > 1), 10) for s in seconds for u in range(60)], "symbol string, ts_ns long, u long, best_bid_ticks long, best_ask_ticks long")
    last = [((s + 7), 9 + (s % 4 > 1)) for s in seconds]
    want = {}
    for o in range(-90, 91, 30):
        before = [(10 + k // 30 % 2, [b for at, b in last if at <= k - o]) for k in seconds]
        want[o * 1000] = 60 * sum(bool(b) and not b[-1] <= p <= 10 for p, b in before)
    rates = lambda: {r.offset_ms: r.outside for r in calibration.outside_rates(t, s, ["symbol"], 90_000, 30_000, minute).collect()}
    assert rates() == want

    def rows(keys, offsets, bin_ns):
        return lambda table: table.select(keys).slice(0, 1).append_column("o", pa.array(offsets[:1])).append_column("hits", pa.array([table.num_rows]))

    monkeypatch.setattr(calibration, "_outside_counts", rows)
    assert rates()[-90_000] < 8 * len(seconds)
