"""Quality checks: gaps in time and ids, spreads, completeness, resyncs, plausibility and the daily verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import expressions as X
from tidebook.functions.expressions import NS_HOUR, whole
from tidebook.operators.asof import next_after, previous
from tidebook.storage import cut

ID_BUCKET = 1_000_000


def time_gaps(snapshots: DataFrame, keys: list[str], bucket_ns: int = NS_HOUR) -> DataFrame:
    """(keys, ts_ns, prev_ts_ns, delta_ms) of each snapshot; the first of a key has no predecessor."""
    rows = snapshots.select(*keys, "ts_ns", "u")
    found = previous(rows, ["ts_ns"], ["ts_ns", "u"], keys, whole(F.col("ts_ns"), bucket_ns))
    return found.select(*keys, "ts_ns", F.col("prev.ts_ns").alias("prev_ts_ns"), X.ns_to_ms(F.col("ts_ns") - F.col("prev.ts_ns")).alias("delta_ms"))


def gap_report(snapshots: DataFrame, keys: list[str], interval_ms: float = 100, tolerance_ms: float = 50) -> DataFrame:
    """Per key: snapshots, gaps (steps beyond interval + tolerance), the longest, their sum, and both readings of
    completeness: by gap time (it can fall below 0), and by count over the span (100 at most)."""
    gap = F.col("delta_ms") > interval_ms + tolerance_ms
    rows = time_gaps(snapshots, keys).groupBy(*keys).agg(
        F.count("*").alias("snapshots"), F.count_if(gap).alias("gaps"), F.coalesce(F.max(F.when(gap, F.col("delta_ms"))), F.lit(0.0)).alias("max_gap_ms"), F.coalesce(F.sum(F.when(gap, F.col("delta_ms"))), F.lit(0.0)).alias("gap_ms"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")
    )
    by_time = 100 * (1 - F.col("gap_ms") / (F.col("snapshots") * interval_ms))
    by_count = F.when(F.col("snapshots") < 2, 0.0).otherwise(F.coalesce(F.least(F.lit(100.0), F.try_divide(100.0 * F.col("snapshots"), X.ns_to_ms(F.col("last_ns") - F.col("first_ns")) / interval_ms)), F.lit(100.0)))
    return rows.select(*keys, "snapshots", "gaps", "max_gap_ms", (F.col("gap_ms") / 1000).alias("total_gap_s"), by_time.alias("completeness_by_time"), by_count.alias("completeness_by_count"))


def largest_gaps(snapshots: DataFrame, keys: list[str], interval_ms: float = 100, tolerance_ms: float = 50, top: int = 10) -> DataFrame:
    """The ``top`` longest gaps: start, end and length."""
    rows = time_gaps(snapshots, keys).where(F.col("delta_ms") > interval_ms + tolerance_ms)
    return rows.orderBy(F.desc("delta_ms"), *keys, "ts_ns").limit(top).select(*keys, F.col("prev_ts_ns").alias("start_ns"), F.col("ts_ns").alias("end_ns"), "delta_ms")


def id_bitmaps(rows: DataFrame, keys: list[str], id_col: str = "agg_trade_id") -> DataFrame:
    """(keys, bucket, n, first_id, last_id, bits): the ids of each range of 32,768 as a bitmap, n counting repeats. Tasks
    combine their rows before the shuffle, so what is sent is bitmaps. Ids of 0 and null are no ids: they give a row
    with a null bucket and n = 0."""
    some = F.when(F.col(id_col) > 0, F.col(id_col))
    marked = rows.select(*keys, some.alias("_id"))
    return marked.groupBy(*keys, F.bitmap_bucket_number("_id").alias("bucket")).agg(
        F.count("_id").alias("n"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"), F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits")
    )


def id_gaps(trades: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, missing): ranges of absent ids, start included, end not. Ids of 0 and null are no ids.

    Ids are read back from bitmaps where these stand: one row for a range without holes, else one for each byte of
    eight ids and for each id of the others."""
    maps = id_bitmaps(trades, keys).where("bucket is not null")
    base = (F.col("bucket") - 1) * 32768 + 1
    holes = F.bitmap_count("bits") < F.col("last_id") - F.col("first_id") + 1
    octets = F.expr("transform(sequence(1, 4096), k -> named_struct('at', 8 * (k - 1), 'set', cast(conv(hex(substring(bits, k, 1)), 16, 10) as int)))")
    octets = F.when(holes, F.filter(octets, lambda x: x["set"] > 0)).otherwise(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("set"))))
    spread = maps.select(*keys, "bucket", "first_id", "last_id", base.alias("base"), F.explode(octets).alias("o"))
    low, high = F.col("base") + F.col("o.at"), F.col("base") + F.col("o.at") + 7
    whole_run = F.array(F.struct(F.col("first_id").alias("low"), F.col("last_id").alias("high")))
    full = F.array(F.struct(low.alias("low"), high.alias("high")))
    single = F.expr("transform(filter(sequence(0, 7), b -> shiftright(o.set, b) & 1 = 1), b -> named_struct('low', base + o.at + b, 'high', base + o.at + b))")
    runs = F.when(F.col("o.at") < 0, whole_run).when(F.col("o.set") == 255, full).otherwise(single)
    found = previous(spread.select(*keys, "bucket", F.inline(runs)), ["high"], ["low"], keys, F.col("bucket"))
    missing = F.col("low") - F.col("prev.high") - 1
    return found.where(missing > 0).select(*keys, (F.col("prev.high") + 1).alias("start"), F.col("low").alias("end"), missing.alias("missing"))


def id_report(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ids, distinct ids, duplicates, first, last, expected, missing ids, gap ranges, and completeness from
    all ids (beyond 100 with duplicates). Without ids: -1 for the counts of gaps, null for the rest."""
    own = id_bitmaps(trades, keys).groupBy(*keys).agg(
        F.sum("n").alias("ids"), F.sum(F.bitmap_count("bits")).alias("unique_ids"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")
    )
    ranges = id_gaps(trades, keys).groupBy(*keys).agg(F.count("*").alias("gap_ranges"))
    some, expected = F.col("ids") > 0, F.col("last_id") - F.col("first_id") + 1
    return own.join(ranges, keys, "left").select(
        *keys,
        "ids",
        "unique_ids",
        (F.col("ids") - F.col("unique_ids")).alias("duplicates"),
        "first_id",
        "last_id",
        expected.alias("expected"),
        F.when(some, expected - F.col("unique_ids")).otherwise(-1).alias("missing_ids"),
        F.when(some, F.coalesce("gap_ranges", F.lit(0))).otherwise(-1).alias("gap_ranges"),
        F.when(F.col("ids") < 2, 100.0).otherwise(100.0 * F.col("ids") / expected).alias("completeness"),
    )


def file_id_gaps(trades: DataFrame, file: Column, keys: list[str]) -> DataFrame:
    """Per key: files with ids, gaps between files' id ranges and the ids missing in them, from one (min, max, count)
    per file."""
    files = trades.where("agg_trade_id > 0").withColumn("_file", file).groupBy(*keys, "_file").agg(F.min("agg_trade_id").alias("low"), F.max("agg_trade_id").alias("high"), F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("low", "high")
    step = F.col("low") - F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("step", step).groupBy(*keys).agg(F.count("*").alias("files"), F.sum("n").alias("ids"), F.count_if(F.col("step") > 1).alias("gap_ranges"), F.coalesce(F.sum(F.when(F.col("step") > 1, F.col("step") - 1)), F.lit(0)).alias("missing_between_files"))


def spread_report(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Crossed and zero spreads, and min, max and mean of the positive ones (0 if there is none)."""
    s = F.col("best_ask_ticks") - F.col("best_bid_ticks")
    fine = F.when(s > 0, s)
    return snapshots.groupBy(*keys).agg(F.count_if(s < 0).alias("crossed"), F.count_if(s == 0).alias("zero"), F.coalesce(F.min(fine), F.lit(0)).alias("min_spread"), F.coalesce(F.max(fine), F.lit(0)).alias("max_spread"), F.coalesce(F.avg(fine), F.lit(0.0)).alias("avg_spread"))


def crossed_books(snapshots: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """The first ``top`` snapshots whose bid is above the ask."""
    return snapshots.where("best_ask_ticks < best_bid_ticks").orderBy("ts_ns", "u").limit(top).select(*keys, "ts_ns", "u", "best_bid_ticks", "best_ask_ticks")


def span(snapshots: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """First and last time over both tables, and the hours between."""
    both = snapshots.select(*keys, "ts_ns").unionByName(trades.select(*keys, "ts_ns"))
    return both.groupBy(*keys).agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), ((F.max("ts_ns") - F.min("ts_ns")) / F.lit(float(NS_HOUR))).alias("duration_h"))


def compare_ids(local: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: distinct ids of a local and a reference table, how many each lacks of the other, completeness. Both
    come as bitmaps; what they share is the bits that both maps of a range have."""
    sides = [id_bitmaps(rows, keys).where("bucket is not null").select(*keys, "bucket", "bits", F.lit(k).alias("side")) for k, rows in enumerate((local, reference))]
    size = F.bitmap_count("bits")
    ranges = sides[0].unionByName(sides[1]).groupBy(*keys, "bucket").agg(
        F.coalesce(F.sum(F.when(F.col("side") == 0, size)), F.lit(0)).alias("here"),
        F.coalesce(F.sum(F.when(F.col("side") == 1, size)), F.lit(0)).alias("there"),
        F.when(F.count("*") == 2, F.bitmap_count(F.bitmap_and_agg("bits"))).otherwise(0).alias("both"),
    )
    rows = ranges.groupBy(*keys).agg(F.sum("here").alias("local_ids"), F.sum("there").alias("reference_ids"), F.sum("both").alias("both"))
    rows = rows.select(*keys, "local_ids", "reference_ids", (F.col("reference_ids") - F.col("both")).alias("missing_here"), (F.col("local_ids") - F.col("both")).alias("extra_here"))
    return rows.withColumn("completeness", F.when(F.col("reference_ids") == 0, 100.0).otherwise(100 * (1 - F.col("missing_here") / F.col("reference_ids"))))


def cross_check(asked: DataFrame, reference: DataFrame) -> DataFrame:
    """Each asked id (symbol, agg_trade_id, price_ticks, qty_lots) against the reference: verified, mismatch or
    not_found."""
    other = reference.select("symbol", "agg_trade_id", F.col("price_ticks").alias("p"), F.col("qty_lots").alias("q")).dropDuplicates(["symbol", "agg_trade_id"])
    status = F.when(F.col("p").isNull(), "not_found").when((F.col("p") == F.col("price_ticks")) & (F.col("q") == F.col("qty_lots")), "verified").otherwise("mismatch")
    return asked.join(other, ["symbol", "agg_trade_id"], "left").select("symbol", "agg_trade_id", status.alias("status"))


def edge_ids(trades: DataFrame, keys: list[str]) -> DataFrame:
    """The trades with the first and the last id of each key."""
    edges = trades.where("agg_trade_id > 0").groupBy(*keys).agg(F.min("agg_trade_id").alias("a"), F.max("agg_trade_id").alias("b"))
    return trades.join(edges, keys).where("agg_trade_id = a or agg_trade_id = b").drop("a", "b")


def plausibility(snapshots: DataFrame, keys: list[str], low: float, high: float, scale: X.Scale = X.Scale()) -> DataFrame:
    """Mean, min, max and range of the best bid as a price, and whether the mean is plausible."""
    p = X.ticks_to_price(F.col("best_bid_ticks"), scale)
    rows = snapshots.groupBy(*keys).agg(F.avg(p).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), (F.max(p) - F.min(p)).alias("price_range"))
    return rows.withColumn("price_ok", X.within(F.col("avg_price"), low, high))


def consistency(snapshots: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all prices and quantities are above 0, and how often trade time falls in the order of ids."""
    a = snapshots.groupBy(*keys).agg(F.bool_and((F.col("best_bid_ticks") > 0) & (F.col("best_ask_ticks") > 0)).alias("book_prices_ok"))
    b = trades.groupBy(*keys).agg(F.bool_and(F.col("price_ticks") > 0).alias("trade_prices_ok"), F.bool_and(F.col("qty_lots") > 0).alias("quantities_ok"))
    ordered = previous(trades.where("agg_trade_id > 0").select(*keys, "agg_trade_id", "ts_ns"), ["ts_ns"], ["agg_trade_id", "ts_ns"], keys, whole(F.col("agg_trade_id"), ID_BUCKET))
    c = ordered.groupBy(*keys).agg(F.count_if(F.col("ts_ns") < F.col("prev.ts_ns")).alias("inversions"))
    return a.join(b, keys, "full").join(c, keys, "left").withColumn("monotonic", F.coalesce("inversions", F.lit(0)) == 0)


def symbols_seen(snapshots: DataFrame, trades: DataFrame, expected: list[str]) -> DataFrame:
    """The sorted distinct symbols of both tables, and whether they are only expected ones."""
    rows = snapshots.select("symbol").union(trades.select("symbol")).distinct()
    return rows.agg(F.concat_ws(",", F.sort_array(F.collect_set("symbol"))).alias("symbols"), F.bool_and(F.col("symbol").isin(expected)).alias("only_expected"))


def source_summary(trades: DataFrame, snapshots: DataFrame, dates: DataFrame, low: float, high: float) -> DataFrame:
    """One row per asked date: id counts, price plausibility, and -1, 0 or false where the date has no data."""
    ids = id_report(trades, ["date"]).select("date", "ids", "duplicates", "missing_ids")
    price = plausibility(snapshots, ["date"], low, high).select("date", "avg_price", "price_ok")
    rows = dates.join(ids, "date", "left").join(price, "date", "left")
    return rows.select("date", F.coalesce("ids", F.lit(0)).alias("ids"), F.coalesce("duplicates", F.lit(-1)).alias("duplicates"), F.coalesce("missing_ids", F.lit(-1)).alias("missing_ids"), F.coalesce("avg_price", F.lit(0.0)).alias("avg_price"), F.coalesce("price_ok", F.lit(False)).alias("price_ok"))


def overall(summary: DataFrame) -> DataFrame:
    """Totals over dates: sums leave out the -1 of absent dates."""
    pos = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0))
    return summary.agg(F.count("*").alias("dates"), pos("missing_ids").alias("missing_ids"), pos("duplicates").alias("duplicates"), F.bool_and("price_ok").alias("all_ok"), F.avg(F.when(F.col("avg_price") > 0, F.col("avg_price"))).alias("mean_price"))


def resyncs(lines: DataFrame) -> DataFrame:
    """(date, at_s, reason, live_s) of each resync line of a log (value), with the first later LIVE line that day."""
    told = lines.select("value", X.resync_reason(F.col("value")).alias("reason"), X.is_live_line(F.col("value")).alias("live")).where("reason is not null or live")
    # read several times below, and parsing is most of the work
    rows = cut(told.select(X.log_time(F.col("value")).alias("at_s"), "reason", "live", F.substring("value", 1, 10).alias("date"))).where("at_s is not null")
    return next_after(rows.where("reason is not null").select("date", "at_s", "reason"), rows.where("live").select("date", "at_s"), "date", "at_s", "live_s")


def resync_report(found: DataFrame) -> DataFrame:
    """Per date: resyncs, a map from reason to count, and the mean seconds until LIVE (0 if none came)."""
    per = found.groupBy("date", "reason").agg(F.count("*").alias("n"), F.sum(F.col("live_s") - F.col("at_s")).alias("s"), F.count("live_s").alias("k"))
    grouped = per.groupBy("date").agg(F.sum("n").alias("resyncs"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("resync_reasons"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    return grouped.select("date", "resyncs", "resync_reasons", F.coalesce(F.try_divide("s", "k"), F.lit(0.0)).alias("mean_resync_s"))


def reason_counts(found: DataFrame) -> DataFrame:
    """(reason, n), the most frequent first, ties by reason."""
    return found.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def verdict(rows: DataFrame) -> DataFrame:
    """``rows`` (crossed, snapshot_completeness, trade_completeness, resyncs, max_gap_ms) with issues and verdict:
    HEALTHY without issues, WARNING with one or two, CRITICAL with more."""
    rules = (
        (F.col("crossed") > 0, "crossed books"), (F.col("snapshot_completeness") < 95, "snapshot completeness"), ((F.col("trade_completeness") > 0) & (F.col("trade_completeness") < 99), "trade completeness"),
        (F.col("resyncs") > 50, "resyncs"), (F.col("max_gap_ms") > 60_000, "long gap"),
    )
    issues = F.array_compact(F.array(*(F.when(test, text) for test, text in rules)))
    n = F.size("issues")
    return rows.withColumn("issues", issues).withColumn("verdict", F.when(n == 0, "HEALTHY").when(n <= 2, "WARNING").otherwise("CRITICAL"))


def daily_report(trades: DataFrame, snapshots: DataFrame, lines: DataFrame, interval_ms: float = 100, tolerance_ms: float = 50) -> DataFrame:
    """One row per (symbol, date) of both tables' rows, with the day's resyncs and the verdict."""
    keys = ["symbol", "date"]
    gaps = gap_report(snapshots, keys, interval_ms, tolerance_ms).select(*keys, "snapshots", "gaps", "max_gap_ms", F.col("completeness_by_count").alias("snapshot_completeness"))
    ids = id_report(trades, keys).select(*keys, F.col("ids").alias("trade_ids"), "gap_ranges", F.when(F.col("ids") == 0, -1.0).otherwise(F.col("completeness")).alias("trade_completeness"))
    rows = gaps.join(ids, keys, "full").join(spread_report(snapshots, keys), keys, "left").join(span(snapshots, trades, keys), keys, "left").join(resync_report(resyncs(lines)), "date", "left")
    filled = rows.fillna(0, ["snapshots", "gaps", "max_gap_ms", "snapshot_completeness", "trade_ids", "crossed", "zero", "min_spread", "max_spread", "avg_spread", "resyncs", "mean_resync_s"]).fillna(-1, ["gap_ranges", "trade_completeness"])
    return verdict(filled)
