"""Whole jobs: each takes tables and returns its result tables by name; ``save`` writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.functions import expressions as X
from tidebook.operators import calibration, layout, mismatch, penetration, quality, selection, sizes
from tidebook.sources import sinks
from tidebook.storage import cut
from tidebook.streaming import recording


def _dated(rows: DataFrame) -> DataFrame:
    return rows if "date" in rows.columns else rows.withColumn("date", X.date_of(F.col("ts_ns")))


def penetration_report(trades: DataFrame, snapshots: DataFrame, max_level: int = 1000, accuracy: int | None = None) -> dict[str, DataFrame]:
    """Matched trades with their levels, written once for all tables, exceedance in all and per side, and percentiles
    (exact, or approximate with ``accuracy``)."""
    found = cut(penetration.penetrations(trades, snapshots, max_level))
    return {
        "penetrations": found,
        "summary": penetration.threshold_summary(found, None, max_level),
        "by_side": penetration.threshold_summary(found, ["side"], max_level),
        "percentiles": selection.percentiles(found, "penetration_level", accuracy=accuracy),
        "unmatched": trades.agg(F.count("*").alias("trades")).crossJoin(F.broadcast(found.agg(F.count("*").alias("matched")))).withColumn("skipped", F.col("trades") - F.col("matched")),
    }


def level_report(trades: DataFrame, snapshots: DataFrame, accuracy: int | None = None) -> dict[str, DataFrame]:
    """The level table and level percentiles, overflow one beyond the stored levels."""
    found = cut(penetration.penetrations(trades, snapshots, None))
    return {"level_table": penetration.level_table(found), "percentiles": selection.percentiles(found, "penetration_level", accuracy=accuracy)}


def size_report(trades: DataFrame, accuracy: int | None = None) -> dict[str, DataFrame]:
    """The size table, heat maps and size percentiles."""
    return {
        "size_table": sizes.size_table(trades),
        "heatmap": sizes.hourly_heatmap(trades),
        "volume_heatmap": sizes.hourly_heatmap(trades, volume=True),
        "percentiles": selection.percentiles(trades, "qty_lots", accuracy=accuracy),
    }


def calibration_report(trades: DataFrame, snapshots: DataFrame, by: tuple[str, ...] = ("symbol", "date"), **options) -> dict[str, DataFrame]:
    """The offset curve of every symbol and date, and its statistics."""
    curve = calibration.calibrate(_dated(trades), _dated(snapshots), list(by), **options)
    return {"curve": curve, "statistics": calibration.curve_statistics(curve, list(by))}


def healing_report(trades: DataFrame, snapshots: DataFrame, curve: DataFrame, by: tuple[str, ...] = ("symbol", "date"), sample: int | None = None) -> dict[str, DataFrame]:
    """Healed snapshots, outside rates before and after, and totals. ``sample`` verifies on so many trades."""
    snapshots, trades = _dated(snapshots), _dated(trades)
    healed = calibration.heal(snapshots, curve, list(by))
    verified = calibration.verify_healing(trades if sample is None else mismatch.sample(trades, sample), snapshots, healed, ["symbol"])
    totals = healed.agg(F.count("*").alias("snapshots"), F.count_distinct(*by).alias("groups"), F.count_if(F.col("offset_applied_ns") != 0).alias("moved"))
    return {"healed": healed, "verified": verified, "totals": totals.crossJoin(F.broadcast(verified.agg(F.avg("improvement").alias("mean_improvement"))))}


def mismatch_report(trades: DataFrame, snapshots: DataFrame, over: int = 500) -> dict[str, DataFrame]:
    """Matches, statistics, large deviations, the hourly profile and the window sweep."""
    found = mismatch.match_spread(trades, snapshots)
    return {"matches": found, "report": mismatch.report(found), "large": mismatch.large(found, over), "by_hour": mismatch.by_hour(found), "sweep": mismatch.window_sweep(trades, snapshots)}


def validation_report(trades: DataFrame, snapshots: DataFrame, reference: DataFrame | None = None, interval_ms: float = 100, tolerance_ms: float = 50) -> dict[str, DataFrame]:
    """Gaps, ids, spreads and, with reference trades, the comparison of ids, per symbol and date."""
    keys, trades, snapshots = ["symbol", "date"], _dated(trades), _dated(snapshots)
    out = {
        "gaps": quality.gap_report(snapshots, keys, interval_ms, tolerance_ms), "largest_gaps": quality.largest_gaps(snapshots, keys, interval_ms, tolerance_ms), "ids": quality.id_report(trades, keys),
        "first_id_gaps": quality.id_gaps(trades, keys).orderBy("start", *keys).limit(10), "spreads": quality.spread_report(snapshots, keys), "crossed": quality.crossed_books(snapshots, keys),
    }
    if reference is not None:
        out["reference"] = quality.compare_ids(trades, _dated(reference), keys)
    return out


def source_report(trades: DataFrame, snapshots: DataFrame, dates: DataFrame, expected: list[str], low: float = 70_000, high: float = 120_000, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """The summary of the asked dates, the overall view, consistency, symbols and the cross check of edge ids."""
    trades, snapshots = _dated(trades), _dated(snapshots)
    summary = quality.source_summary(trades, snapshots, dates, low, high)
    out = {"summary": summary, "overall": quality.overall(summary), "consistency": quality.consistency(snapshots, trades, ["date"]), "symbols": quality.symbols_seen(snapshots, trades, expected)}
    if reference is not None:
        out["cross_check"] = quality.cross_check(quality.edge_ids(trades, ["symbol", "date"]), reference)
    return out


def daily_report(trades: DataFrame, snapshots: DataFrame, lines: DataFrame, **options) -> dict[str, DataFrame]:
    """One row per symbol and date with its verdict."""
    return {"daily": quality.daily_report(_dated(trades), _dated(snapshots), lines, **options)}


def hour_report(snapshots: DataFrame, trades: DataFrame) -> dict[str, DataFrame]:
    """File profiles of every hour, hour 01 against 02, fragmentation and missing hours; rows come from with_files."""
    keys = ["symbol", "date", "hour"]
    a, b = layout.hour_profile(snapshots, keys, 200), layout.hour_profile(trades, keys, 1000)
    compared = layout.compare_two_hours(a, ["symbol", "date"])
    return {"snapshot_hours": a, "trade_hours": b, "compared": compared, "fragmentation": layout.fragmentation(compared), "missing_hours": layout.missing_hours(snapshots, ["symbol", "date"])}


def record(books: DataFrame, differences: DataFrame, trades: DataFrame, root: str, checkpoint: str, depth: int = 1000, late: str = "10 seconds", interval: str = "60 seconds") -> list[StreamingQuery]:
    """Start recording three live feeds (feeds.book_rows, depth_rows and trade_rows) into the lake: a book a tick while
    the book is LIVE, the trades that meet a LIVE book, and notes of state changes and late rows."""
    return recording.start(recording.merged(books, differences, trades), root, checkpoint, depth, late=late, interval=interval)


def save(tables: dict[str, DataFrame], root: str, csv: tuple[str, ...] = ()) -> None:
    """Write every table of a report below ``root``; those named in ``csv`` also as CSV."""
    for name, rows in tables.items():
        sinks.write_result(rows, f"{root}/{name}", csv=name in csv)
