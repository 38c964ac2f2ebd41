"""The lake's files: inventory, row counts, hour profiles, and missing parts and hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import expressions as X


def with_files(rows: DataFrame) -> DataFrame:
    """``rows`` of a file scan with file_path, file_name and part (null if the name holds none)."""
    out = rows.withColumn("file_path", F.col("_metadata.file_path")).withColumn("file_name", F.col("_metadata.file_name"))
    return out.withColumn("part", X.part_number(F.col("file_name")))


def inventory(snapshots: DataFrame, trades: DataFrame) -> DataFrame:
    """(symbol, snapshot_files, trade_files), 0 where a symbol has none of a kind."""
    a = snapshots.groupBy("symbol").agg(F.count_distinct("file_path").alias("snapshot_files"))
    b = trades.groupBy("symbol").agg(F.count_distinct("file_path").alias("trade_files"))
    return a.join(b, "symbol", "full").fillna(0)


def file_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file: rows, first and last time."""
    return rows.groupBy(*keys, "file_path", "part").agg(F.count("*").alias("rows"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def hour_profile(rows: DataFrame, keys: list[str], gap_ms: float, expected_parts: int = 60) -> DataFrame:
    """Per keys (with hour): files, rows, rows per file, span, gaps, largest step, overlapping files, and parts that
    are missing or beyond the expected number. Hours without files have no row."""
    files = file_counts(rows, keys)
    order = Window.partitionBy(*keys).orderBy("first_ns", "part")
    files = files.withColumn("overlap", F.coalesce(F.col("first_ns") < F.max("last_ns").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    per = files.groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.avg("rows").alias("avg_rows"), F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.count_if("overlap").alias("overlaps"),
        F.sort_array(F.collect_set("part")).alias("parts"), F.count_if(F.col("part") >= expected_parts).alias("extra_parts"),
    )
    step = X.ns_to_ms(F.col("ts_ns") - F.lag("ts_ns").over(Window.partitionBy(*keys).orderBy("ts_ns")))
    steps = rows.select(*keys, "ts_ns").withColumn("step_ms", step).groupBy(*keys).agg(F.count_if(F.col("step_ms") > gap_ms).alias("gaps"), F.coalesce(F.max("step_ms"), F.lit(0.0)).alias("max_step_ms"))
    missing = F.when(F.size("parts") == 0, F.lit(0)).otherwise(F.size(F.array_except(F.sequence(F.lit(0), F.array_max("parts")), F.col("parts"))))
    return per.join(steps, keys).select(*keys, "files", "rows", "avg_rows", "min_rows", "max_rows", ((F.col("last_ns") - F.col("first_ns")) / 6e10).alias("duration_min"), "gaps", "max_step_ms", "overlaps", missing.alias("missing_parts"), "extra_parts")


def compare_two_hours(profile: DataFrame, keys: list[str], a: str = "01", b: str = "02") -> DataFrame:
    """Files and rows of two hours side by side, and the ratio of files."""
    per = profile.where(F.col("hour").isin(a, b)).groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("hour") == h, F.col(c))), F.lit(0)).alias(f"{c}_{h}") for h in (a, b) for c in ("files", "rows")))
    return per.withColumn("file_ratio", F.try_divide(F.col(f"files_{a}"), F.col(f"files_{b}")))


def fragmentation(compared: DataFrame, times: float = 5.0, a: str = "01", b: str = "02") -> DataFrame:
    """Mean files of the two hours over dates, and whether the first has more than ``times`` as many."""
    rows = compared.agg(F.avg(f"files_{a}").alias("avg_files_a"), F.avg(f"files_{b}").alias("avg_files_b"))
    return rows.withColumn("fragmented", F.col("avg_files_a") > times * F.col("avg_files_b"))


def missing_hours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hour): hours 00 to 23 without a row, for each key that has any."""
    seen = rows.select(*keys, "hour").distinct()
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.lpad(h.cast("string"), 2, "0"))
    return seen.select(*keys).distinct().withColumn("hour", F.explode(hours)).join(seen, [*keys, "hour"], "left_anti")
