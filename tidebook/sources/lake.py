"""Readers of the market lake. Filters and columns reach the Parquet scan; nothing is sorted here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook import schemas

_PARTS = [T.StructField("date", T.StringType()), T.StructField("hour", T.StringType())]


def read_table(spark: SparkSession, root: str, kind: str, symbol: str | None = None, date: str | None = None) -> DataFrame:
    """The snapshots or trades table of a lake by symbol=/date=/hour= folders, optionally one symbol and date.

    Files that cannot be read are skipped; columns that older files lack are null, and null or absent
    aggregate ids read as 0. Partition values stay text.
    """
    schema = schemas.SNAPSHOTS if kind == "snapshots" else schemas.TRADES
    rows = spark.read.schema(T.StructType([*schema, *_PARTS])).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{root}/{kind}")
    if kind == "trades":
        rows = _with_ids(rows)
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    return rows if date is None else rows.where(F.col("date") == date)


def _with_ids(trades: DataFrame) -> DataFrame:
    return trades.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("agg_trade_id", "first_trade_id", "last_trade_id")})


def read_plain_lake(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The same table from <root>/<kind>/<symbol>/<date>/hour=HH/: symbol, date and hour come from the path. Absent ids
    read as 0; files that cannot be read, or are gone since they were listed, are skipped."""
    schema = schemas.SNAPSHOTS if kind == "snapshots" else schemas.TRADES
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{root}/{kind}")
    path = F.col("_metadata.file_path")
    part = lambda k: F.regexp_extract(path, rf"/{kind}/([^/]+)/([^/]+)/hour=([^/]+)/", k)
    rows = rows.withColumns({"symbol": part(1), "date": part(2), "hour": part(3)})
    return _with_ids(rows) if kind == "trades" else rows


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """A calibration table from Parquet or CSV, told by the path's ending; other endings are an error."""
    if path.endswith(".csv"):
        return spark.read.schema(schemas.CALIBRATION).option("header", "true").csv(path)
    if path.endswith(".parquet"):
        return spark.read.schema(schemas.CALIBRATION).parquet(path)
    raise ValueError(f"{path}: a calibration table is .parquet or .csv")


def read_log(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Lines (value) of recorder logs, optionally those that hold a date."""
    rows = spark.read.text(path)
    return rows if date is None else rows.where(F.col("value").contains(date))


def read_reference_trades(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Reference trades landed as JSON lines of trade rows, optionally in [start_ns, end_ns)."""
    rows = spark.read.schema(schemas.TRADES).json(path)
    if start_ns is not None:
        rows = rows.where(F.col("ts_ns") >= start_ns)
    return rows if end_ns is None else rows.where(F.col("ts_ns") < end_ns)


def dates(rows: DataFrame) -> DataFrame:
    """The distinct (symbol, date) of a table."""
    return rows.select("symbol", "date").distinct()
