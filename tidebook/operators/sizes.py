"""Trade sizes: the bucket table and the hourly heat maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions import expressions as X


def bucket_dimension(spark: SparkSession) -> DataFrame:
    """(bucket, label, position) of the fixed size buckets."""
    rows = [(name, X.bucket_label(low, high), k) for k, (name, low, high) in enumerate(X.SIZE_BUCKETS)]
    return spark.createDataFrame(rows, "bucket string, label string, position int")


def size_table(trades: DataFrame) -> DataFrame:
    """Per size bucket: trades, volume, shares, running shares, mean and largest; empty buckets stay."""
    lots = F.col("qty_lots")
    own = trades.groupBy(X.size_bucket(lots).alias("bucket")).agg(F.count("*").alias("trades"), F.sum(lots).alias("lots"), F.max(lots).alias("top"))
    dim = bucket_dimension(trades.sparkSession)
    rows = dim.join(own, "bucket", "left").fillna(0, ["trades", "lots", "top"])
    running, whole = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # seven rows
    n, q = F.sum("trades").over(whole), F.sum("lots").over(whole)
    btc = X.lots_to_qty(F.col("lots"))
    return rows.select(
        "bucket", "label", "trades", X.safe_pct(F.col("trades"), n).alias("pct"), X.safe_pct(F.sum("trades").over(running), n).alias("cum_pct"), F.bround(btc, 3).alias("btc"),
        X.safe_pct(F.col("lots"), q).alias("btc_pct"), X.safe_pct(F.sum("lots").over(running), q).alias("cum_btc_pct"), F.bround(F.coalesce(F.try_divide(btc, F.col("trades")), F.lit(0.0)), 4).alias("avg_btc"), F.bround(X.lots_to_qty(F.col("top")), 4).alias("max_btc"),
    )


def hourly_heatmap(trades: DataFrame, volume: bool = False) -> DataFrame:
    """Rows per size bucket, a column h00 to h23 per UTC hour: counts, or volume rounded to one place.
    All buckets and hours are there; the hour columns are listed, so no job looks for them."""
    value = [F.sum(F.when(F.col("hour") == h, F.col("qty_lots") if volume else F.lit(1))).alias(f"h{h:02d}") for h in range(24)]
    own = trades.select(X.size_bucket(F.col("qty_lots")).alias("bucket"), X.hour_of(F.col("ts_ns")).alias("hour"), "qty_lots").groupBy("bucket").agg(*value)
    rows = bucket_dimension(trades.sparkSession).select("bucket").join(own, "bucket", "left").fillna(0)
    if volume:
        return rows.select("bucket", *(F.bround(X.lots_to_qty(F.col(f"h{h:02d}")), 1).alias(f"h{h:02d}") for h in range(24)))
    return rows
