"""As-of matching in time buckets.

Rows are dealt by symbol and time bucket. What a bucket needs from before it starts is one row: the last
of the earlier buckets, carried in as a seed. A hot symbol is as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.expressions import NS_HOUR, whole


def carry_in(rows: DataFrame, buckets: DataFrame, value: str, order: list[str], keys: list[str], latest: bool = True) -> DataFrame:
    """(keys, bucket, value): for each of ``buckets`` the last ``value`` of ``rows`` in an earlier bucket
    (latest=False: the first in a later one). Only one row per key and bucket reaches the ordering step."""
    pick = F.max_by if latest else F.min_by
    edge = rows.groupBy(*keys, "bucket").agg(pick(value, F.struct(*order)).alias(value))
    grid = buckets.select(*keys, "bucket").distinct().join(edge, [*keys, "bucket"], "full")
    window = Window.partitionBy(*keys).orderBy("bucket" if latest else F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    return grid.select(*keys, "bucket", F.last(value, ignorenulls=True).over(window).alias(value)).where(F.col(value).isNotNull())


def asof_backward(
    trades: DataFrame, snapshots: DataFrame, columns: list[str], bucket_ns: int = NS_HOUR, offset_ns: int | Column = 0, max_age_ns: int | None = None, keys: tuple[str, ...] = ("symbol",),
    same_epoch: str | None = None,
) -> DataFrame:
    """``trades`` with a struct ``snap`` (ts_ns, u, columns) of the last snapshot at or before each trade, null
    if there is none. Among snapshots of one time the largest u is last.

    ``offset_ns`` is added to the snapshots' clock; ``max_age_ns`` makes older matches null. Repeated
    trades stay repeated. Rows with a null key or time match nothing. ``same_epoch`` names the column of both tables
    that counts resyncs: a trade then matches only snapshots of its own epoch, and none if that is null.
    """
    keys = [*keys, same_epoch] if same_epoch else list(keys)
    shifted = snapshots.select(*keys, (F.col("ts_ns") + offset_ns).alias("ts_ns"), "u", F.struct((F.col("ts_ns") + offset_ns).alias("ts_ns"), "u", *columns).alias("snap"))
    shifted = shifted.withColumn("bucket", whole(F.col("ts_ns"), bucket_ns))
    asked = trades.select(*keys, "ts_ns", whole(F.col("ts_ns"), bucket_ns).alias("bucket"), F.struct(*trades.columns).alias("trade"))
    seeds = carry_in(shifted, asked, "snap", ["ts_ns", "u"], keys)
    none = F.lit(None)
    rows = (
        shifted.select(*keys, "bucket", "ts_ns", "u", "snap", F.lit(0).alias("kind"))
        .unionByName(seeds.select(*keys, "bucket", F.col("snap.ts_ns").alias("ts_ns"), F.col("snap.u").alias("u"), "snap", F.lit(-1).alias("kind")))
        .withColumn("trade", none.cast(asked.schema["trade"].dataType))
        .unionByName(asked.select(*keys, "bucket", "ts_ns", none.cast("long").alias("u"), none.cast(shifted.schema["snap"].dataType).alias("snap"), F.lit(1).alias("kind"), "trade"))
    )
    window = Window.partitionBy(*keys, "bucket").orderBy("ts_ns", "kind", "u").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("snap", ignorenulls=True).over(window)
    if max_age_ns is not None:
        last = F.when(F.col("ts_ns") - last["ts_ns"] <= max_age_ns, last)
    return rows.withColumn("snap", F.when(F.col("ts_ns").isNotNull(), last)).where("kind = 1").select("trade.*", "snap")


def previous(rows: DataFrame, columns: list[str], order: list[str], keys: list[str], bucket: Column) -> DataFrame:
    """``rows`` with a struct ``prev`` of ``columns`` from the row before, by ``order`` within ``keys``; null on
    the first. Ordered bucket by bucket: ``bucket`` must not fall as the order rises."""
    marked = rows.withColumn("bucket", bucket).withColumn("_value", F.struct(*columns))
    seeds = carry_in(marked, marked, "_value", order, keys).withColumnRenamed("_value", "_seed")
    own = F.lag("_value").over(Window.partitionBy(*keys, "bucket").orderBy(*order))
    return marked.withColumn("_lag", own).join(seeds, [*keys, "bucket"], "left").withColumn("prev", F.coalesce("_lag", "_seed")).drop("_lag", "_seed", "_value", "bucket")


def positions(rows: DataFrame, order: list[str], keys: list[str], bucket: Column) -> DataFrame:
    """``rows`` with ``pos``, 0 for the first by ``order`` within ``keys``, counted bucket by bucket."""
    marked = rows.withColumn("bucket", bucket)
    counts = marked.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order)) - 1
    return marked.withColumn("_own", own).join(bases, [*keys, "bucket"]).withColumn("pos", F.col("base") + F.col("_own")).drop("_own", "base", "bucket")


def forward_frames(snapshots: DataFrame, windows: list[int], keys: tuple[str, ...] = ("symbol",), bucket_ns: int = NS_HOUR, stretch: int = 65_536) -> DataFrame:
    """(keys, ts_ns, u, spreads): for each snapshot an array of one struct (w, ext_bid, ext_ask, last_ts_ns) per w of
    ``windows``: the lowest bid, the highest ask and the last time over it and the w snapshots after it, or as many as follow.

    Numbered snapshots are dealt in stretches, and each stretch gets the first rows of the next as well, so one
    window with leads, none of them past a stretch, gives all frames; only max(windows) rows in ``stretch`` are sent twice."""
    keys, most = list(keys), max(windows)
    stretch = max(stretch, most + 1)
    placed = positions(snapshots.select(*keys, "ts_ns", "u", "best_bid_ticks", "best_ask_ticks"), ["ts_ns", "u"], keys, whole(F.col("ts_ns"), bucket_ns))
    own = placed.withColumn("stretch", whole(F.col("pos"), stretch)).withColumn("own", F.lit(True))
    carried = own.where((F.col("pos") % stretch < most) & (F.col("stretch") > 0)).withColumn("stretch", F.col("stretch") - 1).withColumn("own", F.lit(False))
    order = Window.partitionBy(*keys, "stretch").orderBy("pos")
    after = {c: [F.col(c), *(F.lead(c, k).over(order) for k in range(1, most + 1))] for c in ("best_bid_ticks", "best_ask_ticks", "ts_ns")}

    def over(f, column: str, w: int) -> Column:
        return f(*after[column][: w + 1]) if w else after[column][0]

    frames = [
        F.struct(F.lit(w).alias("w"), over(F.least, "best_bid_ticks", w).alias("ext_bid"), over(F.greatest, "best_ask_ticks", w).alias("ext_ask"), over(F.greatest, "ts_ns", w).alias("last_ts_ns"))
        for w in windows
    ]
    rows = own.unionByName(carried).withColumn("spreads", F.array(*frames))
    return rows.where("own").select(*keys, "ts_ns", "u", "spreads")


def extended_spread(snapshots: DataFrame, windows: list[int], keys: tuple[str, ...] = ("symbol",), bucket_ns: int = NS_HOUR) -> DataFrame:
    """(keys, ts_ns, u, w, ext_bid, ext_ask, last_ts_ns): forward_frames with one row per snapshot and w."""
    return forward_frames(snapshots, windows, keys, bucket_ns).select(*keys, "ts_ns", "u", F.inline("spreads"))


def next_after(rows: DataFrame, events: DataFrame, key: str, at: str, found: str, bucket: int = 600) -> DataFrame:
    """``rows`` with ``found``: the first ``at`` of ``events`` strictly after the row's own, within ``key``. Both
    have columns key and at; nulls in them match nothing. Ordered from the last to the first in buckets of
    ``bucket`` units of ``at``, each with the first event of the later ones as a seed."""
    marked = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, F.col(at).alias("_at"), whole(F.col(at), bucket).alias("bucket"))
    asked = rows.select(key, at, whole(F.col(at), bucket).alias("bucket"), F.lit(1).alias("kind"), F.struct(*rows.columns).alias("row"))
    seeds = carry_in(marked, asked, "_at", [at], [key], latest=False)
    two = marked.select(key, "bucket", at).unionByName(seeds.select(key, "bucket", F.col("_at").alias(at))).select(key, at, "bucket", F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    window = Window.partitionBy(key, "bucket").orderBy(F.desc(at), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col(at).isNotNull(), F.last(F.when(F.col("kind") == 0, F.col(at)), ignorenulls=True).over(window))
    return asked.unionByName(two).withColumn(found, seen).where("kind = 1").select("row.*", found)
