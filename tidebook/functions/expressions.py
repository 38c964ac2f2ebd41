"""Column expressions of the market operators. All are built-in functions, evaluated by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.schemas import Scale

NS_HOUR = 3_600_000_000_000
NS_DAY = 24 * NS_HOUR

# Trade-size buckets in lots, lower edges included, upper ones not.
SIZE_BUCKETS = (("dust", 0, 1), ("micro", 1, 10), ("small", 10, 100), ("medium", 100, 1000), ("large", 1000, 10000), ("whale", 10000, 100000), ("mega", 100000, None))
# Groups of penetration levels, first and last level.
LEVEL_GROUPS = ((1, 1), (2, 2), (3, 3), (4, 4), (5, 9), (10, 19), (20, 49), (50, 99), (100, 199), (200, 499), (500, 999), (1000, None))


def price_to_ticks(price: Column, scale: Scale = Scale()) -> Column:
    """Half-even, like the quantities: ticks of tick_size, or of the price scale."""
    x = price / F.lit(scale.tick_size) if scale.tick_size else price * F.lit(float(10**scale.price_scale))
    return F.bround(x).cast("long")


def qty_to_lots(qty: Column, scale: Scale = Scale()) -> Column:
    x = qty / F.lit(scale.step_size) if scale.step_size else qty * F.lit(float(10**scale.qty_scale))
    return F.bround(x).cast("long")


def ticks_to_price(ticks: Column, scale: Scale = Scale()) -> Column:
    return ticks * F.lit(scale.tick_size) if scale.tick_size else ticks / F.lit(float(10**scale.price_scale))


def lots_to_qty(lots: Column, scale: Scale = Scale()) -> Column:
    return lots * F.lit(scale.step_size) if scale.step_size else lots / F.lit(float(10**scale.qty_scale))


def ms_to_ns(ms: Column) -> Column:
    return ms * F.lit(1_000_000)


def whole(a: Column, b: int | Column) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def ns_to_timestamp(ts_ns: Column) -> Column:
    return F.timestamp_micros(whole(ts_ns, 1000))


def hour_of(ts_ns: Column) -> Column:
    """Hour of the day in UTC."""
    return F.pmod(whole(ts_ns, NS_HOUR), F.lit(24)).cast("int")


def date_of(ts_ns: Column) -> Column:
    """UTC date as yyyy-MM-dd."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), whole(ts_ns, NS_DAY).cast("int")), "yyyy-MM-dd")


def part_hour(ts_ns: Column) -> Column:
    """The hour partition key, two digits."""
    return F.lpad(hour_of(ts_ns).cast("string"), 2, "0")


def trade_time(ts_ns: Column) -> Column:
    """UTC time as yyyy-MM-dd HH:mm:ss.SSSSSS."""
    second = F.pmod(whole(ts_ns, 1_000_000_000), F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d.%06d", whole(second, 3600), F.pmod(whole(second, 60), F.lit(60)), F.pmod(second, F.lit(60)), F.pmod(whole(ts_ns, 1000), F.lit(1_000_000)))
    return F.concat(date_of(ts_ns), F.lit(" "), clock)


def consumed_side(is_buyer_maker: Column) -> Column:
    return F.when(is_buyer_maker, "bid").otherwise("ask")


def side_levels(is_buyer_maker: Column, bids: Column, asks: Column) -> Column:
    return F.when(is_buyer_maker, bids).otherwise(asks)


def penetration_level(qty: Column, levels: Column, max_level: int | None = 1000) -> Column:
    """First level, from 1, at which the summed quantity reaches ``qty``; empty levels count as levels.

    Not reached within ``max_level`` levels: max_level + 1; with None, one more than there are levels. A quantity of 0 or less is level 1. The first
    level, by far the commonest, is tested without walking the array.
    """
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        total, n = acc["sum"] + x, acc["n"] + 1
        return F.struct(total.alias("sum"), n.alias("n"), F.when(acc["hit"] > 0, acc["hit"]).when(total >= qty, n).otherwise(0).alias("hit"))

    inside, beyond = (levels, F.size(levels) + 1) if max_level is None else (F.slice(levels, 1, max_level), F.lit(max_level + 1))
    walked = F.aggregate(inside, start, step, lambda acc: F.when(acc["hit"] > 0, acc["hit"]))
    walked = F.when(levels.isNotNull(), F.coalesce(walked, beyond))
    return F.when((qty <= 0) | (F.get(levels, F.lit(0)) >= qty), 1).otherwise(walked)


def is_overflow(level: Column, max_level: int = 1000) -> Column:
    return level > max_level


def size_bucket(lots: Column) -> Column:
    found = F.lit("unknown")
    for name, low, high in reversed(SIZE_BUCKETS):
        inside = lots >= low if high is None else (lots >= low) & (lots < high)
        found = F.when(inside, name).otherwise(found)
    return found


def bucket_label(low_lots: int, high_lots: int | None) -> str:
    return f"{low_lots / 1000:.3f}+" if high_lots is None else f"{low_lots / 1000:.3f}-{high_lots / 1000:.3f}"


def level_group(level: Column, max_level: Column, distinct_levels: Column) -> Column:
    """Text of the level's group: the level itself if there are at most 30 different ones."""
    grouped = F.lit(None).cast("string")
    for low, high in reversed(LEVEL_GROUPS):
        text = F.lit(str(low)) if low == high else F.lit(f"{low}-{high}") if high else F.concat(F.lit(f"{low}-"), max_level.cast("string"))
        inside = level >= low if high is None else level.between(low, high)
        grouped = F.when(inside, text).otherwise(grouped)
    return F.when(distinct_levels <= 30, level.cast("string")).otherwise(grouped)


def deviation(price: Column, bid: Column, ask: Column) -> Column:
    """How far a price lies below the bid (negative) or above the ask (positive), else 0."""
    return F.when(price < bid, price - bid).when(price > ask, price - ask).otherwise(F.lit(0))


def outside(price: Column, bid: Column, ask: Column) -> Column:
    return (price < bid) | (price > ask)


def ns_to_ms(ns: Column) -> Column:
    return ns / F.lit(1e6)


def delta_encode(prices: Column, best: Column) -> Column:
    return F.transform(prices, lambda p: (p - best).cast("int"))


def pad(levels: Column, depth: int) -> Column:
    """The array with zeros up to ``depth`` entries; longer arrays stay as they are."""
    zero = F.get(levels, F.lit(0)) * 0
    return F.concat(levels, F.array_repeat(F.coalesce(zero, F.lit(0)), F.greatest(F.lit(0), F.lit(depth) - F.size(levels))))


def absolute_prices(best: Column, deltas: Column) -> Column:
    return F.transform(deltas, lambda d: best + d)


def part_number(file_name: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(file_name, r"^part-(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def safe_pct(part: Column, total: Column) -> Column:
    """100 * part / total, and 0 where the total is 0."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), total), F.lit(0.0))


def within(x: Column, low: float, high: float) -> Column:
    return F.coalesce(x.between(low, high), F.lit(False))


def log_time(line: Column) -> Column:
    """Leading yyyy-MM-dd HH:mm:ss of a log line, as seconds since 1970 in UTC; null if there is none."""
    text = F.regexp_extract(line, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    day = F.to_date(F.nullif(F.substring(text, 1, 10), F.lit("")), "yyyy-MM-dd")
    clock = [F.try_to_number(F.nullif(F.substring(text, k, 2), F.lit("")), F.lit("99")).cast("long") for k in (12, 15, 18)]
    return F.unix_date(day).cast("long") * 86400 + clock[0] * 3600 + clock[1] * 60 + clock[2]


def resync_reason(line: Column) -> Column:
    """What follows "Resync triggered:", trimmed; null for other lines."""
    return F.when(line.rlike(r"Resync triggered: "), F.trim(F.regexp_extract(line, r"Resync triggered: (.*)", 1)))


def is_live_line(line: Column) -> Column:
    return line.contains("SYNCING -> LIVE")
