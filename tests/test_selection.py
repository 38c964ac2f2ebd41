import random

from pyspark.sql import functions as F

from tidebook.operators import selection

POINTS = (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)


def plain(rows, column, by):
    names = selection._names(POINTS)
    return rows.groupBy(*by).agg(*(F.percentile(column, F.lit(p)).alias(n) for p, n in zip(POINTS, names, strict=True)), F.max(column).alias("max"))


def same(rows, column, by, **options):
    got = selection.percentiles(rows, column, POINTS, by, **options)
    want = plain(rows, column, by)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_equals_percentile_on_ties_skew_and_nulls(spark):
    rnd = random.Random(4)
    rows = [("ties", float(rnd.randrange(5))) for _ in range(500)] + [("skew", 10.0 ** rnd.uniform(-4, 4)) for _ in range(500)]
    rows += [("one", 3.5), (None, 1.0), (None, 2.0), ("none", None), ("none", None)]
    rows += [("hot", 7.0)] * 2000 + [("hot", 1e300), ("hot", -1e308), ("hot", 1e308), ("hot", None)]
    rows += [("close", 1.0 + k * 2.0**-52) for k in range(40)] + [("tiny", k * 5e-324) for k in range(4)]
    df = spark.createDataFrame(rows, "g string, x double")
    for bins in (256, 1 << 14):
        same(df, "x", ["g"], bins=bins)
    same(df, "x", [])
    same(df.limit(0), "x", ["g"])
    same(df.limit(0), "x", [])


def test_whole_numbers_clashing_names_and_two_keys(spark):
    rows = [(k % 3, k % 2, (k * 7919) % 1001, k, k) for k in range(3000)] + [(0, 0, None, 1, 1)]
    df = spark.createDataFrame(rows, "lo int, hi int, n long, rank long, k0 long")
    same(df, "n", ["lo", "hi"])
    same(df, "rank", ["lo"])


def test_infinite_values_stand_at_the_ends(spark):
    df = spark.createDataFrame([(x,) for x in [float("-inf"), 1.0, 2.0, 3.0, float("inf"), float("nan")]], "x double")
    got = selection.percentiles(df, "x", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)).first()
    assert list(map(str, got[:6])) == ["-inf", "1.0", "2.0", "3.0", "inf", "nan"]


def test_approximate_ranks_are_within_the_bound(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("x"))
    got = selection.percentiles(df, "x", (0.5, 0.9), accuracy=1000).first()
    assert abs(got.p50 - 10_000) <= 21 and abs(got.p90 - 18_000) <= 21 and got.max == 19_999
