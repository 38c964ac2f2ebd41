import random
import re

import pytest

from tidebook.operators import quality


def gaps(ids):
    ids = sorted({i for i in ids if i and i > 0})
    return [(a + 1, b, b - a - 1) for a, b in zip(ids, ids[1:], strict=False) if b - a > 1]


@pytest.fixture(scope="module")
def ids():
    rnd = random.Random(9)
    dense = [i for i in range(32_700, 98_400) if i not in (32_768, 32_769, 65_536, 65_537, 70_000)]
    return {
        "dense": dense + [40_000, 40_000],
        "sparse": [rnd.randrange(1, 5_000_000) for _ in range(300)] + [2**62, 2**62 + 2],
        "edges": [1, 32_768, 32_769, 65_536, 98_305],
        "none": [0, None, -5],
        "one": [77, 77],
        "full": list(range(1, 65_537)),
    }


def test_gaps_and_report_equal_plain_sets(spark, ids):
    rows = [(k, i, 1) for k, own in ids.items() for i in own]
    df = spark.createDataFrame(rows, "symbol string, agg_trade_id long, bits int").repartition(5)
    found = {}
    for r in quality.id_gaps(df, ["symbol"]).collect():
        found.setdefault(r.symbol, []).append((r.start, r.end, r.missing))
    report = {r.symbol: r for r in quality.id_report(df, ["symbol"]).collect()}
    assert set(report) == set(ids)
    for k, own in ids.items():
        valid = [i for i in own if i and i > 0]
        assert sorted(found.get(k, [])) == gaps(own), k
        r = report[k]
        assert (r.ids, r.unique_ids, r.duplicates) == (len(valid), len(set(valid)), len(valid) - len(set(valid)))
        assert r.gap_ranges == (len(gaps(own)) if valid else -1)
        assert r.missing_ids == (sum(g[2] for g in gaps(own)) if valid else -1)
    assert quality.id_gaps(df.limit(0), ["symbol"]).count() == quality.id_report(df.limit(0), ["symbol"]).count() == 0


def test_compared_sets_equal_plain_sets(spark, ids):
    rnd = random.Random(3)
    here = {k: [i for i in own if i and i > 0 and rnd.random() < 0.9] for k, own in ids.items() if k != "full"}
    there = {k: [i for i in own if i and i > 0 and rnd.random() < 0.8] for k, own in ids.items() if k != "sparse"}
    tables = [spark.createDataFrame([(k, i) for k, own in t.items() for i in own] + [("zero", 0)], "symbol string, agg_trade_id long") for t in (here, there)]
    got = {r.symbol: r for r in quality.compare_ids(*tables, ["symbol"]).collect()}
    for k in {k for t in (here, there) for k, own in t.items() if own}:
        a, b = set(here.get(k, [])), set(there.get(k, []))
        assert (got[k].local_ids, got[k].reference_ids, got[k].missing_here, got[k].extra_here) == (len(a), len(b), len(b - a), len(a - b)), k
    assert "zero" not in got


def test_single_ids_are_not_shuffled(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 2000)], "symbol string, agg_trade_id long").coalesce(3)
    for rows in (quality.id_gaps(df, ["symbol"]), quality.id_report(df, ["symbol"]), quality.compare_ids(df, df, ["symbol"])):
        lines = rows._jdf.queryExecution().executedPlan().toString().split("\n")
        below = [next(x for x in lines[k + 1 :] if not any(y in x for y in ("- Project", "- Filter"))) for k, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert below and all(any(y in x for y in ("Aggregate", "Window", "FullOuter")) for x in below), lines
        for line in lines:
            if "Exchange hashpartitioning" in line:
                names = re.findall(r"([a-z_]+)#", line.split("hashpartitioning(")[1].split("ENSURE")[0])
                assert set(names) <= {"symbol", "bucket", "_groupingexpression"}, line
