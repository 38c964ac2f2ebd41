import random

import numpy as np
from pyspark.sql import functions as F

from tidebook.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=50, positives=5, count=3):
    """Every row against every row, in Python's integers."""
    fine = [(i, x, [int(np.floor(v * 256)) for v in vec]) for i, vec, x in rows if None not in (i, vec, x) and all(v is not None and np.isfinite(v) for v in vec)]
    out = []
    for k, (anchor, label, a) in enumerate(fine):
        if anchor % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a, b, strict=True)), i, x) for j, (i, x, b) in enumerate(fine) if j != k and len(a) == len(b)]
        for p, i, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s for s in scored if s[2] != label and -50 * p <= -100 * s[0] <= -95 * p)[:count]
            out += [(anchor, i, r + 1, n[1], -p, -n[0]) for r, n in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("q", F.lit(1))
    return sorted(map(tuple, negatives.mine(negatives.whole_vectors(table.repartition(3), F.col("label")), **options).collect()))


def test_equals_brute_force_over_many_slabs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6))
    rows = [(k * 5, (centres[c] + rng.normal(size=6) * 0.4).tolist(), int(c)) for k, c in enumerate(rng.integers(0, 4, 900))]
    want = plain(rows)
    assert want and mined(spark, rows, block=100, chunk=7) == want and mined(spark, rows) == want
    assert mined(spark, rows, every=35, positives=2, count=6, block=333, chunk=50) == plain(rows, 35, 2, 6)


def test_ties_repeats_nulls_lengths_and_large_numbers(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(0, 60) * 10, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(rng.choice([1, 3]))], rng.randrange(2)) for _ in range(300)]
    rows += rows[:40] + [(100, [1.0, 1.0, 1.0], 1)] * 30 + [(50, [1.0, 1.0, 1.0], 1)] * 3
    rows += [(None, [1.0], 1), (50, None, 1), (50, [1.0], None), (50, [float("nan")], 1), (50, [None], 0), (100, [float("inf")], 1), (150, [], 1), (3, [], 1), (4, [], 0)]
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows, block=40, chunk=5) == want
    wide = [(k * 25, [rng.choice([-1, 1]) * rng.randrange(1 << 22) + 0.25, float(rng.randrange(1 << 20))], k % 3) for k in range(120)]
    want = plain(wide)
    assert max(abs(r[4]) for r in want) > 1 << 53 and mined(spark, wide, block=30) == want


def test_one_vector_may_hold_a_third_of_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [0.5, 0.25], k % 2) for k in range(400)] + [(400 + k, rng.normal(size=2).tolist(), k % 3) for k in range(800)]
    assert mined(spark, rows, block=64) == plain(rows)
    leaves, _ = negatives.build(negatives.whole_vectors(spark.createDataFrame(rows, SCHEMA), F.col("label")), 6, 64)
    assert leaves.select(F.sum(F.size("ids"))).first()[0] == 812


def test_leaves_hold_all_rows_and_boxes_hold_their_scores():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (1000, 8)).astype(float)
    tiles = negatives.str_tiles(x, 32)
    assert sorted(np.concatenate(tiles)) == list(range(1000)) and max(map(len, tiles)) <= 32
    spread = lambda parts: np.mean([np.prod(np.ptp(x[p], axis=0)[:8] + 1) for p in parts])
    assert spread(tiles) < spread(np.array_split(np.arange(1000), len(tiles)))
    tree = negatives.Tree([t for t in tiles], [np.zeros(len(t), int) for t in tiles], [x[t] for t in tiles], 50)
    opened = []
    tree.walk(x[0], lambda low, high: high >= 9000, lambda a, b: opened.append((a, b)))
    seen = {int(i) for a, b in opened for i in tree.ids[a:b]}
    assert {k for k in range(1000) if x[k] @ x[0] >= 9000} <= seen and len(tree.levels) == 2


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 0)]) == []
