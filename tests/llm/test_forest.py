import numpy as np

from tidebook.llm import forest


def plain(ids, vectors, count=10):
    out = {}
    for q, v in zip(ids, vectors, strict=True):
        if q % 100 == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
            out[int(q)] = sorted((float(x), int(i)) for x, i in zip(d, ids, strict=True) if i != q)[:count]
    return out


def gather(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_recall_on_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    want, got = plain(ids, vectors), gather(forest.search(table, block=1024))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for found in got.values():
        assert found == sorted(found)
    exact = gather(forest.search(table, share=1.0, block=700, chunk=3))
    assert {q: [i for _, i in v] for q, v in exact.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (None, [1.0, 1.0]), (300, [1.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0])]
    rows += [(k, [1.0, 0.0]) for k in range(11, 40)]
    got = gather(forest.search(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")))
    assert got == {0: [(0.0, k) for k in range(11, 21)], 100: [(0.0, 0)] + [(0.0, k) for k in range(11, 20)]}
    assert forest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lengths_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=3 if k % 4 else 5).tolist()) for k in range(600)]
    rows += [(200, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 3.0]), (7, rows[1][1]), (7, rows[1][1]), (901, [1.0, 2.0, 3.0]), (902, [4.0])]
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 100 == 0 and (q, v) not in rows[:at]:
            found = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for k, (i, w) in enumerate(rows) if k != at and len(w) == len(v))
            want += [(q, r + 1, i, x) for r, (x, i) in enumerate(found[:10])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, d string").repartition(3)
    got = forest.search(table, share=1.0, block=100, chunk=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(w[:3] for w in want)
    assert np.allclose(sorted(r.score for r in got), sorted(w[3] for w in want), rtol=1e-12, atol=0)


def test_recall_with_registered_parameters(spark):
    for sf in ("0.001", "0.01", "0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
        want = plain(np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64))
        got = gather(forest.search(spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")))
        hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert hits >= 0.93 * sum(map(len, want.values())), (sf, hits)
