import re

import numpy as np
import pyarrow as pa
import xxhash

import corpus_pipeline
from tidebook.llm import simhash


def plain_fingerprint(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, fa) in enumerate(zip(ids, prints, strict=True)):
        for b, fb in zip(ids[:i], prints[:i], strict=True):
            if (fa ^ fb).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprint_matches_plain_form():
    for text in [None, "", "  \t", "One", "a b c", "a b c d", "A b C d e É ſ\x1c x", "the cat " * 50, "  x y"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], prints, 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for r, fp in zip(rows, prints, strict=True):
        assert got[r.doc_id].fingerprint == f"{fp:016x}"
        assert got[r.doc_id].component_id == want[r.doc_id]


def test_links_of_planted_prints_by_every_path(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30, dtype=np.uint64)]
    prints = set(base)
    for b in base[:10]:
        for _ in range(25):
            x = b
            for bit in rng.choice(64, rng.integers(1, 8), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), 0, i) for i, p in enumerate(prints)], "fp long, fp2 long, rep long")
    for radius, segments, dense, cap in ((4, 2, 1000, 10**6), (4, 2, 2, 3), (4, 4, 2, 10**6), (8, 3, 1000, 10**6), (8, 3, 2, 3), (3, 2, 2, 10**6)):
        want = plain_components(list(range(len(prints))), prints, radius)
        stars = simhash.connected_components(simhash.hamming_links(frame, radius, segments, None, dense, cap)).collect()
        got = {i: i for i in range(len(prints))} | {r.node: r.component for r in stars}
        assert got == want, (radius, segments, dense, cap)


def test_merging_closer_first_changes_nothing(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the noise of this old town".split()
    rows = [(i, " ".join(base[:k] + [f"w{i}"] + base[k + 1 :] if i % 3 else base) * (1 + i % 2)) for i, k in enumerate([*range(len(base))] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = dict(shingle=5, radius=8, segments=3, within=20, double=True)
    one, two = ({r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **wide, closer=c).collect()} for c in (None, (4, 2)))
    assert one == two and len(set(one.values())) < len(one)


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp string"
    rows = [(5, None, "x"), (2, "", "x"), (None, "a b c d e f", None), (7, "A B c d e f", None), (7, "A B c d e f", None), (9, "z " * 30000, "")]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 7), (2, 2), (5, 2), (7, 7), (7, 7), (9, 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    kept = simhash.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 2, 7, 9]


def test_groups_by_exact_similarity(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(60):
        base = list(rng.choice(words, 104))
        texts.append(base)
        # k new words at the end leave 100 - k of 100 + k shingles: 0.8 is reached up to 11
        texts += [base[: 104 - k] + [f"n{rng.integers(1 << 40)}" for _ in range(k)] for k in (int(rng.integers(8, 12)), int(rng.integers(12, 16)))]
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent = [parent[j] if p == parent[i] else p for p in parent]
    want = sorted({parent.index(p) for p in parent})
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert 60 < len(want) < 180


def test_one_id_with_two_texts_keeps_both(spark):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, one), (1, two), (1, two), (2, one), (None, two), (3, ""), (4, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, two), (1, one), (1, two), (3, "")]


def test_keep_one_judges_each_text_of_an_id(spark):
    one, two = "a b c d e f g h", "p q r s t u v w x"
    docs = spark.createDataFrame([(3, one), (7, one), (7, two), (7, two), (None, one)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(docs).collect()) == [(-1, one), (3, one), (7, two)]


def test_sketches_tell_the_similarity(spark):
    rng = np.random.default_rng(2)
    for size in (30, 300, 5000):
        for want in (0.6, 0.8, 0.95):
            both = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            extra = int(size * (1 / want - 1) / 2)
            sets = [np.unique(np.r_[both, rng.integers(0, 1 << 63, extra, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]) for _ in range(2)]
            true = size / (len(sets[0]) + len(sets[1]) - size)
            a, b = (np.frombuffer(simhash.sketch(x), np.uint8) for x in sets)
            assert abs(((a == b) & (a > 0)).sum() / ((a > 0) | (b > 0)).sum() - true) < 0.08


def test_one_key_of_a_million_rows_is_passed_on_in_bounded_memory():
    from tidebook.llm import buckets

    held = []

    def batches():
        for k in range(200):
            words = np.full(5000, k, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(5000, 9)), pa.array(words), pa.array(words), pa.array(np.arange(5000) + 5000 * k)], names=["key", "fp", "fp2", "rep"])

    rows = 0
    for out in buckets._task(4, 12, 50_000)(batches()):
        held.append(out.num_rows)
        rows += out.num_rows
    assert rows == 1_000_000 and max(held) <= buckets.AT_ONCE + 5000
