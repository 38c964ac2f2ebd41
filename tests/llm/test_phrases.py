import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebook.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, top, inside=80):
    """Every phrase of every piece counted in one pass."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[lang or "und"][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit("x")).withColumn("shard", F.lit(9)).repartition(5)
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


def corpus(seed=1, n=250):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["The", "ÉTÉ", "été", "x-1", "日本"]
    fixed = ["new york city hall", "A b A b A b", "as well as"]
    rows = []
    for k in range(n):
        parts = [rng.choice(words) if rng.random() < 0.85 else rng.choice(fixed) for _ in range(rng.randrange(1, 40))]
        rows.append((k, "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "!?", "\n", ",", "\r\n"]) for p in parts), rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(k, t, "en") for k, t in enumerate([None, "", "...", " \t ", "one", ". a"])] + [(900 + k, "late bloomer grows here", "de") for k in range(9)]


@pytest.mark.parametrize("options", [{"shards": 1}, {"shards": 3}, {"shards": 5, "bits": 16, "slice_bytes": 300}, {"bits": 3, "shards": 2}])
def test_equals_one_pass(spark, options):
    rows = corpus()
    got = mined(spark, rows, least=6, top=40, **options)
    assert got == plain(rows, 6, 40) and {r[0] for r in got} == {"en", "fr", "und", "de"}


def test_long_copied_and_skewed_texts(spark):
    rows = corpus(2, 40) + [(k, "the same old words again and again", "en") for k in range(400)] + [(7, "very long text . " * 30_000, "en"), (8, "z" * 200_000, "en")]
    assert mined(spark, rows, least=20, top=15) == plain(rows, 20, 15)


def test_phrases_open_for_one_cycle():
    text, lang = pa.array(["a b c", "a b, c"]), pa.array(["en", "en"])
    first = np.full(1 << 16, phrases.NEVER, np.uint8)

    pairs = np.full(1 << 10, 255, np.uint8)

    def counts(step):
        return {(r["phrase"], r["since"]): r["n"] for b in phrases.count_open(text, lang, first, pairs, step, 2) for r in b.to_pylist()}

    assert counts(0) == counts(1) == {("a", 0): 2, ("b", 0): 2, ("c", 0): 2} and counts(2) == {}
    first[phrases.word_hashes(["en"] * 2, ["a", "b"]) & np.uint64(65535)] = (0, 1)
    assert counts(2) == counts(3) == {("a b", 2): 2} and counts(4) == {}
    pairs[:] = 0
    assert counts(2) == {}
    assert phrases.word_hashes(["en"], ["a"]) != phrases.word_hashes(["fr"], ["a"])


def test_pairs_too_rare_to_open(spark):
    rows = spark.createDataFrame([("en", "a b a b. c d")] * 3 + [("en", "x y")] * 2 + [("fr", "a b"), ("en", "")], "lang string, text string").repartition(4)
    for least in (3, 300):
        bits = phrases.possible_pairs(rows.unionAll(rows) if least == 3 else rows.crossJoin(spark.range(100)).select("lang", "text"), least, 12, 10)
        held = set()
        for a, b in ("ab", "cd", "xy"):
            own = phrases.word_hashes(["en"] * 2, [a, b])
            if phrases._holds(bits, phrases._joined(own[:1], own[1:]) & np.uint64(4095))[0]:
                held.add(a + b)
        assert held == ({"ab", "cd", "xy"} if least == 3 else {"ab", "cd"})


def test_large_counts_stay_exact(spark):
    rows = spark.sql("select cast(2 as bigint) as size, cast(3000000000000000000 as bigint) as f")
    wide = rows.select((F.col("f").cast("decimal(19,0)") * F.lit(2_000_000).cast("decimal(7,0)")).alias("product"), (F.col("f").cast("decimal(19,0)") * 2).alias("both"))
    assert wide.select(F.expr("product div both")).first()[0] == 1_000_000


def test_no_words(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, None, None), (2, " . ", "en")]) == [] and mined(spark, [(1, "a b", "en")]) == []


def test_parts_that_share_an_earlier_slot():
    """The pairs' slots are taken at step 0 by others, but their words come to the threshold a step later."""
    text, lang = pa.array(["a b c"]), pa.array(["en"])
    first, pairs = np.full(1 << 16, phrases.NEVER, np.uint8), np.full(1 << 10, 255, np.uint8)
    a, b, c = (phrases.word_hashes(["en"], [w]) for w in "abc")
    for h, step in ((a, 1), (b, 1), (c, 0), (phrases._joined(a, b), 0), (phrases._joined(b, c), 0)):
        first[h & np.uint64(65535)] = step
    found = [r for step in range(8) for x in phrases.count_open(text, lang, first, pairs, step, 3) for r in x.to_pylist() if r["phrase"] == "a b c"]
    assert [r["since"] for r in found] == [2, 2, 2]  # one cycle of three shards


def test_phrases_are_not_broadcast(spark):
    """Spark sizes exploded rows by the small file they come from: at 0.5 GB of texts it broadcast 1 GB."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    plan = phrases.collocations(docs, least=6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "HashedRelationBroadcastMode(List(input[0, string, true], input[1, string" not in plan


def test_few_jobs_for_many_partitions(spark):
    """What the driver gets comes in one job a step, not in one for each partition."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    docs = spark.createDataFrame(corpus(n=40), SCHEMA).repartition(2)
    spark.sparkContext.setJobGroup("phrases", "")
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        phrases.frequent_phrases(docs, 6, shards=1, bits=16)
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("phrases")) < 80, len(spark.sparkContext.statusTracker().getJobIdsForGroup("phrases"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in old.items():
            spark.conf.set(k, v)
