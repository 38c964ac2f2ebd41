import math

import numpy as np
from pyspark.sql import functions as F

from tidebook.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert right >= 0.97 * len(found) > 0
    assert all(0 <= r.score <= 1 for r in found)
    assert langid.keep_known(docs).count() >= 0.98 * docs.count()


def test_centroids_separate_and_reject(spark):
    words = {"aa": "aba abe abi", "bb": "kso kse ksi"}
    rows = [(i, " ".join(words[k].split()[j % 3] for j in range(i % 7 + 5)), k) for i in range(200) for k in words]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=40)
    assert set(model.languages) == {"aa", "bb"}
    asked = spark.createDataFrame([(1, "abe aba aba"), (2, "ksi KSE"), (3, "ЖЖЖ дддд щщщ"), (4, None), (5, ""), (6, "12 !"), (6, "12 !"), (None, "aba " * 20000)], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(asked, model).collect()]
    assert got[0] == (1, "aa", False) and got[1] == (2, "bb", False)
    assert got[2][2] and got[3:7] == [(4, "und", True), (5, "und", True), (6, "und", True), (6, "und", True)]
    assert got[7] == (None, "aa", False)


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string, score string"
    got = langid.identify(spark.createDataFrame([(1, "abc", None, "x")], schema)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0


def test_counts_match_plain_form():
    assert langid.counts(None) is None and langid.counts("1 2") is None
    assert (langid.counts("Ab, c") == langid.counts("  aB--C!! ")).all()
    assert langid.counts("abc").sum() == 5 + 4 + 3
    assert F is not None


def plain_vector(text, idf):
    """TF-IDF of a text by dictionaries of its n-grams, hashed one by one."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    code = [ord(c) for c in f" {' '.join(letters.split())} "]
    mask, tf = (1 << 32) - 1, {}
    for i, c in enumerate(code):
        h = c * 2654435761 & mask
        for k, factor, times in ((0, 0, 0), (1, 2246822519, 3266489917), (2, 668265263, 374761393)):
            if i + k >= len(code):
                break
            if k:
                h = (h ^ (code[i + k] * factor & mask)) * times & mask
            tf[h >> 19] = tf.get(h >> 19, 0) + 1
    weights = {d: math.log1p(1000 * n / sum(tf.values())) * float(idf[d]) for d, n in tf.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {d: w / norm for d, w in weights.items()}


def test_predictions_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))), per_language=60)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        vector = plain_vector(r.text, model.idf)
        cosines = [sum(w * float(c[d]) for d, w in vector.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(cosines[best] - got[r.doc_id].score) < 1e-4
        near = [k for k, c in enumerate(cosines) if c > cosines[best] - 1e-5]
        assert got[r.doc_id].lang_pred in {model.languages[k] for k in near}
        size = len(vector).bit_length() - 1
        assert got[r.doc_id].rejected in {1 - got[r.doc_id].score > model.reach[k, size] for k in near}


def test_junk_and_other_scripts_go_and_known_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.where("doc_id % 7 = 0").limit(60).collect()
    rng = np.random.default_rng(3)
    junk = [" ".join("".join(rng.choice(list("qxzjkvw"), rng.integers(3, 9))) for _ in range(n)) for n in (60, 200, 1000)]
    other = ["Привет мир, это текст на русском языке", "это предложение " * 50, "这是一个中文句子，它比前面的句子要长一些，所以可以看出来不是已知的语言"]
    short = [" ".join(r.text.split()[:n]) for r in known for n in (1, 3, 10)]
    rows = [(10**9 + i, t) for i, t in enumerate([*junk, *other, *short])]
    kept = langid.keep_known(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True))
    ids = {r.doc_id - 10**9 for r in kept.where(f"doc_id >= {10**9}").collect()}
    assert not ids & set(range(len(junk) + len(other)))
    assert len(ids) >= 0.97 * sum(any(c.isalpha() for c in t) for t in short)


def test_ids_do_not_matter_and_repeated_texts_count_once(spark):
    rows = [(None, f"{a} {b}", "aa") for a in ("aba", "abe", "abi") for b in ("abu", "abo", "aby")] * 30 + [(7, "kso kse ksi", "bb")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, per_language=5).collect()}
    assert got == {(None, "aa"), (7, "bb")} or got == {(None, "aa"), (7, "und")}
    model = langid.fit(docs, per_language=5)
    assert model.languages.count("bb") == 1 and model.languages.count("aa") == 4
