import math
import time

import numpy as np

from tidebook.llm import toxicity


def test_folding():
    assert toxicity.fold(None) == " " and toxicity.fold("") == " "
    same = toxicity.fold("idiot").strip()
    for text in ("IDIOT", "1d1ot", "іdiоt", "ídïot", "id!ot", "ｉｄｉｏｔ", "id​iot", "idl0t"):
        assert toxicity.fold(text).strip() == same, text
    assert toxicity.fold("idiot! you").split()[0] == same


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.score(docs, labels, sample=4000).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in found)
    assert hit >= 0.75 * sum(r.toxic == 1 for r in found) > 0
    assert hit >= 0.97 * sum(r.predicted for r in found)
    assert all(0 <= r.score <= 1 for r in found)


def test_the_fit_is_the_same_however_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, rows in ((4, docs), (7, docs), (11, docs.repartition(13))):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(toxicity.fit(rows, labels, sample=3000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0].patterns) > 5


def lexicon():
    patterns = {" " + toxicity.fold("idiot").strip() + " ": 8.0, " vequ": 7.0}
    return toxicity.Lexicon(patterns, tuple(toxicity.fold(e) for e in ("idiot proof",)), 1.0, -4.0)


def test_matching_exceptions_and_length():
    machine = lexicon().automaton()
    plain = lambda t: toxicity.strength(toxicity.fold(t), machine)
    assert plain("you idiot") > 7 and plain("an idiot-proof box") == 0 and plain("idiots") == 0
    assert plain("vequais") > 6 and plain("avequ") == 0 and plain("") == 0
    assert plain("idiot " + "word " * 5000) < plain("idiot word")


def test_odd_rows(spark):
    schema = "doc_id long, text string, predicted string"
    rows = [(1, None, None), (1, None, None), (None, "", "x"), (4, "x " * 60000, "y")]
    no_labels = spark.createDataFrame([(1, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    got = toxicity.score(spark.createDataFrame(rows, schema), no_labels).collect()
    assert len(got) == 4 and all(r.score < 0.5 and r.predicted == 0 for r in got)
    assert toxicity.score(spark.createDataFrame([], schema), no_labels).count() == 0
    kept = toxicity.scores(spark.createDataFrame(rows, schema), lexicon())
    assert kept.columns == ["doc_id", "text", "predicted", "_toxicity"]


def test_filter_keeps_columns_whatever_their_names(spark):
    rows = [(i, "nice words here" if i % 3 else "you idiot moron", i, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _toxicity long, _toxicity_ string")
    labels = docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 1, 0) as toxic")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(60) if i % 3]


def test_rare_toxic_labels_leave_a_word_that_clean_texts_hold_too(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        toxic = i % 50 == 0
        marked = toxic and i % 200 != 0 or not toxic and i % 100 == 1
        rows.append((i, " ".join([f"w{k}" for k in rng.integers(0, 10**6, 8)] + ["qurk"] * marked), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert {k.strip() for k in found.patterns} == {"qurk"}


def plain_strength(text, lexicon):
    """Every pattern searched at every place of the folded text."""
    folded = toxicity.fold(text)
    at = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    spans = [(i, i + len(e) - 1) for e in lexicon.exceptions for i in at(e)]
    best = {}
    for p, w in lexicon.patterns.items():
        for i in at(p):
            if not any(a <= i < b for a, b in spans):
                best[i] = max(w, best.get(i, 0))
    return sum(best.values()) / (1 + math.log1p(folded.count(" ") / 500)) if best else 0.0


def test_scores_equal_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    odd = ["idiot proof idiot proof idiot", "clown fish pond scum", "an idiot-proof trash can, idiot", "", None, "x " * 500 + "idiot"]
    for used in (lexicon, toxicity.Lexicon({" idiot ".replace("l", "i"): 3.0, " idi": 1.0, " scum ": 2.5, " trash ": 1.5}, tuple(toxicity.fold(e) for e in toxicity.EXCEPTIONS), 0.7, -2.0)):
        rows = [(r.doc_id, r.text[:3000]) for r in docs.limit(60).collect()] + [(-k, t) for k, t in enumerate(odd, 1)]
        got = {r.doc_id: r._toxicity for r in toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string"), used).collect()}
        for k, t in rows:
            want = 1 / (1 + math.exp(-(used.scale * plain_strength(t, used) + used.shift)))
            assert abs(got[k] - want) < 1e-9, t


def test_long_texts_of_hits_and_exceptions_take_linear_time():
    machine = toxicity.Lexicon({" idiot ": 1.0}, (toxicity.fold("idiot proof"),), 1.0, 0.0).automaton()
    began = time.time()
    assert toxicity.strength(toxicity.fold("idiot proof idiot " * 150_000), machine) > 0
    assert time.time() - began < 20


def test_copies_of_one_toxic_text_teach_none_of_its_other_words(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijkmnopqrstuvwxyz"), 9))
    rows = [(i, " ".join([word() for _ in range(20)] + ["qurk"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(400)]
    copied = [word() for _ in range(60)] + ["qurk"]
    rows += [(1000 + i, " ".join(copied + [word()]), 1) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert {k.strip() for k in found.patterns} == {"qurk"}
