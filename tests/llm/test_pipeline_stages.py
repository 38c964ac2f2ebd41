import corpus_pipeline
from tidebook.llm import langid, simhash


def sets_of(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicate_stage_equals_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, sets_of(r.text)) for r in docs.collect())
    part = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                part = [part[j] if p == part[i] else p for p in part]
    groups = {}
    for (doc_id, _), p in zip(rows, part, strict=True):
        groups.setdefault(p, []).append(doc_id)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values())) and len(groups) < len(rows)


def test_near_texts_of_one_passage_stay(spark):
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(40)])) for i in range(80)]
    rows += [(100 + i, t) for i, t in rows[:5]]
    kept = simhash.keep_similar_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(80))


def test_stages_on_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = docs.where("lang = 'en'").orderBy("doc_id").first()
    junk = "Привет мир, это текст на русском языке и его надо убрать " * 3
    odd = [(10**6 + k, t, None, None, None, "x", 7) for k, t in enumerate([None, "", "   ", junk, "12 34", known.text, known.text, known.text * 30])]
    odd += [(None, known.text, "en", None, None, "y", 8), (10**6 + 5, known.text, None, None, None, "x", 7)]
    extra = docs.selectExpr("*", "'z' as node", "1 as _toxicity")
    rows = extra.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, node string, _toxicity int"))
    step = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = langid.cut(stage(spark, step, sf))
        assert step.columns == rows.columns, name
        ids = [r.doc_id for r in step.select("doc_id").collect()]
        if name == "language_id":
            assert not set(ids) & {10**6 + k for k in range(5)} and {10**6 + 5, 10**6 + 6, 10**6 + 7} <= set(ids)
            assert len(ids) < rows.count()
    assert len(ids) == len(set(ids)) and None in ids
    assert not {10**6 + 5, 10**6 + 6} & set(ids)
    packed = corpus_pipeline.packed(spark, step, sf)
    assert {r.doc_id for r in packed.collect()} == set(ids)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
