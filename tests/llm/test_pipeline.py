import corpus_pipeline


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def test_stages_take_effect(spark, sf):
    """Each stage drops rows and keeps the columns; of the near copies (five-word Jaccard of 0.8 or more) none stays
    beside another, and every one that goes is linked, over others that came with it, to one that stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf).cache())
        assert steps[-1].columns == columns, name
    sizes = [s.count() for s in steps]
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, steps[-1], sf)
    kept = {r.doc_id for r in steps[-1].collect()}
    assert {r.doc_id for r in last.collect()} == kept
    sets = {r.doc_id: shingles(r.text) for r in steps[-2].collect()}
    order = sorted(kept)
    assert not any(linked(sets[a], sets[b]) for k, a in enumerate(order) for b in order[:k])
    reached, edge = set(kept), list(kept)
    while edge:
        here = sets[edge.pop()]
        new = [d for d in sets if d not in reached and linked(here, sets[d])]
        reached.update(new)
        edge += new
    assert reached == set(sets)
