import random

import numpy as np
import public_tokenizers
import sentencepiece

from tidebook.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "   a  b ", "aaaaaaaaaaaaa", "hello   world\n\n\tx", "日本語テキスト", "😀 é ÿ ‍ ﷽", "▁▁ x▁y", "x" * 3000, "1234567890" * 30, "Über-größe; naïve café!", "\x00\x01", "https://www.example.com/a?b=c&d=%20", "a" + " " * 40 + "b"]


def test_same_ids_as_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in pieces.encode(docs, PATH).collect()}
    assert got == {i: library.encode(t) for i, t in texts.items()}
    for r in pieces.summarize(docs, PATH).collect():
        assert r.round_trip and r.n_ids == len(got[r.doc_id])


def test_odd_and_random_texts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aeiorstn .,'-1▁ABé\nthe") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    coder = pieces.coder(PATH)
    for text, data in zip(texts, coder.encode(texts), strict=True):
        ids = np.frombuffer(data, "<u4").tolist()
        assert ids == library.encode(text or ""), repr(text)
        assert coder.decode(ids) == pieces.normalized(text)
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a", "x")] * 2, "doc_id long, text string, ids string")
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(table, PATH), PATH).collect()}
    assert all(back[i] == pieces.normalized(t) for i, t in enumerate(ODD)) and back[None] == "a"
    assert pieces.summarize(table.limit(0), PATH).count() == 0


def test_unigram_weights_take_the_cheapest_path():
    t = pieces.compile_model(PATH)
    t.constrained = False
    t.weights = np.arange(len(t.weights), dtype=float) % 17 + 1
    for part in ("▁hello", "▁thereonat", "abcabc", "▁éa"):
        best = [0.0] + [np.inf] * len(part)
        names = {x.decode().replace(" ", pieces.MARK): i for i, x in enumerate(t.texts) if i > 258}
        for i in range(len(part)):
            for n in range(1, t.longest + 1):
                if part[i : i + n] in names and i + n <= len(part):
                    best[i + n] = min(best[i + n], best[i] + t.weights[names[part[i : i + n]]])
        path = pieces.shortest_paths(t, [part])[0]
        assert abs(sum(t.weights[s] for s in path) - best[-1]) < 1e-9


def test_paths_are_read_back_together():
    """Parts of different lengths, with and without byte fallback, in one batch: each path spells its own part."""
    coder = pieces.coder(PATH)
    parts = ["▁hello", "x", "▁", "日本", "▁thereon" * 9, "😀a😀", "aaaa"]
    symbols, ends = pieces.flat_paths(coder.t, parts)
    assert len(ends) == len(parts) and ends[-1] == len(symbols)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for part, path, start, end in zip(parts, pieces.shortest_paths(coder.t, parts), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        assert symbols[start:end].tolist() == path
        if all(0 <= s < coder.t.pieces for s in path):
            assert b"".join(coder.t.texts[s] for s in path).decode() == part.replace(pieces.MARK, " ")
    fresh = pieces.Coder(coder.t)
    assert [np.frombuffer(x, "<u4").tolist() for x in fresh.encode(ODD)] == [library.encode(t or "") for t in ODD]
    assert pieces.shortest_paths(coder.t, []) == []
