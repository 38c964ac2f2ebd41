import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidebook.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, want, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, ids in want.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            part = ids[at : at + r.length]
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
            assert r.length == capacity or at == len(ids)
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_documents_against_the_tokenizer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    want = {r.doc_id: plain_ids(tokenizer, r.text) for r in docs.select("doc_id", "text").collect()}
    used = check(packing.pack(docs, PATH).collect(), want, 4096)
    assert used <= 1.02 * sum(map(len, want.values())) / 4096 + 1


def test_odd_texts(spark):
    texts = [None, "", "It's WE'LL don't 'sx", "a\x1cb", "“quoted” naïve Ünï İstanbul ΑΣ", "<|endoftext|> x", "1234 ½ ²", "é", "x" * 3000, "Ab. " * 9000, "¡Hola! ©", "日本語 text", "''' '' 've"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    tokenizer = Tokenizer.from_file(PATH)
    check(packing.pack(docs, PATH, 512).collect(), {i: plain_ids(tokenizer, t) for i, t in enumerate(texts)}, 512)
    repeated = docs.where("doc_id = 4").unionByName(docs.where("doc_id = 4")).unionByName(docs.selectExpr("cast(null as long) doc_id", "text", "length"))
    assert packing.pack(repeated, PATH, 512).count() >= 2 + len(texts)
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_gapless_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 4096])
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), min(capacity, 40))}
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in packing.plan(histogram, capacity):
        ranks[length] += range(rank, rank + n)
        for k in range(n):
            fill[first + k].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    best: list[int] = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        room = [i for i, left in enumerate(best) if left >= length]
        if room:
            i = min(room, key=lambda i: best[i])
            best[i] -= length
        else:
            best.append(capacity - length)
    assert len(fill) == len(best)
