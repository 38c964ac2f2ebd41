import math
import re

from tidebook.llm import licenses


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_documents_against_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_odd_texts(spark):
    texts = [None, "", "Apache License, Version 2.0 apache license version 2", "under the under the MIT license CC-BY-NC cc by cc by nc", "cc by", "GNU General Public License, version 3.", "é under the MIT licensé", "x " * 50000 + "under the mit license", "under\x00the\nMIT-License"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(docs.unionByName(docs)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t)
    assert got[5].labels == "gpl-3" and got[5].score == 1.0 and got[2].score == 1.0
    assert licenses.scan(docs.limit(0)).count() == 0


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def templates():
    for phrase, label in licenses.BASE.items():
        yield label, phrase, phrase, 3
    for label, text, key in licenses.TEMPLATES:
        yield label, text, key, 2
    for label, phrases in licenses.NOTICES.items():
        for p in phrases:
            yield label, p, p, 2
    for name, label in licenses.IDENTIFIERS.items():
        yield label, f"spdx license identifier {name}", f"spdx license identifier {name}", 2


def by_force(texts):
    """(labels, score) of each text: every template tried at every place of the text."""
    found = [split(t) for t in texts]
    sets = [set(x) for x in found]
    of = {}
    ready = []
    for label, text, key, need in templates():
        own, must = split(text), split(key)
        for w in own:
            of.setdefault(w, math.log((1 + len(texts)) / (1 + sum(w in s for s in sets))) + 1)
        anchors = sorted(range(len(own)), key=lambda i: (-of[own[i]], i))[:3]
        at = next(i for i in range(len(own)) if own[i : i + len(must)] == must)
        ready.append((label, own, must, min(need, len(anchors)), anchors, at, sum(of[w] for w in own)))
    out = []
    for x in found:
        labels, score = set(), 0.0
        for label, own, must, need, anchors, at, total in ready:
            for p in range(len(x) - len(must) + 1):
                start = p - at
                if x[p : p + len(must)] != must or sum(0 <= start + i < len(x) and x[start + i] == own[i] for i in anchors) < need:
                    continue
                share = sum(of[w] for k, w in enumerate(own) if 0 <= start + k < len(x) and x[start + k] == w) / total
                score = max(score, share)
                labels |= {label} if share >= 0.6 else set()
        out.append((",".join(sorted(labels)), score))
    return out


NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
BSD = "3. Neither the name of Example Labs nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_labels_and_score_against_every_template_everywhere(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.orderBy("doc_id").limit(150).collect()]
    texts += [f"// {text.upper()}. x" for _, text, _, _ in templates()] + [" ".join(text.split()[2:]) for _, text, _, _ in templates()]
    texts += [NOTICE, BSD, "SPDX-License-Identifier: Apache-2.0 OR MIT", "Creative Commons Attribution 4.0", "spdx license", "in the public domain", "gnu", "license " * 200, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = by_force(texts)
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    for i, (labels, score) in enumerate(want):
        assert got[i].labels == labels, texts[i]
        assert abs(got[i].score - score) < 1e-6, texts[i]


def test_common_notices_get_their_labels(spark):
    texts = [NOTICE, "/* SPDX-License-Identifier: Apache-2.0 */", BSD, "Text under Creative Commons Attribution 4.0 International", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under CC-BY-NC-SA 4.0", "the license of this public work is version 2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(rows).collect()}
    assert [got[i] for i in range(7)] == ["gpl-3", "apache-2", "bsd-3", "cc-by", "gpl-2", "cc-by-nc,cc-by-nc-sa", ""]


def test_at_least_thirty_licences():
    labels = {label for label, _, _, _ in templates()}
    assert len(labels) >= 30
