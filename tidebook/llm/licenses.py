"""Licence scan with a positional index of rare words.

Document frequencies over the whole corpus rank the words of the licence templates. Each template is
indexed under its rarest words with their positions; a file looks up those it holds, the postings are
intersected on the start that they imply, and the template's mandatory key phrase is verified there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases whose every place is counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Further template texts: label, text, mandatory key phrase.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
    ("epl-2", "eclipse public license 2 0", "eclipse public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
)


_FSF = "as published by the free software foundation"

# Notices and names of licences; each is mandatory as a whole.
NOTICES = {
    "academic-3": ("academic free license version 3 0",),
    "agpl-3": (f"gnu affero general public license {_FSF} either version 3",),
    "apache-2": ("apache license 2 0", "apache 2 0 license"),
    "artistic-2": ("the artistic license 2 0", "artistic license version 2 0"),
    "boost-1": ("boost software license version 1 0",),
    "bsd": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-3": ("be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-4": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "business-1.1": ("business source license 1 1",),
    "cc-by": ("creative commons attribution 4 0", "creative commons attribution 3 0", "cc by 4 0", "cc by 3 0"),
    "cc-by-nc": ("creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 3 0"),
    "cc-by-nc-nd": ("creative commons attribution noncommercial noderivatives 4 0", "cc by nc nd 4 0"),
    "cc-by-nc-sa": ("creative commons attribution noncommercial sharealike 4 0", "cc by nc sa 4 0"),
    "cc-by-nd": ("creative commons attribution noderivatives 4 0", "cc by nd 4 0"),
    "cc-by-sa": ("creative commons attribution share alike", "cc by sa 4 0", "cc by sa 3 0"),
    "cc0": ("creative commons zero", "creative commons cc0"),
    "cddl-1": ("common development and distribution license",),
    "ecl-2": ("educational community license version 2 0",),
    "elastic-2": ("elastic license 2 0",),
    "epl-1": ("eclipse public license v1 0", "eclipse public license version 1 0"),
    "epl-2": ("eclipse public license v 2 0", "eclipse public license v2 0", "eclipse public license version 2 0"),
    "eupl": ("european union public licence",),
    "gfdl": ("gnu free documentation license",),
    "gpl-2": (f"gnu general public license {_FSF} either version 2", f"gnu general public license version 2 {_FSF}", f"gnu general public license {_FSF} version 2"),
    "gpl-3": (f"gnu general public license {_FSF} either version 3", f"gnu general public license version 3 {_FSF}", f"gnu general public license {_FSF} version 3"),
    "lgpl-2": (f"gnu library general public license {_FSF} either version 2",),
    "lgpl-2.1": (f"gnu lesser general public license {_FSF} either version 2 1",),
    "lgpl-3": (f"gnu lesser general public license {_FSF} either version 3",),
    "mit": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mpl-1.1": ("subject to the mozilla public license version 1 1",),
    "mpl-2": ("subject to the terms of the mozilla public license v 2 0",),
    "ms-pl": ("microsoft public license",),
    "ms-rl": ("microsoft reciprocal license",),
    "ncsa": ("university of illinois ncsa open source license",),
    "odbl": ("open database license",),
    "ofl-1.1": ("sil open font license version 1 1",),
    "openssl": ("this product includes software developed by the openssl project",),
    "osl-3": ("open software license version 3 0",),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",),
    "psf-2": ("python software foundation license version 2",),
    "sspl-1": ("server side public license",),
    "upl-1": ("universal permissive license",),
    "wtfpl": ("do what the fuck you want to public license",),
    "zlib": ("in no event will the authors be held liable for any damages arising from the use of this software",),
}

# Identifiers that follow "SPDX-License-Identifier:", with their labels.
IDENTIFIERS = {
    "0BSD": "0bsd", "AFL-3.0": "academic-3", "AGPL-3.0": "agpl-3", "Apache-2.0": "apache-2", "Artistic-2.0": "artistic-2", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd-3",
    "BSD-4-Clause": "bsd-4", "BSL-1.0": "boost-1", "BUSL-1.1": "business-1.1", "CC-BY-4.0": "cc-by", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-NC-ND-4.0": "cc-by-nc-nd",
    "CC-BY-NC-SA-4.0": "cc-by-nc-sa", "CC-BY-ND-4.0": "cc-by-nd", "CC-BY-SA-4.0": "cc-by-sa", "CC0-1.0": "cc0", "CDDL-1.0": "cddl-1", "ECL-2.0": "ecl-2", "EPL-1.0": "epl-1",
    "EPL-2.0": "epl-2", "EUPL-1.2": "eupl", "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "ISC": "isc", "LGPL-2.1": "lgpl-2.1", "LGPL-3.0": "lgpl-3", "MIT": "mit", "MPL-1.1": "mpl-1.1",
    "MPL-2.0": "mpl-2", "NCSA": "ncsa", "ODbL-1.0": "odbl", "OFL-1.1": "ofl-1.1", "OSL-3.0": "osl-3", "PostgreSQL": "postgresql", "Unlicense": "unlicense", "UPL-1.0": "upl-1", "Zlib": "zlib",
}

@dataclass
class Template:
    """anchors: the positions of its rarest words; keys: where the key phrase starts, and its words."""

    label: str
    base: bool
    words: list[bytes]
    anchors: list[int]
    key_at: int
    key: list[bytes]
    weight: np.ndarray


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _texts() -> list[tuple[str, bool, list[bytes], list[bytes]]]:
    """(label, whether a base phrase, words, words of the key phrase) of every template."""
    out = [(label, True, words(p), words(p)) for p, label in BASE.items()]
    out += [(label, False, words(text), words(key)) for label, text, key in TEMPLATES]
    out += [(label, False, words(p), words(p)) for label, phrases in NOTICES.items() for p in phrases]
    return out + [(label, False, of, of) for name, label in IDENTIFIERS.items() for of in (words(f"SPDX-License-Identifier: {name}"),)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary, seen, n = {w for t in _texts() for w in t[2]}, Counter(), 0
    for batch in batches:
        for text in batch.column(0):
            n += 1
            seen.update(vocabulary.intersection(words(text.as_py())))
    names = ["", *(w.decode() for w in seen)]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n, *seen.values()], pa.int64())], names=["word", "df"])


def index(docs: DataFrame, rarest: int = 3) -> list[Template]:
    """Templates with their ``rarest`` highest-IDF words as anchors; frequencies are of all documents.
    The driver receives one number per word of the templates."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "word string, df long")
    df = {r["word"].encode(): r["df"] for r in rows.groupBy("word").agg(F.sum("df").alias("df")).collect()}
    n = df.get(b"", 0)
    out = []
    for label, base, text, key in _texts():
        weight = np.array([math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in text])
        anchors = sorted(range(len(text)), key=lambda i: (-weight[i], i))[:rarest]
        key_at = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
        out.append(Template(label, base, text, sorted(anchors), key_at, key, weight / weight.sum()))
    return out


def scan_text(found: list[bytes], templates: list[Template], postings: dict[bytes, list[tuple[int, int]]], cover: float = 0.6) -> tuple[list[int], set[str], set[str], float]:
    """Starts of base phrases, base labels, all labels and the best share of a template's weight."""
    votes: Counter[tuple[int, int]] = Counter()
    for at, w in enumerate(found):
        if w in postings:
            votes.update((t, at - i) for t, i in postings[w])
    starts, base, labels, score = [], set(), set(), 0.0
    for (t, start), n in votes.items():
        x = templates[t]
        if n < (len(x.anchors) if x.base else min(2, len(x.anchors))) or start + x.key_at < 0:
            continue
        if found[start + x.key_at : start + x.key_at + len(x.key)] != x.key:
            continue
        share = float(sum(w for k, w in enumerate(x.weight) if 0 <= start + k < len(found) and found[start + k] == x.words[k]))
        if x.base:
            starts.append(start)
            base.add(x.label)
        if share >= cover:
            labels.add(x.label)
        score = max(score, round(share, 9))
    return starts, base, labels | base, min(1.0, score)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of
    (doc_id, text).

    A template is found where its key phrase stands, at least two of its anchors with it, and 0.6 of its weight by
    IDF; score is the largest such share of any template whose key and anchors are found. Null and empty texts have no
    words, no labels and score 0. Repeated rows and null ids stay; an empty table gives no rows; other columns are
    ignored.
    """
    templates = index(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, x in enumerate(templates):
            for i in x.anchors:
                postings.setdefault(x.words[i], []).append((t, i))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                starts, base, labels, score = scan_text(found, templates, postings)
                out.append((doc_id, len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
