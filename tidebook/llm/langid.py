"""Language identification by nearest centroid.

Texts become hashed character n-gram vectors (one to three letters), weighted by TF-IDF and scaled to
length one. Each language has several centroids, clustered by cosine; a text takes the language of the
centroid with the largest cosine, and is rejected if its distance is beyond what held-back texts of
that language with about as many different n-grams show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import cut, is_held_out

DIMENSIONS = 1 << 13
UNDETERMINED = "und"
_BLOCK = 256
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, or None if it has no letter. Case is ignored, and every run
    of other characters counts as one space."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[code]
    if not is_letter.any():
        return None
    code = np.where(is_letter, code, np.uint32(32))
    code = np.concatenate([np.array([32], np.uint32), code, np.array([32], np.uint32)])
    space = code == 32
    code = code[~(space & np.r_[False, space[:-1]])]
    one = code * np.uint32(2654435761)
    two = (one[:-1] ^ (code[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (code[2:] * np.uint32(668265263))) * np.uint32(374761393)
    total = np.bincount(one >> np.uint32(19), minlength=DIMENSIONS)
    total += np.bincount(two >> np.uint32(19), minlength=DIMENSIONS)
    total += np.bincount(three >> np.uint32(19), minlength=DIMENSIONS)
    return total


def weighted(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one. Terms weigh log(1 + times in 1000 n-grams), so that a long text looks like a
    text of common length in its language."""
    x = np.stack(rows).astype(np.float32)
    x *= 1000 / x.sum(axis=1, keepdims=True)
    np.log1p(x, out=x)
    x *= idf
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Model:
    """languages[k] is the language of centroid k; reach[k, s] the largest distance that it accepts from a text with
    2**s to 2**(s + 1) - 1 different n-grams."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    reach: np.ndarray

    def nearest(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, cosine, rejected) of each row of counts."""
        cosine = weighted(rows, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = cosine.max(axis=1).astype(np.float64)
        return best, top, 1 - top > self.reach[best, _sizes(rows)]


def _sizes(rows: list[np.ndarray]) -> np.ndarray:
    return np.array([int(np.count_nonzero(c)).bit_length() - 1 for c in rows])


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-point starts; fewer rows than k give that many centroids."""
    at = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[at[0]]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[at[-1]])
    centers = x[at].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        for j in range(len(centers)):
            if (own == j).any():
                centers[j] = x[own == j].mean(axis=0)
        centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    return centers


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if (c := counts(text.as_py())) is not None:
                seen += c > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS, dtype=np.int32)), pa.array(np.r_[n, seen])], names=["dim", "df"])


def _windows(text: str) -> list[str]:
    """Runs of 1, 2, 4, ... words from the middle of a text, and the whole of it: what its language looks like in
    texts of every length."""
    words = text.split()
    middle = len(words) // 2
    return [" ".join(words[middle - (1 << k) // 2 : middle + (1 << k) - (1 << k) // 2]) for k in range(max(0, len(words).bit_length() - 1))] + [text]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, dims, tf = [], [], []
        for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (c := counts(text)) is not None:
                at = np.flatnonzero(c)
                lang.append(name)
                dims.append(at.astype(np.int16))
                tf.append(c[at].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(dims, pa.list_(pa.int16())), pa.array(tf, pa.list_(pa.int32()))], names=["lang", "dims", "tf"])


def _distances(idf: np.ndarray, centers: dict[str, np.ndarray]):
    """A task body over (text, lang): (lang, size, far) of every window of each text from its language's centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, float]] = []
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name in centers and (rows := [c for part in _windows(text) if (c := counts(part)) is not None]):
                    far = 1 - (weighted(rows, idf) @ centers[name].T).max(axis=1)
                    out += [(name, int(k), float(x)) for k, x in zip(_sizes(rows), far, strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], names=["lang", "size", "far"])

    return run


def _reach(seen: dict[int, tuple[float, int]], slack: float, enough: int = 20) -> np.ndarray:
    """Per size the largest distance seen, and ``slack`` more; ``seen`` has it and the number of texts by size. A size
    with fewer than ``enough`` texts takes the next smaller one's that has them (all texts' if none has), no size
    accepts less than a larger one, and none a text that shares next to nothing with the centroid."""
    reach = np.full(DIMENSIONS.bit_length(), max(far for far, _ in seen.values()))
    known = sorted(k for k, (_, times) in seen.items() if times >= enough)
    for k in range(len(reach)):
        if known:
            reach[k] = seen[max((s for s in known if s <= k), default=known[0])][0]
    return np.minimum(0.97, slack + np.maximum.accumulate(reach[::-1])[::-1])


def fit(learn: DataFrame, per_language: int = 250, centroids: int = 4, slack: float = 0.1) -> Model:
    """Learn from rows (doc_id, text, lang).

    Document frequencies come from all learning rows. Of each language's different texts, by hash, every other one
    of the first 2 * ``per_language`` gives the centroids; those between, held back, say how far its texts lie from
    its centroids: whole ones, and runs of their words for short texts. The driver receives the vectors of the
    first, one by one, and the largest distance of each size. A centroid accepts distances up to ``slack`` beyond
    the largest that its language's held-back texts of the same size show, or of a smaller size where too few are
    that large. Repeated texts count once, ids do not matter. A language with one text is measured on that text;
    without learning rows the model has no centroid.
    """
    learn = learn.where("text is not null and lang is not null").select("text", "lang")
    df = learn.select("text").mapInArrow(_document_counts, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    seen = np.zeros(DIMENSIONS + 1)
    for r in df:
        seen[r["dim"]] = r["df"]
    n = seen[-1]
    idf = (np.log((1 + n) / (1 + seen[:-1])) + 1).astype(np.float32)
    # per_language * 2 rows a language, whatever the table
    marked = learn.withColumn("h", F.xxhash64("text"))
    # the smallest hashes of 64 parts of each language, then of each language
    some = marked.select("lang", "h", (F.col("h") % 64).alias("part")).distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).where(F.col("k") <= 2 * per_language)
    ranked = some.select("lang", "h").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = ranked.where(F.col("k") <= 2 * per_language).withColumn("held", F.col("k") % 2 == 0).drop("k")
    rows = cut(marked.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("text", "lang", "held"))
    own: dict[str, list[np.ndarray]] = {}
    for r in rows.where("not held").select("text", "lang").mapInArrow(_sparse, "lang string, dims array<smallint>, tf array<int>").toLocalIterator():
        c = np.zeros(DIMENSIONS, np.int32)
        c[np.array(r["dims"])] = r["tf"]
        own.setdefault(r["lang"], []).append(c)
    if not own:
        return Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros((0, 1)))
    centers = {lang: _clusters(weighted(sorted(own.pop(lang), key=lambda c: c.tobytes()), idf), centroids) for lang in sorted(own)}
    back = rows.where("held").select("text", "lang").unionByName(rows.where("not held").select("text", "lang").join(rows.where("held").select("lang").distinct(), "lang", "left_anti"))
    far = back.mapInArrow(_distances(idf, centers), "lang string, size int, far double").groupBy("lang", "size").agg(F.max("far").alias("far"), F.count("*").alias("n"))
    seen_by: dict[str, dict[int, tuple[float, int]]] = {}
    for r in far.collect():
        seen_by.setdefault(r["lang"], {})[r["size"]] = (r["far"], r["n"])
    names = [lang for lang, found in centers.items() for _ in found]
    reaches = {lang: _reach(seen_by.get(lang, {0: (0.97, 1)}), slack) for lang in centers}
    return Model(idf, np.concatenate(list(centers.values())), names, np.stack([reaches[lang] for lang in names]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of (doc_id, text).

    score is the cosine with the nearest centroid. A null text or one without letters is ``und`` with
    score 0 and rejected, and so is every text if nothing could be learned; a text whose distance is
    beyond its centroid's reach keeps the nearest language and is marked rejected. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, _BLOCK):
                found = [counts(t.as_py()) for t in texts[at : at + _BLOCK]]
                n = len(found)
                lang, score, far = [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
                have = [i for i, c in enumerate(found) if c is not None]
                if have and model.languages:
                    best, top, far[have] = model.nearest([found[i] for i in have])
                    score[have] = np.clip(top, 0, 1)
                    for i, b in zip(have, best, strict=True):
                        lang[i] = model.languages[b]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + _BLOCK], pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, per_language: int = 250, centroids: int = 4) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of documents (doc_id, text, lang).

    Learns only from rows outside the held-out fold. Rows with a null doc_id count as learning rows.
    Other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs.where(~is_held_out(F.col("doc_id"))), per_language, centroids)
    return predict(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text the classifier rejects; columns and repeated rows stay."""
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, _BLOCK):
                found = [counts(t.as_py()) for t in batch.column(where)[at : at + _BLOCK]]
                have = [i for i, c in enumerate(found) if c is not None]
                if have and model.languages:
                    keep[at + np.array(have)] = ~model.nearest([found[i] for i in have])[2]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
