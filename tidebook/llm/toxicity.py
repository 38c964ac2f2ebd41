"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding maps look-alike letters, accents, digits and symbols used as letters to one plain letter. The
lexicon (whole words, and stems that match at a word's start) is learned from labelled texts by
log-odds; matches inside exception phrases do not count; the summed weight is normalised by length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut, is_held_out

# Characters that stand for a plain letter. l and i fold together, as 1 stands for either.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "i",
}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i"}
# Harmless phrases that hold a word of the lexicon.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "circus clown", "pond scum", "idiot proof", "sore loser", "stupid simple")
STEMS = (4, 5, 6, 7, 8)
COPY_WORDS = 20
_INSIDE = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        char = chr(code)
        if unicodedata.category(char) in ("Mn", "Me", "Cf"):
            out = ""
        else:
            first = unicodedata.normalize("NFKD", char.lower())[0]
            first = LOOKALIKES.get(first, first)
            out = first if first.isalnum() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Plain letters and digits, words parted by spaces, with a space at either end."""
    if not text:
        return " "
    if any(c in text for c in "@$!|"):
        text = _INSIDE.sub(lambda m: "".join(SYMBOLS[c] for c in m[0]), text)
    return f" {text.translate(_FOLD)} "


@dataclass
class Lexicon:
    """patterns: folded " word " or " stem" to weight; exceptions: folded phrases; p = sigmoid(scale * x + shift)."""

    patterns: dict[str, float]
    exceptions: tuple[str, ...]
    scale: float
    shift: float

    def automaton(self):
        found = ahocorasick.Automaton()
        for k, w in self.patterns.items():
            found.add_word(k, (len(k), w))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found


def strength(folded: str, automaton) -> float:
    """Summed weight of the matches outside exception phrases, over a norm that grows with the logarithm
    of the number of words. One word counts once, by its heaviest pattern."""
    hits: dict[int, float] = {}
    spans: list[tuple[int, int]] = []
    if len(automaton):
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))
    free: list[list[int]] = []  # stretches of exception phrases, merged
    for a, b in sorted(spans):
        if free and a <= free[-1][1]:
            free[-1][1] = max(b, free[-1][1])
        else:
            free.append([a, b])
    total, k = 0.0, 0
    for s in sorted(hits):
        while k < len(free) and free[k][1] <= s:
            k += 1
        if k == len(free) or s < free[k][0]:
            total += hits[s]
    return total / (1 + math.log1p(folded.count(" ") / 500)) if total else 0.0


def _patterns(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) >= n)]


def _terms(folded: str) -> set[str]:
    return {p for w in set(folded.split()) for p in _patterns(w)}


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, sig): sig is the smallest hash of five-word runs, which near copies mostly share; texts of fewer
    than COPY_WORDS words, which are alike by chance, have one by their id."""
    for batch in batches:
        sigs = []
        for text, doc_id in zip(batch.column(0), batch.column(2), strict=True):
            words = fold(text.as_py()).split()
            runs = (" ".join(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= COPY_WORDS else [f"#{doc_id.as_py()}"]
            sigs.append(min(map(xxhash.xxh64_intdigest, runs)) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.int64())], names=["text", "toxic", "sig"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pos, neg = Counter(), Counter()
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            (pos if toxic.as_py() else neg).update(_terms(fold(text.as_py())))
        terms = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], names=["term", "pos", "neg"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, word, term) for every word of each text and every term that matches it."""
    for batch in batches:
        for text, sig in zip(batch.column(0), batch.column(1), strict=True):
            words = sorted(set(fold(text.as_py()).split()))
            for at in range(0, len(words), 10_000):
                rows = [(w, p) for w in words[at : at + 10_000] for p in _patterns(w)]
                yield pa.RecordBatch.from_arrays([pa.array([sig.as_py()] * len(rows), pa.int64()), pa.array([w for w, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string())], names=["sig", "word", "term"])


def _chosen(texts: DataFrame, candidates: DataFrame, depth: int = 2, least: int = 3) -> DataFrame:
    """The ``candidates`` (term, weight, gain) that at least ``least`` toxic texts vote for. A text votes for its
    ``depth`` terms of most gain, at most one term a word (on ties the whole word, then the longer stem). Terms that
    only travel with better ones get no votes."""
    best = F.max(F.struct("gain", F.col("term").endswith(" ").alias("whole"), F.length("term").alias("size"), "term", "weight")).alias("t")
    words = texts.where("toxic = 1").select("text", "sig").mapInArrow(_words, "sig long, word string, term string").join(candidates, "term").groupBy("sig", "word").agg(best)
    votes = words.groupBy("sig").agg(F.slice(F.sort_array(F.collect_set("t"), asc=False), 1, depth).alias("t")).select(F.explode("t").alias("t"))
    return votes.groupBy("t.term", "t.weight").agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


def _calibrate(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic regression on one variable (values x, each seen ``times``) with a small ridge, classes weighted alike."""
    size = [max(1, times[y == k].sum()) for k in (0, 1)]
    weight = times * np.where(y == 1, 0.5 / size[1], 0.5 / size[0])
    top = max(x.max(), 1e-9)
    z, beta = np.stack([x / top, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (weight * (p - y)) + 1e-6 * beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return float(beta[0] / top), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn a lexicon from documents (doc_id, text) and labels (doc_id, toxic) outside the held-out fold.

    The fit takes at most ``sample`` labelled documents (those with the smallest hash of their id); near copies of
    one label count once, by the text of the smallest hash, so the lexicon is the same however the rows are dealt. A term is a candidate if it would be surprising, over all terms that three toxic texts hold, for its texts to
    be toxic by chance; of the candidates those stay that toxic texts vote for. Texts and counts stay in Spark: the
    driver gets the lexicon and how often each strength occurs. Labels that are null or neither 0 nor 1 are ignored;
    of contradicting labels the toxic one counts. Without labelled texts of both kinds, or with too few to show any
    term, the lexicon is empty and every score near 0; a text without a match never scores 0.5.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "doc_id")
    marked = labelled.mapInArrow(_marks, "text string, toxic int, sig long")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t")  # of near copies always the same text
    texts = cut(marked.groupBy("sig", "toxic").agg(one).select("t.text", "toxic", "sig"))
    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = size.get(1, 0), size.get(0, 0)
    empty = Lexicon({}, (), 1.0, -20.0)
    if not p or not n:
        return empty
    counted = texts.select("text", "toxic").mapInArrow(_term_counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    tested = cut(counted.where("pos >= 3"))
    often = tested.where(F.col("pos") * n > 20 * F.col("neg") * p)
    # Chernoff's bound on the binomial tail: so many toxic ones among a term's texts, at the classes' shares
    share = p / (p + n)
    both = F.col("pos") + F.col("neg")
    excess = F.col("pos") * F.log(F.col("pos") / (both * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (both * (1 - share)))).otherwise(0.0)
    weight = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    candidates = often.where(excess >= math.log(max(1, tested.count()) * 1000)).select("term", weight.alias("weight"), (F.col("pos") * weight).alias("gain"))
    patterns = {r["term"]: r["weight"] for r in _chosen(texts, candidates).collect()}
    if not patterns:
        return empty
    raw = Lexicon(patterns, tuple(fold(e) for e in exceptions), 1.0, 0.0)
    scored = texts.select("text", "toxic").mapInArrow(_strengths(raw), "x double, toxic int").groupBy(F.round("x", 2).alias("x"), "toxic").agg(F.count("*").alias("n")).orderBy("x", "toxic").collect()
    scale, shift = _calibrate(*(np.array([r[k] for r in scored], np.float64) for k in ("x", "toxic", "n")))
    return Lexicon(patterns, raw.exceptions, scale, min(shift, -1.0)) if scale > 0 else empty


def _strengths(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            x = [strength(fold(t.as_py()), machine) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1).cast(pa.int32())], names=["x", "toxic"])

    return run


def scores(docs: DataFrame, lexicon: Lexicon, name: str = "_toxicity") -> DataFrame:
    """``docs`` with a last column ``name`` (0 to 1) for every row; null and empty texts have no match. A column
    that is called so already is an error."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    marked = docs.withColumn(name, F.lit(0.0))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            x = np.array([strength(fold(t.as_py()), machine) for t in batch.column(where)], dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(lexicon.scale * x + lexicon.shift, -50, 50)))
            yield batch.set_column(batch.num_columns - 1, name, pa.array(p))

    return marked.mapInArrow(run, marked.schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents (doc_id, text, ...).

    Repeated rows and null ids stay; an empty table gives no rows; other columns are ignored.
    """
    found = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels, sample))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; columns and repeated rows stay."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return scores(docs, fit(docs, labels), name).where(F.col(name) < 0.5).drop(name)
