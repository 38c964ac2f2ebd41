"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenized once and cut into pieces of at most ``capacity`` tokens. The driver sees only
how many pieces have each length (at most ``capacity`` numbers), packs those counts best-fit from the
longest down, and gets runs: so many pieces of one length, from one rank on, go one each to successive
sequences at one offset. Pieces are ranked within their length by Spark and look up their run.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import cut

CAPACITY = 4096
END = 1
SALTS = 64
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Exact ids of a word-level BPE tokenizer (lower case, word ends), as little-endian uint32 bytes.

    Texts of ASCII and Latin-1 letters are split here by the tokenizer's own word pattern and their
    words looked up in a bounded cache, which the tokenizer fills. Any other text, and one that may
    hold a special token, goes to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.most = most
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.is_end[ends] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = self._ids(" ".join(some))
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some):
                data, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.cache.update((w, data[a:b]) for w, a, b in zip(some, bounds[:-1], bounds[1:], strict=True))
            else:
                self.cache.update((w, self._ids(w).tobytes()) for w in some)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        for at in range(0, len(texts), 64):
            split = [_WORDS.findall(t.lower()) if "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts[at : at + 64]]
            new = set().union(*(w for w in split if w)).difference(self.cache)
            if len(self.cache) + len(new) > self.most:
                self.cache.clear()
                new = set().union(*(w for w in split if w))
            self._learn(sorted(new))
            for t, words in zip(texts[at : at + 64], split, strict=True):
                yield self._ids(t).tobytes() if words is None else b"".join(map(self.cache.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut every ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            texts = batch.column(1)
            for at in range(0, len(ids), 512):
                some = [t or "" for t in texts[at : at + 512].to_pylist()]
                for doc_id, data in zip(ids[at : at + 512], encoder(tokenizer).encode(some), strict=True):
                    data += end
                    for k, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        out.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing over counts: runs (length, first rank, pieces, first sequence, offset).

    Sequences with equal room are handled together, so the work depends on how many lengths there
    are, not on how many pieces.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, how many)
    order: list[int] = []
    opened = 0

    def give(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(order, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            at = bisect_left(order, length)
            if at < len(order):
                left = order[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    order.pop(at)
            else:
                left, first, n = capacity, opened, -(-todo // (capacity // length))
                opened += n
            each = left // length
            full = min(n, todo // each)
            for k in range(each if full else 0):
                runs.append((length, rank, full, first, capacity - left + k * length))
                rank += full
            todo -= full * each
            give(left - each * length, first, full)
            rest = n - full
            if rest and 0 < todo < each:
                for k in range(todo):
                    runs.append((length, rank, 1, first + full, capacity - left + k * length))
                    rank += 1
                give(left - todo * length, first + full, 1)
                todo, full, rest = 0, full + 1, rest - 1
            give(left, first + full, rest)
    return runs


def _slots(runs: list[tuple[int, int, int, int, int]]):
    """A task body that gives each ranked piece the sequence and offset of its run."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    starts = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            own = table[np.searchsorted(starts, (length << 48) + rank, side="right") - 1]
            sequence = own[:, 3] + rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(own[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place.

    Null and empty texts are the end id alone. Repeated rows and rows with a null doc_id are packed
    like any other; ties in rank are broken by doc_id, piece and content. An empty table gives no rows.
    """
    made = cut(pieces(docs, tokenizer, capacity))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(own)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k") - 1).alias("rank"))
    return ranked.mapInArrow(_slots(plan(histogram, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
