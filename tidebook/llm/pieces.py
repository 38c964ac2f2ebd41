"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file compiles to a transducer: a normaliser (dummy prefix, spaces to the space mark), a trie
of pieces whose accepting arcs carry weights in the tropical semiring, and byte fallback for single
characters. Composed with an input, its states are (position, last piece). For unigram models an arc
weighs minus the piece's score. For BPE models an arc weighs one, and the arc from one piece to the
next exists only if merging would leave that pair apart; exactly one such path spells an input, so the
shortest path is the sequence that merging gives. Inputs are cut where no piece can reach across, and
the distinct parts are composed together, a batch at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
_FAR = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Transducer:
    """Arrays of a compiled model. Symbols are piece ids, and further numbers for characters that occur in
    pieces without being one; -1 is any other character."""

    texts: list[bytes]  # of each id, as decoded
    byte_ids: list[int]
    symbols: dict[str, int]  # of single characters
    formed: np.ndarray  # of each symbol: 0 for a character, else the place of its merge in the order
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray  # left symbol << 32 | right symbol, sorted
    pair_formed: np.ndarray
    trie_keys: np.ndarray  # node << 32 | code point, sorted
    trie_next: np.ndarray
    accepts: np.ndarray  # of each node: the piece that ends there, or -1
    weights: np.ndarray  # of each symbol
    unknown_weight: float
    constrained: bool
    longest: int
    prefix: bool
    parts: str  # pattern of the parts that are composed on their own

    @property
    def pieces(self) -> int:
        return len(self.texts)


def _merged(text: str, ranks: dict[str, int], trace: dict[str, tuple[str, str]] | None = None) -> list[str]:
    """Merge by the order of ranks, leftmost first: the plain form of BPE."""
    parts = list(text)
    while len(parts) > 1:
        best = min(((ranks.get(a + b, _FAR), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(_FAR, 0))
        if best[0] == _FAR:
            break
        i = best[1]
        if trace is not None and len(parts) == 2:
            trace[text] = (parts[0], parts[1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def compile_model(path: str) -> Transducer:
    """Read a model file and compile its transducer. Models with a character map, with user-defined
    symbols or with a mark at word ends are refused."""
    with open(path, "rb") as f:
        data = f.read()
    names, scores, kinds, constrained, prefix = [], [], [], False, True
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            names.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            constrained = spec.get(3, 1) == 2
            if spec.get(24):
                raise ValueError("a mark at word ends is not supported")
        elif number == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("only identity normalisation is supported")
    if USER in kinds:
        raise ValueError("user-defined symbols are not supported")
    plain = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
    order = sorted((n for n in plain if len(n) > 1), key=lambda n: (-scores[plain[n]], plain[n]))
    level, ranks = 0, {}
    for k, n in enumerate(order):
        level += k == 0 or scores[plain[n]] != scores[plain[order[k - 1]]]
        ranks[n] = level
    symbols = {c: plain.get(c, -1) for n in plain for c in n}
    for c in sorted(c for c, i in symbols.items() if i < 0):
        symbols[c] = len(names) + sum(i >= len(names) for i in symbols.values())
    count = len(names) + sum(i >= len(names) for i in symbols.values())
    formed, left, right = np.zeros(count, np.int64), np.arange(count), np.arange(count)
    reached = dict.fromkeys(symbols)
    trace: dict[str, tuple[str, str]] = {}
    number_of = lambda s: symbols[s] if len(s) == 1 else plain[s]
    pairs = {}
    for n in order:
        if not constrained or _merged(n, ranks, trace) == [n]:
            reached[n] = None
            formed[plain[n]] = ranks[n]
            if constrained:
                left[plain[n]], right[plain[n]] = map(number_of, trace[n])
        for k in range(1, len(n)):
            a, b = n[:k], n[k:]
            if (len(a) == 1 or a in plain) and (len(b) == 1 or b in plain):
                pairs[number_of(a) << 32 | number_of(b)] = ranks[n]
    pair_keys = np.array(sorted(pairs), np.int64)
    arcs, accepts = {}, [-1]
    for n in [*order, *(c for c in symbols if symbols[c] < len(names))]:
        if n not in reached:
            continue
        node = 0
        for c in n:
            key = node << 32 | ord(c)
            if key not in arcs:
                arcs[key] = len(accepts)
                accepts.append(-1)
            node = arcs[key]
        accepts[node] = plain[n]
    trie_keys = np.array(sorted(arcs), np.int64)
    weights = np.ones(count) if constrained else -np.array([*scores, *[0.0] * (count - len(scores))])
    inside = {c for n in order for c in n}
    across = any(MARK in n.lstrip(MARK) for n in order)
    lone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inside)
    marks = {c for c in map(chr, range(33, 127)) if not c.isalnum() and c in inside}
    while late := {b for n in order for a, b in zip(n, n[1:], strict=False) if b in marks and a != MARK and a not in marks}:
        marks -= late
    open_ = "".join(map(re.escape, sorted(marks)))  # no piece leads from another character to one of these
    parts = rf"[{lone}]|{MARK}*[^{MARK}{lone}{open_}]+" + (rf"|{MARK}*[{open_}][^{MARK}{lone}]*" if open_ else "") + rf"|{MARK}+"
    texts = [bytes([int(n[3:-1], 16)]) if k == BYTE else n.replace(MARK, " ").encode() if k == NORMAL else b"" if k == CONTROL else " ⁇ ".encode() for n, k in zip(names, kinds, strict=True)]
    byte_ids = [next((i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == BYTE and n == f"<0x{b:02X}>"), kinds.index(UNKNOWN)) for b in range(256)]
    return Transducer(
        texts, byte_ids, symbols, formed, left, right, pair_keys, np.array([pairs[k] for k in pair_keys.tolist()], np.int64), trie_keys,
        np.array([arcs[k] for k in trie_keys.tolist()], np.int64), np.array(accepts, np.int64), weights, 1.0 if constrained else 10.0 - min(scores, default=0.0),
        constrained, max(map(len, plain), default=1), prefix, "(?s:.+)" if across else parts,
    )


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), other, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], other)


def _apart(t: Transducer, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves the symbols a and b apart: undo the later merge of the two until both are
    characters, and see that no merge across them would have come before the one undone."""
    a, b = a.copy(), b.copy()
    limit, fine, live = np.full(len(a), _FAR), np.ones(len(a), bool), np.arange(len(a))
    while len(live):
        x, y = a[live], b[live]
        across = np.where((x < 0) | (y < 0), _FAR, _find(t.pair_keys, t.pair_formed, x << 32 | y, _FAR))
        bad = across < limit[live]
        fine[live[bad]] = False
        fx, fy = np.where(x < 0, 0, t.formed[x]), np.where(y < 0, 0, t.formed[y])
        more = ~bad & ((fx > 0) | (fy > 0))
        live, x, y, fx, fy = live[more], x[more], y[more], fx[more], fy[more]
        first = fx > fy
        limit[live] = np.where(first, fx, fy + 1)
        a[live] = np.where(first, t.right[x], x)
        b[live] = np.where(first, y, t.left[y])
    return fine


def shortest_paths(t: Transducer, parts: list[str]) -> list[list[int]]:
    """Symbols on the shortest path of each part."""
    symbols, ends = flat_paths(t, parts)
    return [path.tolist() for path in np.split(symbols, ends[:-1])[: len(parts)]]


def flat_paths(t: Transducer, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols on the shortest paths of all parts, one after another, and where each ends. All parts are composed at
    once: positions are relaxed in order, and from each the trie is walked for all parts together. The paths
    are read back from their ends together too, a symbol of each at a time."""
    size = np.array([len(p) for p in parts])
    width = int(size.max(initial=0))
    code = np.full((len(parts), width + t.longest), -1, np.int64)
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code[np.arange(width + t.longest) < size[:, None]] = flat
    alone = np.full(int(flat.max(initial=0)) + 1, -1, np.int64)
    for c in set("".join(parts)):
        alone[ord(c)] = t.symbols.get(c, -1)
    best = np.full((len(parts), width + 1), np.inf)
    last = np.full((len(parts), width + 1), -1, np.int64)
    back = np.zeros((len(parts), width + 1), np.int64)
    best[:, 0] = 0

    def relax(rows: np.ndarray, i: int, n: int, symbol: np.ndarray) -> None:
        weight = np.where(symbol < 0, t.unknown_weight, t.weights[symbol])
        if not t.constrained:
            weight = np.where(symbol >= t.pieces, t.unknown_weight, weight)
        cost = best[rows, i] + weight
        better = cost < best[rows, i + n]
        if t.constrained and i:
            at = np.flatnonzero(better)
            better[at] = _apart(t, last[rows[at], i], symbol[at])
        rows, cost, symbol = rows[better], cost[better], symbol[better]
        best[rows, i + n], last[rows, i + n], back[rows, i + n] = cost, symbol, i

    for i in range(width):
        rows = np.flatnonzero(size > i)
        node = np.zeros(len(rows), np.int64)
        relax(rows, i, 1, alone[code[rows, i]])
        for n in range(1, t.longest + 1):
            here = code[rows, i + n - 1]
            node = np.where(here < 0, -1, _find(t.trie_keys, t.trie_next, node << 32 | here, -1))
            live = node >= 0
            rows, node = rows[live], node[live]
            if not len(rows):
                break
            symbol = t.accepts[node]
            if n > 1 and (symbol >= 0).any():
                relax(rows[symbol >= 0], i, n, symbol[symbol >= 0])
    path, count = np.zeros((len(parts), width), np.int64), np.zeros(len(parts), np.int64)
    rows, end = np.flatnonzero(size), size[size > 0]
    while len(rows):
        count[rows] += 1
        path[rows, width - count[rows]] = last[rows, end]
        end = back[rows, end]
        rows, end = rows[end > 0], end[end > 0]
    return path[np.arange(width) >= width - count[:, None]], np.cumsum(count)


class Coder:
    """Encodes and decodes with one transducer; a bounded cache holds the ids of parts seen."""

    def __init__(self, transducer: Transducer, most: int = 500_000):
        self.t, self.most, self.cache = transducer, most, {}
        self.split = re.compile(transducer.parts)

    def _learn(self, parts: list[str]) -> None:
        parts = sorted(parts, key=len)
        count = self.t.pieces
        at = 0
        while at < len(parts):
            n = max(1, min(20_000, 400_000 // max(1, len(parts[at]))))
            some = [p for p in parts[at : at + n] if len(p) <= 2 * len(parts[at]) + 8]
            at += len(some)
            symbols, ends = flat_paths(self.t, some)
            strange = np.r_[0, np.cumsum((symbols < 0) | (symbols >= count))]
            starts = np.r_[0, ends[:-1]]
            data, odd = symbols.astype("<u4").tobytes(), (strange[ends] > strange[starts]).tolist()
            for part, start, end, fall_back in zip(some, starts.tolist(), ends.tolist(), odd, strict=True):
                if not fall_back:
                    self.cache[part] = data[4 * start : 4 * end]
                    continue
                ids: list[int] = []
                place = 0
                for symbol in symbols[start:end].tolist():
                    if 0 <= symbol < count:
                        ids.append(symbol)
                        place += len(self.t.texts[symbol].decode())
                    else:
                        ids += [self.t.byte_ids[b] for b in part[place].encode("utf-8", "surrogatepass")]
                        place += 1
                self.cache[part] = array("I", ids).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian uint32; null and empty texts have none."""
        for at in range(0, len(texts), 256):
            split = []
            for text in texts[at : at + 256]:
                normal = (" " * self.t.prefix + text).replace(" ", MARK) if text else ""
                split.append(self.split.findall(normal))
            new = set().union(*split).difference(self.cache)
            if len(self.cache) + len(new) > self.most:
                self.cache.clear()
                new = set().union(*split)
            self._learn(list(new))
            for parts in split:
                yield b"".join(map(self.cache.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        """The text that ids spell: bytes joined, invalid ones replaced, without the dummy prefix."""
        text = b"".join(map(self.t.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.t.prefix and text.startswith(" ") else text


def normalized(text: str | None) -> str:
    """What decoding gives back: the space mark reads as a space."""
    return (text or "").replace(MARK, " ")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of a model file, compiled once in each worker."""
    if path not in _coders:
        _coders[path] = Coder(compile_model(path))
    return _coders[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text). Null and empty texts have no ids; repeated rows and
    null doc_ids stay; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(1)[at : at + 512].to_pylist()
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder(model).encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 512], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else coder(model).decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def summarize(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, n_bytes, ids_crc32, decoded_chars, round_trip) of every row: how many ids, how many of
    them from byte fallback, the checksum of the ids (little-endian uint32), and what decoding them gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(1)[at : at + 512].to_pylist()
                c = coder(model)
                fallback = np.isin(np.arange(c.t.pieces), c.t.byte_ids)
                rows = []
                for text, data in zip(texts, c.encode(texts), strict=True):
                    ids = np.frombuffer(data, "<u4")
                    back = c.decode(ids.tolist())
                    rows.append((len(ids), int(fallback[ids].sum()), zlib.crc32(data), len(back), back == normalized(text)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 512], *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_ids", "n_bytes", "ids_crc32", "decoded_chars", "round_trip"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_ids long, n_bytes long, ids_crc32 long, decoded_chars long, round_trip boolean")
