"""Hard negatives by exact inner-product search in an STR-packed R-tree.

The vectors are sorted into slabs by Spark's range partitioning, and each slab is tiled on, dimension by dimension, into
leaves of a few hundred vectors (sort-tile-recursive). The leaves are a table: the tree is built once and every search
reads it. A box bounds each coordinate, so a query's inner product with what lies inside has an interval per
coordinate, and their sum bounds the score. A best-first queue opens the box of the highest bound, and leaves out boxes
whose interval misses the wanted score windows or ends strictly below the k-th score found so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import cut

LEAF, FANOUT, SPLIT_DIMS = 256, 16, 5
LONG = np.iinfo(np.int64)
_LEAVES = "block int, dims int, ids array<bigint>, labels array<bigint>, width int, vecs binary"


def whole_vectors(table: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, each component x as floor(scale * x).

    Left out are rows with a null id, label or vector, and with a null or non-finite component. Components beyond
    a long are cut to its ends."""
    raw = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), raw.alias("raw"))
    rows = rows.where("vec_id is not null and label is not null and raw is not null").where(F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", "label", F.transform("raw", lambda x: F.floor(x * scale).cast("double")).alias("vec"))


def str_tiles(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf: sorted by the dimension that varies most, cut into slabs of whole leaves, each slab
    tiled by the next dimension."""
    dims = list(np.argsort(-x.var(axis=0), kind="stable")[:SPLIT_DIMS]) if x.shape[1] else []
    out: list[np.ndarray] = []

    def tile(rows: np.ndarray, left: list) -> None:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or not left:
            out.extend(rows[k : k + leaf] for k in range(0, len(rows), leaf))
            return
        slabs = pages if len(left) == 1 else max(2, round(pages ** (1 / len(left))))
        per = leaf * -(-pages // slabs)
        rows = rows[np.argsort(x[rows, left[0]], kind="stable")]
        for k in range(0, len(rows), per):
            tile(rows[k : k + per], left[1:])

    tile(np.arange(len(x)), dims)
    return out


def _pack(leaf: int):
    """Leaves of one slab, each with vectors of one length, in the narrowest integers that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, parts = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        vec = table.column("vec").combine_chunks()
        size = vec.value_lengths().to_numpy(zero_copy_only=False)
        values, starts = vec.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            x = values[starts[at][:, None] + np.arange(d)].reshape(len(at), d)
            for rows in str_tiles(x, leaf):
                top = np.abs(x[rows]).max(initial=0)
                width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
                data = x[rows].astype(f"<i{width}" if width < 8 else "<f8").tobytes()
                one = [[block], [int(d)], [ids[at[rows]].tolist()], [labels[at[rows]].tolist()], [width], [data]]
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, kinds, strict=True)], names=["block", "dims", "ids", "labels", "width", "vecs"])

    return run


def build(rows: DataFrame, keep: int, block: int = 8192, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """The table of leaves of ``rows`` (vec_id, label, vec), and the number of slabs. Of rows alike in vector and
    label the ``keep`` with the smallest ids stay: no search for fewer can return another."""
    alike = F.row_number().over(Window.partitionBy("label", "vec").orderBy("vec_id"))
    base = cut(rows.withColumn("_n", alike).where(F.col("_n") <= keep).drop("_n"))
    slabs = max(1, -(-base.count() // block))
    return cut(base.repartitionByRange(slabs, F.size("vec"), "vec").mapInArrow(_pack(leaf), _LEAVES)), slabs


class Tree:
    """The boxes over some leaves. Scores are whole numbers: doubles where all sums stay below 2^53, else Python's."""

    def __init__(self, ids: list[np.ndarray], labels: list[np.ndarray], vecs: list[np.ndarray], largest: float):
        self.starts = np.cumsum([0, *map(len, ids)])
        self.ids, self.labels, self.x = np.concatenate(ids), np.concatenate(labels), np.concatenate(vecs)
        self.wide = self.x.shape[1] * np.abs(self.x).max(initial=0) * largest >= 2**52
        if self.wide:
            self.x = whole(self.x)
        cuts = zip(self.starts, self.starts[1:], strict=False)
        lo, hi = map(np.stack, zip(*((self.x[a:b].min(axis=0), self.x[a:b].max(axis=0)) for a, b in cuts), strict=True))
        self.levels = [(lo, hi)]
        while len(lo) > FANOUT:
            groups = [slice(k, k + FANOUT) for k in range(0, len(lo), FANOUT)]
            lo, hi = np.stack([lo[g].min(axis=0) for g in groups]), np.stack([hi[g].max(axis=0) for g in groups])
            self.levels.append((lo, hi))

    def query(self, vector: np.ndarray) -> np.ndarray:
        return whole(vector) if self.wide else vector

    def walk(self, vector: np.ndarray, wanted: Callable, visit: Callable) -> None:
        """Best first: ``wanted(low, high)`` says of arrays of bounds which boxes may still hold a result, and
        ``visit(a, b)`` takes the rows of a leaf."""
        up, down = np.maximum(vector, 0), np.minimum(vector, 0)
        queue: list[tuple] = []

        def push(level: int, a: int, b: int) -> None:
            lo, hi = self.levels[level][0][a:b], self.levels[level][1][a:b]
            high, low = hi @ up + lo @ down, lo @ up + hi @ down
            for k in np.flatnonzero(wanted(low, high)):
                heapq.heappush(queue, (-high[k], level, a + int(k), low[k]))

        push(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while queue:
            high, level, k, low = heapq.heappop(queue)
            if not wanted(low, -high):
                continue
            if level:
                push(level - 1, k * FANOUT, min((k + 1) * FANOUT, len(self.levels[level - 1][0])))
            else:
                visit(self.starts[k], self.starts[k + 1])

    def nearest_alike(self, vec_id: int, label: int, vector: np.ndarray, count: int) -> list[tuple[int, int]]:
        """(score, id) of the ``count`` best rows of ``label``; one row that equals the query in all is left out."""
        vector, best, own = self.query(vector), [], True

        def wanted(low, high):
            return high >= -best[-1][0] if len(best) == count else high == high

        def visit(a: int, b: int) -> None:
            nonlocal best, own
            score = self.x[a:b] @ vector
            fits = self.labels[a:b] == label
            if len(best) == count:
                fits = fits & (score >= -best[-1][0])
            for k in np.flatnonzero(fits):
                if own and self.ids[a + k] == vec_id and (self.x[a + k] == vector).all():
                    own = False
                else:
                    best.append((-int(score[k]), int(self.ids[a + k])))
            best = sorted(best)[:count]

        self.walk(vector, wanted, visit)
        return [(-s, i) for s, i in best]

    def best_in_windows(self, label: int, vector: np.ndarray, windows: list[tuple[int, int]], count: int) -> list[list[tuple[int, int]]]:
        """For each window (lowest, highest) the (score, id) of the ``count`` best rows of other labels in it."""
        vector = self.query(vector)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        least, most = [a for a, _ in windows], [b for _, b in windows]

        def wanted(low, high):
            fits = (high >= least[0]) & (low <= most[0])
            for a, b in zip(least[1:], most[1:], strict=True):
                fits = fits | ((high >= a) & (low <= b))
            return fits

        def visit(a: int, b: int) -> None:
            score = self.x[a:b] @ vector
            at = np.flatnonzero((self.labels[a:b] != label) & (score >= min(least)) & (score <= max(most)))
            if not len(at):
                return
            found = score[at]
            for w in range(len(windows)):
                inside = (found >= least[w]) & (found <= most[w])
                if inside.sum() > count:
                    inside &= found >= np.sort(found[inside])[-count]
                if inside.any():
                    best[w] = sorted([*best[w], *((-int(s), int(i)) for s, i in zip(found[inside], self.ids[a + at[inside]], strict=True))])[:count]
                    if len(best[w]) == count:
                        least[w] = max(least[w], -best[w][-1][0])

        self.walk(vector, wanted, visit)
        return [[(-s, i) for s, i in b] for b in best]


def whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([int(v) for v in x.ravel()] + [None], dtype=object)[:-1].reshape(x.shape)


def _bounded(score: int) -> int:
    return max(LONG.min, min(LONG.max, score))


def _in_blocks(leaves: DataFrame, slabs: int, queries: DataFrame, n: int, chunk: int, schema: str, answer: Callable) -> DataFrame:
    """The rows that ``answer(tree, query)`` gives for every query (q, vec, ...) and every slab's tree of its length. A
    task has one slab and one chunk of queries; what is shuffled are queries x slabs and leaves x chunks."""
    chunks = max(1, -(-n // chunk))
    left = leaves.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = queries.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if index.num_rows and asked.num_rows:
            by_size: dict[int, list[dict]] = {}
            for q in asked.to_pylist():
                q["vec"] = np.array(q["vec"], dtype=np.float64)
                by_size.setdefault(len(q["vec"]), []).append(q)
            for d, group in by_size.items():
                rows = [r for r in index.to_pylist() if r["dims"] == d]
                if rows:
                    vecs = [np.frombuffer(r["vecs"], f"<i{r['width']}" if r["width"] < 8 else "<f8").astype(np.float64).reshape(len(r["ids"]), d) for r in rows]
                    largest = max(np.abs(q["vec"]).max(initial=0) for q in group)
                    tree = Tree([np.array(r["ids"], np.int64) for r in rows], [np.array(r["labels"], np.int64) for r in rows], vecs, largest)
                    for q in group:
                        out += answer(tree, q)
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, schema)


def mine(rows: DataFrame, every: int = 50, positives: int = 5, count: int = 3, low: int = 50, high: int = 95, block: int = 8192, chunk: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` of whole_vectors.

    Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives are its ``positives`` best other
    rows of the same label by inner product (ties to the smaller vec_id), and each gets the ``count`` best rows of other
    labels that score between ``low`` and ``high`` percent of it, ranked from 1. All rows are searched, exactly.

    Rows meet only rows of the same vector length. Repeated rows and ids are rows of their own: a copy of an anchor is
    one of its positives, and a repeated anchor gives its rows as often. A positive that scores below 0 has no window.
    Anchors without positives or negatives give no rows, nor does an empty table. Scores beyond a long are cut to it.
    """
    leaves, slabs = build(rows, max(positives + 1, count), block)
    anchors = cut(rows.where(F.col("vec_id") % every == 0).withColumn("q", F.monotonically_increasing_id()))
    n = anchors.count()
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    alike = _in_blocks(leaves, slabs, anchors, n, chunk, "q long, vec_id long, score long", lambda tree, q: [(q["q"], i, _bounded(s)) for s, i in tree.nearest_alike(q["vec_id"], q["label"], q["vec"], positives)])
    found = cut(alike.withColumn("_rank", rank).where(F.col("_rank") <= positives).drop("_rank"))
    scores = found.where("score >= 0").groupBy("q").agg(F.collect_set("score").alias("scores"))  # at most ``positives`` of them

    def negatives(tree: Tree, q: dict) -> list[tuple]:
        windows = [(-(-low * p // 100), high * p // 100) for p in q["scores"]]
        best = tree.best_in_windows(q["label"], q["vec"], windows, count)
        return [(q["q"], p, i, _bounded(s)) for p, rows in zip(q["scores"], best, strict=True) for s, i in rows]

    other = _in_blocks(leaves, slabs, anchors.join(scores, "q"), n, chunk, "q long, positive_score long, negative_id long, negative_score long", negatives)
    place = F.row_number().over(Window.partitionBy("q", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    chosen = other.withColumn("rank", place).where(F.col("rank") <= count)
    names = anchors.select("q", F.col("vec_id").alias("anchor_id"))
    pairs = found.select("q", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "q")
    return pairs.join(chosen, ["q", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
