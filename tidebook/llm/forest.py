"""Nearest neighbours with a hash-prefix forest.

The vectors are dealt into blocks, and each block holds a forest: per tree, the sorted array of the
vectors' long hash strings (signs of random projections about the mean). A query descends each tree
to its longest matching prefix, then all trees ascend together, one bit at a time, until the prefixes
that they share with it hold enough candidates; these are ranked by exact distance, and the blocks'
nearest are merged. Queries reach the blocks in chunks, so no task holds all of either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import cut

BITS = 24
NEAREST = 10


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part: an id, and a vector that is not null, empty or zero and
    has only finite components. Repeated rows stay."""
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    return rows.where("vec_id is not null and vec is not null").where(F.coalesce(fine, F.lit(False)))


class Forest:
    """The trees of one block, over its distinct vectors; members lists each one's smallest ids, repeated ones too.
    Hash strings are taken about the block's mean."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, planes: np.ndarray, keep: int):
        order = np.argsort(ids, kind="stable")
        self.vectors, inverse = np.unique(vectors[order], axis=0, return_inverse=True)
        by = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[by], np.arange(len(self.vectors) + 1))
        self.members = [ids[order][by[a : min(b, a + keep)]] for a, b in zip(starts, starts[1:], strict=False)]
        self.squares = (self.vectors**2).sum(axis=1)
        self.planes, self.mean, self.trees = planes, self.vectors.mean(axis=0), planes.shape[1] // BITS
        keys = self.hashes(self.vectors)
        self.rows = np.argsort(keys, axis=0, kind="stable").T.ravel()
        self.keys = np.sort(keys, axis=0).T.ravel()

    def hashes(self, vectors: np.ndarray) -> np.ndarray:
        """One sortable key per vector and tree: the tree's number, then its hash string."""
        bits = ((vectors - self.mean) @ self.planes > 0).reshape(len(vectors), self.trees, BITS)
        return (bits @ (1 << np.arange(BITS - 1, -1, -1))) + (np.arange(self.trees) << BITS)

    def candidates(self, key: np.ndarray, least: int) -> np.ndarray:
        """Distinct vectors below the deepest common prefix length that gives at least ``least``."""
        at = np.searchsorted(self.keys, key)
        near = np.minimum(self.keys[np.maximum(at - 1, 0)] ^ key, self.keys[np.minimum(at, len(self.keys) - 1)] ^ key)
        cut_bits = min(BITS, int(near.min()).bit_length())
        while True:
            low = (key >> cut_bits) << cut_bits
            a, b = np.searchsorted(self.keys, low), np.searchsorted(self.keys, low + (1 << cut_bits))
            size = b - a
            if size.sum() >= least or cut_bits == BITS:
                hit = np.zeros(len(self.vectors), bool)
                hit[self.rows[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
                found = np.flatnonzero(hit)
                if len(found) >= least or cut_bits == BITS:
                    return found
            cut_bits += 1

    def nearest(self, vector: np.ndarray, key: np.ndarray, least: int, count: int, own: int) -> list[tuple[float, int]]:
        """(distance, id) of the nearest candidates, the query's own row left out: one of its id at its vector."""
        found = self.candidates(key, least)
        if len(found) > count + 1:
            rough = self.squares[found] - 2 * (self.vectors[found] @ vector)
            found = found[rough <= np.partition(rough, count)[count] + 1e-9 * self.squares.max()]
        distance = np.sqrt(((self.vectors[found] - vector) ** 2).sum(axis=1))
        rows = sorted((float(d), int(i)) for d, k in zip(distance, found, strict=True) for i in self.members[k])
        same = np.flatnonzero((self.vectors[found] == vector).all(axis=1))
        if len(same) and own in self.members[found[same[0]]]:
            rows.remove((float(distance[same[0]]), own))
        return rows[:count]


def search(table: DataFrame, every: int = 100, count: int = NEAREST, trees: int = 64, share: float = 0.45, least: int = 512, block: int = 8192, chunk: int = 8192, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, its ``count``
    nearest found among all other rows by Euclidean distance, ties to the smaller vec_id.

    A query takes at least ``least`` candidates of each block, and at least ``share`` of its distinct
    vectors. Rows that take no part are those valid_vectors leaves out. Only vectors of one length have a
    distance, so each length is searched apart, and a query without another row of its length gives no
    rows. Every row is found, also where rows repeat an id or a vector; rows that repeat both are asked once.
    An empty table gives no rows; extra columns are ignored.
    """
    spark = table.sparkSession
    base = cut(valid_vectors(table).withColumn("d", F.size("vec")))
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = base.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"])
    n_blocks, n_chunks = -(-n // block), max(1, -(-queries.count() // chunk))
    schema = "query_id long, asked long, vec_id long, score double"
    deal = lambda k, salt: F.pmod(F.xxhash64("vec_id", "vec", F.lit(salt)), F.lit(k)).cast("int")
    left = base.select("d", deal(n_blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), "vec_id", "vec")
    asked_of = F.xxhash64("vec").alias("asked")  # tells apart queries of one id
    right = queries.select("d", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), deal(n_chunks, 2).alias("chunk"), "vec_id", "vec", asked_of)

    def run(key, index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, float]] = []
        if index.num_rows and asked.num_rows:
            d = key[0].as_py()
            stack = lambda t: t.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, d)
            planes = np.random.default_rng(seed).normal(size=(d, trees * BITS))
            forest = Forest(index.column("vec_id").to_numpy(), stack(index), planes, count + 1)
            enough = max(least, int(share * len(forest.vectors)))
            vectors = stack(asked)
            for own, mark, vector, own_key in zip(asked.column("vec_id").to_pylist(), asked.column("asked").to_pylist(), vectors, forest.hashes(vectors), strict=True):
                out += [(own, mark, i, x) for x, i in forest.nearest(vector, own_key, enough, count, own)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "asked", "vec_id", "score"])

    keys = ["d", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
