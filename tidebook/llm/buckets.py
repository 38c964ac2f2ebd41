"""Links between the rows of hash buckets: near pairs of small buckets, spanning forests of dense ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut, shuffle_partitions

AT_ONCE = 200_000  # rows of buckets that a task compares together
_KINDS = "kind long, a long, b long, key long, fp2 long"
_NAMES = ["kind", "a", "b", "key", "fp2"]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, of which each is a column of words."""
    return np.bitwise_count(a ^ b).sum(axis=0, dtype=np.int64)


def _forest(fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one dense bucket, from its first row on: at most one fewer than it has rows."""
    left, ends, heads = np.arange(len(rep)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = distance(fp[:, left], fp[:, [at]]) <= radius
            found = left[near]
            left = left[~near]
            queue.extend(found)
            ends.append(found)
            heads.append(np.full(len(found), at))
    if not ends:
        return rep[:0], rep[:0]
    return rep[np.concatenate(heads)], rep[np.concatenate(ends)]


def _rows_again(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    words = fp.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.ones(len(rep), np.int64), words[0], rep, key, words[1])], names=_NAMES)


def _task(radius: int, dense: int, cap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task body over rows (key, fp, fp2, rep) sorted by key and rep. The rows of keys with more than ``cap``
    rows come out again (kind 1), as they come in: a task never holds more than AT_ONCE rows and a batch."""

    def links_of(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        group_size = np.repeat(sizes, sizes)
        small = (group_size > 1) & (group_size <= dense)
        k, f, r = key[small], fp[:, small], rep[small]
        out, over = [(rep[:0], rep[:0])], []
        at, lag = np.arange(len(k)), 1
        while len(at):
            at = at[at + lag < len(k)]
            at = at[k[at] == k[at + lag]]
            hit = at[distance(f[:, at], f[:, at + lag]) <= radius]
            out.append((r[hit], r[hit + lag]))
            lag += 1
        for s, n in zip(starts[sizes > dense], sizes[sizes > dense], strict=True):
            if n > cap:
                over.append(slice(s, s + n))
            elif n > 1:
                out.append(_forest(fp[:, s : s + n], rep[s : s + n], radius))
        a, b = (np.concatenate([x[i] for x in out]) for i in range(2))
        pairs = np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b]
        times = np.zeros(0, np.int64)
        if pairs.size:
            pairs, times = np.unique(pairs, axis=1, return_counts=True)
        zero = np.zeros(pairs.shape[1], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zero, pairs[0], pairs[1], times, zero)], names=_NAMES)
        for s in over:
            yield _rows_again(key[s], fp[:, s], rep[s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, hot = 0, None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if hot is not None:
                more = np.searchsorted(columns[0], hot, "right")
                yield _rows_again(columns[0][:more], np.stack([columns[1][:more], columns[2][:more]]), columns[3][:more])
                columns = [c[more:] for c in columns]
            if not len(columns[0]):
                continue
            hot = None
            held.append(columns)
            n += len(columns[0])
            if n < AT_ONCE:
                continue
            key, one, two, rep = (np.concatenate([h[i] for h in held]) for i in range(4))
            last = np.searchsorted(key, key[-1])
            fp = np.stack([one, two]).view(np.uint64)
            if last:
                yield from links_of(key[:last], np.ascontiguousarray(fp[:, :last]), rep[:last])
            held, n = [[x[last:] for x in (key, one, two, rep)]], n - last
            if n > cap:
                yield _rows_again(key[last:], np.ascontiguousarray(fp[:, last:]), rep[last:])
                held, n, hot = [], 0, key[-1]
        if held:
            key, one, two, rep = (np.concatenate([h[i] for h in held]) for i in range(4))
            yield from links_of(key, np.stack([one, two]).view(np.uint64), rep)

    return run


def bucket_links(keyed: DataFrame, within: int, dense: int, cap: int) -> DataFrame:
    """Links (a, b, n), a < b, between the reps of rows (key, fp, fp2, rep) that share a key and differ in at most
    ``within`` of 128 bits; n counts the buckets of a part of the work that gave the link, and the same link may come
    from several parts. Buckets of up to ``dense`` rows give every pair; larger ones a spanning forest from the
    smallest rep on, so that a group of near copies gives links in proportion to its rows. Buckets over ``cap`` rows
    are dealt as pairs of blocks, each pair compared in full by one task. No rows give no links."""
    parts = shuffle_partitions(keyed.sparkSession)
    rows = keyed.select("key", "fp", "fp2", "rep")
    found = cut(rows.repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(_task(within, dense, cap), _KINDS))
    links = found.where("kind = 0").select("a", "b", F.col("key").alias("n"))
    over = found.where("kind = 1").select("key", F.col("a").alias("fp"), "fp2", F.col("b").alias("rep"))
    if not over.isEmpty():
        blocks = over.groupBy("key").agg(F.ceil(F.count("*") / cap).cast("int").alias("n"))
        pairs = (
            over.join(blocks, "key")
            .withColumn("own", F.pmod(F.xxhash64("fp", "fp2", "rep"), F.col("n")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "fp2", "rep")
        )
        dealt = pairs.repartition(parts, "key").sortWithinPartitions("key", "rep")
        links = links.unionByName(dealt.mapInArrow(_task(within, dense, 1 << 62), _KINDS).select("a", "b", F.col("key").alias("n")))
    return links
