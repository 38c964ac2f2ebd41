"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit fingerprint. Fingerprints are cut into segments; of two fingerprints within
``radius`` bits, at least one segment pair differs by at most the radius that the pigeonhole rule
leaves to that segment. Small Hamming balls around both segment values (one flipped bit on either
side reaches a distance of two) are the keys of the segment's table; rows that meet under a key are
compared on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.buckets import bucket_links
from tidebook.llm.common import cut, shuffle_partitions
from tidebook.llm.components import connected_components

SEED = 42
SECOND_SEED = 43


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's shingles, repeats included: runs of ``shingle`` words; fewer words make one shingle of all
    of them; a null text or one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[min(shingle, len(words)) - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 if there are none."""
    counts = np.zeros(64, dtype=np.int64)
    values = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 1 << 16):
        counts += np.unpackbits(values[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    """SimHash of one text: bit set where more than half of its shingle hashes have it; 0 without words."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, double: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fp2): the fingerprint of every row as a signed long; fp2 holds 64 more bits, from another
    seed, if ``double``, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((2, batch.num_rows), dtype=np.uint64)
            for k, t in enumerate(batch.column(1)):
                text = t.as_py()
                found[0, k] = fingerprint(text, shingle)
                if double:
                    found[1, k] = fingerprint(text, shingle, SECOND_SEED)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in found)], names=["doc_id", "fp", "fp2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, fp2 long")


def segment_plan(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: with radius = segments * q + a, the first a + 1 segments
    are searched to q bits and the others to q - 1; a segment left with a negative radius is not searched."""
    q, a = divmod(radius, segments)
    if q > 2:
        raise ValueError("a segment's radius is at most 2: use more segments")
    widths = [64 // segments + (k < 64 % segments) for k in range(segments)]
    shifts = [0, *accumulate(widths)]
    plan = [(shifts[k], widths[k], q if k <= a else q - 1) for k in range(segments)]
    return [p for p in plan if p[2] >= 0]


def _keys(plan: list[tuple[int, int, int]]) -> str:
    parts = []
    for k, (shift, width, near) in enumerate(plan):
        value = f"(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L)"
        tag = f"{k << 56}L"
        parts.append(f"array({value} + {tag})")
        if near:
            parts.append(f"transform(sequence(0, {width - 1}), b -> ({value} ^ shiftleft(1L, b)) + {tag})")
    return f"concat({', '.join(parts)})"


def hamming_links(prints: DataFrame, radius: int = 4, segments: int = 2, within: int | None = None, dense: int = 12, cap: int = 50_000) -> DataFrame:
    """Links (a, b) between the reps of rows (fp, fp2, rep) of distinct fingerprints. Two rows are linked if a
    segment of fp differs by at most its share of ``radius``, and all 128 bits by at most ``within``
    (``radius`` if not given); with ``within`` up to ``radius`` those are all pairs that close. Rows that share
    a rep count as linked already. ``dense`` and ``cap`` are those of bucket_links."""
    within = radius if within is None else within
    keyed = prints.select("fp", "fp2", "rep", F.explode(F.expr(_keys(segment_plan(radius, segments)))).alias("key"))
    return bucket_links(keyed, within, dense, cap).select("a", "b")


def merge(labels: DataFrame, radius: int, segments: int, within: int | None = None) -> DataFrame:
    """(fp, fp2, rep) with rep replaced by the smallest rep of its component under hamming_links."""
    stars = connected_components(hamming_links(labels.where("rep is not null"), radius, segments, within))
    return labels.join(stars, labels["rep"] == stars["node"], "left").select("fp", "fp2", F.coalesce("component", "rep").alias("rep"))


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, segments: int = 2, within: int | None = None, double: bool = False, closer: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of ``docs``.

    Two rows are linked if their fingerprints differ in at most ``radius`` bits; with ``double`` and
    ``within``, as hamming_links says for fingerprints of 128 bits. component_id is the smallest id
    reachable over links, the row's own included. Null and empty texts have fingerprint 0 and are linked
    like any other. Rows with a null id are kept: they join their component but cannot name it, and alone
    have a null component_id. Repeated rows stay repeated; an empty table gives none; other columns of
    ``docs`` are ignored. ``closer`` (radius, segments) merges what a smaller radius finds first: the
    result is the same, but a large group of near copies, mostly one component by then, gives few links in
    the second pass.
    """
    prints = cut(fingerprints(docs, shingle, double, id_col, text_col))
    within = radius if within is None else within
    labels = prints.groupBy("fp", "fp2").agg(F.min("doc_id").alias("rep"))
    if closer:
        labels = cut(merge(labels, *closer, min(within, closer[0] * (2 if double else 1))))
    named = merge(labels, radius, segments, within).withColumnRenamed("rep", "component_id")
    return prints.join(named, ["fp", "fp2"]).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


BANDS, ROWS, BINS = 25, 4, 512
_PERMUTE = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of ROWS minima each. Sets of similarity s share one with probability 1 - (1 - s**ROWS) ** BANDS:
    all but two in a million at 0.8."""
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _PERMUTE[0]
        low = np.minimum(low, ((x ^ x >> np.uint64(32)) * _PERMUTE[1]).min(axis=0))
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """One byte of the smallest hash in each of BINS ranges of hashes, 0 where there is none; ``hashes`` are sorted.
    Of two sketches, the share of equal bytes among those that either has estimates the sets' similarity."""
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique(hashes >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out[bins.astype(np.int64)] = (hashes[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """(row: struct of the columns of ``docs``, doc_id, node, fp, keys, sketch): node names the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys, sketches = [], [], [], []
            for t in batch.column("text"):
                hashes = shingle_hashes(t.as_py(), shingle)
                own = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                prints.append(majority(hashes))
                keys.append(band_keys(own).tolist())
                sketches.append(sketch(own))
            words = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            columns = [batch.column(0), batch.column(1), *words, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "node", "fp", "keys", "sketch"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, doc_id long, node long, fp long, keys array<long>, sketch binary")


def _alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarities that the sketch ``one`` and each of ``many`` tell."""
    same = ((many == one) & (one != 0)).sum(axis=1)
    return same / np.maximum(1, ((many != 0) | (one != 0)).sum(axis=1))


def _likely(node: np.ndarray, made: np.ndarray, low: float) -> Iterator[tuple[int, int]]:
    """The pairs of a spanning forest of largest estimates, all at least ``low``."""
    left, near, best = np.arange(1, len(node)), np.zeros(len(node) - 1, np.int64), _alike(made[0], made[1:])
    while len(left):
        k = int(best.argmax())
        at = left[k]
        if best[k] >= low:
            yield int(node[near[k]]), int(node[at])
        left, near, best = (np.delete(x, k) for x in (left, near, best))
        now = _alike(made[at], made[left])
        near, best = np.where(now > best, at, near), np.maximum(now, best)


def _linked(node: np.ndarray, part: np.ndarray, made: np.ndarray, sets: list[bytes], low: float, least: float) -> Iterator[tuple[int, int]]:
    """Links that join the parts: every pair of different parts whose estimate is at least ``low`` is counted exactly."""
    part = part.copy()
    for i in range(len(node) - 1):
        later = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
        guess = _alike(made[i], made[later])
        for j in later[guess >= low]:
            if part[j] != part[i]:
                one, two = (np.frombuffer(sets[k], np.uint64) for k in (i, j))
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both >= least * (len(one) + len(two) - both):
                    yield int(node[i]), int(node[j])
                    part[part == part[j]] = part[i]


def _pairs_of_bands(least: float, low: float, at_once: int = 1 << 26):
    """A task body over rows (key, node, part, sketch, own) sorted by key: pairs (a, b) of nodes of one key. With
    null ``own``, those of _likely; else those of _linked, ``own`` being the sorted hashes of the set."""

    def pairs(rows: list[list]) -> pa.RecordBatch:
        key, node, part = (np.concatenate([h[i] for h in rows]) for i in range(3))
        made = np.concatenate([h[3] for h in rows])
        sets = [x for h in rows for x in h[4]]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out: set[tuple[int, int]] = set()
        for s, e in zip(starts, np.r_[starts[1:], len(key)], strict=True):
            if e - s > 1:
                found = _likely(node[s:e], made[s:e], low) if sets[s] is None else _linked(node[s:e], part[s:e], made[s:e], sets[s:e], low, least)
                out.update((min(x), max(x)) for x in found)
        columns = list(zip(*sorted(out), strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            made = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
            rows = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), made, batch.column(4).to_pylist()]
            size += batch.nbytes
            if size >= at_once:  # the rows of complete keys go
                last = np.searchsorted(rows[0], rows[0][-1])
                if last or (held and held[-1][0][-1] != rows[0][-1]):
                    yield pairs([*held, [x[:last] for x in rows]])
                    held, size, rows = [], 0, [x[last:] for x in rows]
            held.append(rows)
        if held:
            yield pairs(held)

    return run


def band_pairs(bands: DataFrame, nodes: DataFrame, least: float, exact: bool, cap: int) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that share a key of ``bands`` (key, node, part); ``nodes`` has (node, sketch, own).
    Bands of one part are left out. Without ``exact``, the likeliest pairs that join each band, for all whose
    similarity may be ``least``; with it, links of ``least`` or more that join each band's parts wherever such links
    do. Sketches are taken to say too little by up to 4.5 standard deviations. Bands over ``cap`` nodes are dealt over
    pairs of blocks."""
    counts = bands.groupBy("key").agg(F.ceil(F.count("*") / cap).cast("int").alias("blocks"), F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    rows = bands.join(counts.where("n > 1 and low < high").select("key", "blocks"), "key").join(nodes, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    task = _pairs_of_bands(least, least - 4.5 * (least * (1 - least) / BINS) ** 0.5)
    parts = shuffle_partitions(bands.sparkSession)
    hashes = F.col("own") if exact else F.lit(None).cast("binary")
    return dealt.select(key.alias("key"), "node", "part", "sketch", hashes.alias("own")).repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(task, "a long, b long").distinct()


def _hash_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, own: the sorted hashes of its shingles, eight bytes each) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "own"])

    return texts.select("node", "text").mapInArrow(run, "node long, own binary")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets of shingles have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            good = []
            for a, b, one, two in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for node, text in ((a, one), (b, two)):
                    if node not in sets:
                        sets[node] = np.unique(shingle_hashes(text, shingle))
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                good.append(both >= least * (len(sets[a]) + len(sets[b]) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def keep_similar_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group that links of a Jaccard similarity of ``least`` or more
    between sets of shingles hold together: the one with the smallest doc_id.

    Each link between different sets is counted exactly. First come the texts whose SimHash fingerprints differ in
    at most 4 of 64 bits, and the likeliest pairs that join each band of minima (a pair at 0.8 is that near by
    SimHash in one case of 38, but shares a band in all but two of a million); then all pairs of a band that are
    still in different components and whose sketches allow it, in the task that has the band, which gives only the
    links that join components. Rows that repeat a kept doc_id and its set come out once; rows with a null doc_id
    stay, and link others. Null texts and texts without words are alike; an empty table gives no rows.
    """
    marked = cut(_marked(docs, shingle))
    texts = marked.groupBy("node").agg(F.min(F.col("row.text").cast("string")).alias("text"))
    nodes = cut(marked.groupBy("node").agg(F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    near = hamming_links(nodes.select("fp", F.lit(0).cast("long").alias("fp2"), F.col("node").alias("rep")))
    bands = nodes.select(F.explode("keys").alias("key"), "node", F.col("node").alias("part"))
    likely = band_pairs(bands, nodes.select("node", "sketch", F.lit(None).cast("binary").alias("own")), least, False, 2048)
    links = cut(_verified(likely.unionByName(near).distinct(), texts, shingle, least))
    parts = cut(connected_components(links).withColumnRenamed("node", "_n"))
    found = bands.drop("part").join(parts, F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    open_ = found.join(found.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key"), "key", "left_semi")
    open_ = cut(open_)
    sets = _hash_sets(texts.join(open_.select("node").distinct(), "node", "left_semi"), shingle)
    rest = cut(band_pairs(open_, nodes.select("node", "sketch").join(sets, "node"), least, True, 512))
    parts = connected_components(links.unionByName(rest)).withColumnRenamed("node", "_n")
    named = marked.where("doc_id is not null").select("doc_id", "node").distinct()
    named = named.join(parts, F.col("node") == F.col("_n"), "left").select("doc_id", "node", F.coalesce("component", "node").alias("part"))
    kept = named.groupBy("part").agg(F.min(F.struct("doc_id", "node")).alias("k")).select("k.doc_id", "k.node")
    chosen = marked.join(kept, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"])
    return chosen.select("row.*").unionByName(marked.where("doc_id is null").select("row.*"))


def keep_one(docs: DataFrame, shingle: int = 4, **options) -> DataFrame:
    """``docs`` without near-duplicates (options as in near_duplicates but ``double``): of each component one row stays, the one
    with the smallest doc_id and, where that id has several texts, the smallest fingerprint and text.

    Unlike texts that share a doc_id are judged each by its own fingerprint. Rows that repeat a kept one come out
    once; rows with a null doc_id stay.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = near_duplicates(rows, shingle, **options)
    named = rows.where("doc_id is not null").withColumn("mark", F.xxhash64("text"))
    marks = fingerprints(rows.withColumn("mark", F.xxhash64("text")).where("doc_id is not null"), shingle, id_col="mark").select(F.col("doc_id").alias("mark"), "fp").distinct()
    groups = found.select("fp", "component_id").distinct()
    best = named.join(marks, "mark").join(groups, "fp").groupBy("component_id").agg(F.min(F.struct("doc_id", "fp", "mark")).alias("k")).select("k.doc_id", "k.mark")
    chosen = named.join(best, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    return chosen.select("row.*").unionByName(docs.where("doc_id is null"))
