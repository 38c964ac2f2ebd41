"""Phrase mining by dynamic itemset counting.

The documents are dealt into shards, and step t scans shard t modulo their number. Words are counted from the first
step on. A longer phrase is counted from the step after both of its parts, all words but the last and all but the first,
have reached the threshold, and for exactly one cycle of the shards; so phrases of all lengths are counted in the same scans.

What tells the tasks which phrases are open is a table of one byte for each of 2^bits hash slots: the first step after
which a phrase of that slot was frequent. A phrase's start is the later byte of its two parts. As a byte never changes once it is
set, each phrase is counted for one whole cycle, and its count is exact whatever shares its slot; a crowded table only
lets more phrases be counted. Before, one pass counts pairs of words by hash slot, and pairs of a
slot with fewer than the threshold in all are never opened: most pairs of frequent words are that rare.

Texts are split into words once. What the scans read are slices of the shards: the words of some megabytes of text as
numbers, with each different word's text and hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import cut, fresh_folder

LONGEST = 4
_PART = 1 << 16
NEVER = 255
_COUNTS = "lang string, phrase string, size int, since int, n long, before long"
_NAMES = ["lang", "phrase", "size", "since", "n", "before"]
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _stir(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _STEP)) * _MIX
        return h ^ (h >> np.uint64(32))


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    with np.errstate(over="ignore"):
        return _stir(h * _MIX + word)


def word_hashes(langs: list[str], words: list[str]) -> np.ndarray:
    """Of each word in its language."""
    return _in_language(langs, np.arange(len(langs)), _hashes(words))


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _in_language(langs: list[str], lang_of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    seeds = {x: xxhash.xxh64_intdigest(x, 1) for x in set(langs)}
    return _joined(np.fromiter((seeds[x] for x in langs), np.uint64, len(langs))[lang_of], hashes)


class Slice(NamedTuple):
    """Some texts as numbers. ``codes`` has the words of all texts in order, with -1 where a piece ends; word k is the text
    words[k] in the language langs[lang_of[k]], with the hash hashes[k]. A text is another word in each language."""

    langs: pa.Array
    lang_of: np.ndarray
    words: pa.Array
    hashes: np.ndarray
    codes: np.ndarray

    def row(self) -> list:
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(self.words)], self.words), " ")[0].as_py()
        return [self.langs.to_pylist(), self.lang_of.tobytes(), words, self.hashes.tobytes(), self.codes.tobytes()]


_SLICE = pa.schema([("langs", pa.list_(pa.string())), ("lang_of", pa.binary()), ("words", pa.string()), ("hashes", pa.binary()), ("codes", pa.binary())])
_SHARDED = "langs array<string>, lang_of binary, words string, hashes binary, codes binary, shard int"


def encode(texts: pa.Array, langs: pa.Array) -> Slice | None:
    """The words of texts in lower case, or None without any. Words are what stands between spaces and tabs; pieces end at
    . , ; : ! ? and line ends, and with their text."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), r"[.,;:!?\x0A-\x0D]+", " \n ")
    split = pc.split_pattern(pc.replace_substring(marked, "\t", " "), " ")
    coded = split.flatten().dictionary_encode()
    row = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int32)
    code = coded.indices.to_numpy(zero_copy_only=False)
    place = {w: k for w in ("", "\n") if (k := pc.index(coded.dictionary, pa.scalar(w)).as_py()) >= 0}
    ends = code == place.get("\n", -1)
    piece = np.cumsum(ends, dtype=np.int32) + row
    keep = ~ends & (code != place.get("", -1))
    code, piece, row = code[keep], piece[keep], row[keep]
    if not len(code):
        return None
    tongues = langs.dictionary_encode()
    lang = tongues.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    keys, word = np.unique(lang * len(coded.dictionary) + code, return_inverse=True)
    lang_of, text_of = np.divmod(keys, len(coded.dictionary))
    words = coded.dictionary.take(pa.array(text_of))
    hashes = _in_language(tongues.dictionary.to_pylist(), lang_of, _hashes(coded.dictionary.to_pylist())[text_of])
    codes = np.insert(word.astype(np.int32), np.flatnonzero(piece[1:] != piece[:-1]) + 1, np.int32(-1))
    return Slice(tongues.dictionary, lang_of.astype(np.int32), words, hashes, codes)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for b in batches:
        for k in range(b.num_rows):
            langs, words = b.column("langs")[k].values, pc.split_pattern(b.column("words").slice(k, 1), " ").flatten()
            numbers = (np.frombuffer(b.column(name)[k].as_buffer(), kind) for name, kind in (("lang_of", np.int32), ("hashes", np.uint64), ("codes", np.int32)))
            lang_of, hashes, codes = numbers
            yield Slice(langs, lang_of, words, hashes, codes)


def _encoded(slice_bytes: int):
    """Slices of about ``slice_bytes`` of text, each of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def made(shard: int) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held.pop(shard))
            found = encode(pa.concat_arrays(rows.column("text").chunks), pa.concat_arrays(rows.column("lang").chunks))
            if found:
                values = [pa.array([v], f.type) for v, f in zip(found.row(), _SLICE, strict=True)]
                yield pa.RecordBatch.from_arrays([*values, pa.array([shard], pa.int32())], names=[*_SLICE.names, "shard"])

        for b in batches:
            for shard in pc.unique(b.column("shard")).to_pylist():
                held.setdefault(shard, []).append(b.filter(pc.equal(b.column("shard"), shard)))
                if sum(x.nbytes for x in held[shard]) >= slice_bytes:
                    yield from made(shard)
        for shard in list(held):
            yield from made(shard)

    return run


def encoded(rows: DataFrame, slice_bytes: int) -> DataFrame:
    """(lang, text, shard) as rows of slices; any number of documents make a row, but a long one is never parted."""
    return rows.select("lang", "text", "shard").mapInArrow(_encoded(slice_bytes), _SHARDED)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct key, every key's number among them, counts)."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, counts


def _holds(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_slice(s: Slice, first: np.ndarray, pairs: np.ndarray, step: int, shards: int) -> Iterator[pa.RecordBatch]:
    """One row (lang, phrase, size, since, n, 0) for each distinct phrase of the slice that is open at ``step``. Pairs whose
    slot has no bit in ``pairs`` are too rare to open."""
    codes, total, mask = s.codes, len(s.words), np.uint64(len(first) - 1)

    def batch(word: np.ndarray, phrase: pa.Array, size: int, since: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        k = len(word)
        columns = [s.langs.take(pa.array(s.lang_of[word])), phrase, pa.array(np.full(k, size), pa.int32()), pa.array(since, pa.int32()), pa.array(n, pa.int64()), pa.array(np.zeros(k), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    if step < shards:
        yield batch(np.arange(total), s.words, 1, np.zeros(total), np.bincount(codes[codes >= 0], minlength=total))
    if step == 0:
        return
    start = np.append(first[s.hashes & mask], np.uint8(NEVER)).astype(np.int16)[codes]  # the last one stands for -1
    known = start < step
    at = np.flatnonzero(known[:-1] & known[1:])
    h = _joined(s.hashes[codes[at]], s.hashes[codes[at + 1]])
    held = _holds(pairs, h & np.uint64(8 * len(pairs) - 1))
    at, h = at[held], h[held]
    since = np.maximum(start[at], start[at + 1]) + 1
    for size in range(2, LONGEST + 1):
        now = since + shards > step
        where = at[now]
        if len(where):
            keys = codes[where].astype(np.int64)
            for k in range(1, size):
                if k > 1:
                    keys = _distinct(keys)[1]
                keys = keys * total + codes[where + k]
            one, _, counts = _distinct(keys)
            phrase = pc.binary_join_element_wise(*(s.words.take(pa.array(codes[where[one] + k])) for k in range(size)), " ")
            yield batch(codes[where[one]], phrase, size, since[now][one], counts)
        if size < LONGEST:  # a longer phrase needs both of its parts, which start at neighbouring places
            start = first[h & mask].astype(np.int16)
            known = start < step
            at, h, since = at[known], h[known], np.maximum(since, start + 1)[known]
            both = np.flatnonzero(at[1:] == at[:-1] + 1)
            at, since = at[both], np.maximum(since[both], since[both + 1])  # a part may share an earlier slot than its words
            h = _joined(h[both], s.hashes[codes[at + size]])


def count_open(texts: pa.Array, langs: pa.Array, first: np.ndarray, pairs: np.ndarray, step: int, shards: int) -> Iterator[pa.RecordBatch]:
    """``count_slice`` of texts."""
    found = encode(texts, langs)
    return count_slice(found, first, pairs, step, shards) if found else iter(())


def _scan(tables, step: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pairs = tables.value
        for s in _slices(batches):
            yield from count_slice(s, first, pairs, step, shards)

    return run


def _pair_counts(bits: int, least: int):
    """(part, counts): how many pairs of words fall on each hash slot, up to ``least``, in parts of _PART slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for s in _slices(batches):
            at = np.flatnonzero((s.codes[:-1] >= 0) & (s.codes[1:] >= 0))
            slot = _joined(s.hashes[s.codes[at]], s.hashes[s.codes[at + 1]]) & np.uint64(len(table) - 1)
            np.add.at(table, slot.astype(np.int64), np.uint32(1))
        np.minimum(table, least, out=table)
        table = table.astype(np.uint8 if least < 256 else np.uint32)
        for k in range(0, len(table), _PART):
            if table[k : k + _PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _PART]), pa.array([table[k : k + _PART].tobytes()])], names=["part", "counts"])

    return run


def _pair_bits(bits: int, least: int):
    """(part, counts): the parts of all tasks added up, as one bit for each slot that reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = np.frombuffer(counts, np.uint8 if least < 256 else np.uint32)
                sums[part] = np.minimum(sums.get(part, 0) + new.astype(np.int64), least).astype(np.uint32)
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], names=["part", "counts"])

    return run


def possible_pairs(rows: DataFrame, least: int, bits: int, slice_bytes: int) -> np.ndarray:
    """``pairs_of_slices`` of (lang, text)."""
    return pairs_of_slices(encoded(rows.withColumn("shard", F.lit(0)), slice_bytes), least, bits)


def pairs_of_slices(slices: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bit for each of 2^bits hash slots: whether all pairs of words of the slot together occur ``least`` times. A pair
    that does has its bit; the driver gets 2^bits bits, and each task sends 2^bits small counts at most."""
    n = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = slices.select("hashes", "codes", "langs", "lang_of", "words").mapInArrow(_pair_counts(bits, least), "part long, counts binary")
    parts = counted.repartition(n, "part").mapInArrow(_pair_bits(bits, least), "part long, counts binary")
    found = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():  # one job; row by row it would be one for each partition
        new = np.frombuffer(r["counts"], np.uint8)
        at = r["part"] * _PART // 8
        found[at : at + len(new)] = new
    return found


def _slots(mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            phrases = [p.split(" ") for p in b.column(1).to_pylist()]
            langs = b.column(0).to_pylist()
            flat = word_hashes([x for x, p in zip(langs, phrases, strict=True) for _ in p], [w for p in phrases for w in p])
            sizes = np.array([len(p) for p in phrases], np.int64)
            starts = np.cumsum(sizes) - sizes
            h = flat[starts] if len(phrases) else flat
            for k in range(1, LONGEST):
                more = sizes > k
                h[more] = _joined(h[more], flat[starts[more] + k])
            yield pa.RecordBatch.from_arrays([pa.array((h & np.uint64(mask)).astype(np.int64))], names=["slot"])

    return run


def frequent_phrases(docs: DataFrame, least: int = 30, shards: int = 3, bits: int = 24, slice_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f), (lang, n)): the phrases of 1 to 4 words that occur at least ``least`` times in a
    language, and the number of words of each language, over documents (text, lang).

    The driver holds the table of 2^bits bytes and sends it to the tasks once a step; at most four cycles of the
    shards end the counting.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "phrases")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sharded = encoded(rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))), slice_bytes)
    sharded.write.partitionBy("shard").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(folder)
    source = spark.read.schema(_SHARDED).parquet(folder)
    first = np.full(1 << bits, NEVER, np.uint8)
    pairs = pairs_of_slices(source, least, max(3, bits - 1))
    running, done, totals, step, last = None, [], None, 0, 0
    while step <= last + shards or step < shards:
        table = spark.sparkContext.broadcast((first, pairs))  # 2^bits bytes, and a sixteenth of that
        counted = source.where(F.col("shard") == step % shards).drop("shard").mapInArrow(_scan(table, step, shards), _COUNTS)
        if running is not None:
            still = running.where(F.col("since") > step - shards)
            counted = counted.unionByName(still.select("lang", "phrase", "size", "since", "n", F.col("n").alias("before")))
        sums = counted.groupBy("lang", "phrase").agg(F.max("size").alias("size"), F.max("since").alias("since"), F.sum("n").alias("n"), F.sum("before").alias("before"))
        running = cut(sums)
        done.append(running.where((F.col("since") == step - shards + 1) & (F.col("n") >= least)).select("lang", "phrase", "size", F.col("n").alias("f")))
        if step == shards - 1:
            totals = running.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
        fresh = running.where((F.col("n") >= least) & (F.col("before") < least) & (F.col("size") < LONGEST))
        slots = fresh.select("lang", "phrase").mapInArrow(_slots(len(first) - 1), "slot long")
        one = F.col("slot") + 1  # the functions count buckets and values from 1
        maps = slots.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
        for r in maps.collect():  # at most 2^bits bits in all, in one job
            found = (r["bucket"] - 1) * 32768 + np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
            found = found[first[found] == NEVER]
            if len(found):
                first[found], last = step, step
        table.destroy()  # the driver's copy goes too
        step += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every, totals


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, name: str, salts: int = 8) -> DataFrame:
    """``rows`` with ``name``, the f of (lang, key); the rows of a frequent part are dealt over ``salts`` tasks. Spark sizes
    the repeated rows by the file before the explode, so it is told not to broadcast them."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    parts = table.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(parts.hint("merge"), ["lang", key, "_salt"]).drop("_salt")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, shards: int = 3, bits: int = 24, slice_bytes: int = 4 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``top`` phrases of 2 to 4 words.

    a is how often the phrase occurs (at least ``least``), l and r how often the parts of its weakest cut do: the cut whose
    score floor(2000000 a / (l + r)) is least, the earliest on ties. A phrase is dropped if it stands inside a longer
    frequent one that occurs at least ``inside`` percent as often. Ranks go by score, then a, both descending, then
    by the phrase's bytes. A null language is und, a null text is empty; repeated rows count again, and documents
    without words, or an empty table, give no rows. Other columns are ignored. All counts are over all documents.
    """
    counted, totals = frequent_phrases(docs, least, shards, bits, slice_bytes)
    counted = cut(counted)
    words = F.split("phrase", " ")
    longer = counted.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", _part(words, F.lit(1), F.col("k")).alias("left"), _part(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = _looked_up(_looked_up(cuts, counted, "left", "l"), counted, "right", "r")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("both", wide("l") + wide("r")).withColumn("product", wide("a") * F.lit(2_000_000).cast("decimal(7,0)"))
    cuts = cuts.withColumn("score", F.expr("product div both"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    sizes = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part_size")
    parts = longer.where("size >= 3").select("*", sizes).select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part_size") + 1)).alias("at"))
    covers = parts.groupBy("lang", _part(words, F.col("at"), F.col("part_size")).alias("phrase")).agg(F.max("a").alias("cover"))
    kept = scored.join(covers.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(wide("cover") * 100 < wide("a") * inside, F.lit(True)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_n") <= top).drop("_n", "_part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
