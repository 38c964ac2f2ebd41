"""Reply trees as training conversations.

Messages name their parent. Iterative self-joins that double the distance of every step give each
message its root, depth and path score, and then the messages of each chosen root-to-leaf path. Every
turn is formatted on its own, so a path of any length is a run of parts, in order, never one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import cut, shuffle_partitions

START, STOP = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Put one more backslash between any ``<`` and ``|``, so that no text can hold a control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def distinct_messages(messages: DataFrame, *columns: str) -> DataFrame:
    """One row of each message: (tree_id, message_id, parent_id, score, columns). Of rows that repeat a message's ids
    the smallest by these columns counts, nulls first; rows with a null tree_id or message_id belong to no tree
    and are left out."""
    names = ["parent_id", "score", *columns]
    found = messages.where("tree_id is not null and message_id is not null").groupBy("tree_id", "message_id").agg(F.min(F.struct(*names)).alias("m"))
    return found.select("tree_id", "message_id", *(F.col(f"m.{c}").alias(c) for c in names))


def paths(messages: DataFrame, top: int | None = 1, unique: bool = False) -> DataFrame:
    """(tree_id, leaf_id, rank, part, message_id): the messages of the ``top`` branches of each tree (None: all).

    ``messages`` has tree_id (string), message_id and parent_id (long), score (double; null counts as
    0); distinct_messages says what repeated and null ids count as, and ``unique`` that there are none. A null parent, or one that is not in the tree, makes a root. Branches
    rank by the sum of their scores, then the longer, then the smaller leaf. Messages that follow
    each other in a circle have no root and no path. An empty table gives no rows.
    """
    rows = messages if unique else distinct_messages(messages)
    nodes = rows.select("tree_id", F.col("message_id").alias("id"), F.col("parent_id").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    known = nodes.select("tree_id", F.col("id").alias("up")).withColumn("known", F.lit(True))
    state = nodes.join(known, ["tree_id", "up"], "left").select("tree_id", "id", F.when(F.col("known"), F.col("up")).alias("up"), "total", F.lit(1).cast("long").alias("depth"))
    state = cut(state)
    leaves = state.select("tree_id", "id").join(state.where("up is not null").select("tree_id", F.col("up").alias("id")), ["tree_id", "id"], "left_anti")
    size = state.count()
    closed, open_ = state.where("up is null"), state.where("up is not null")
    steps = []
    while 1 << len(steps) <= max(1, size) and not open_.isEmpty():
        steps.append(open_.select("tree_id", F.col("id").alias("message_id"), "up"))
        further = closed.unionByName(open_).select("tree_id", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        moved = cut(open_.join(further, ["tree_id", "up"]).select("tree_id", "id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")))
        closed, open_ = closed.unionByName(moved.where("up is null")), moved.where("up is not null")
    ends = leaves.join(closed, ["tree_id", "id"])
    best = Window.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("depth"), "id")
    ends = ends.withColumn("rank", F.row_number().over(best))
    if top is not None:
        ends = ends.where(F.col("rank") <= top)
    found = ends.select("tree_id", F.col("id").alias("leaf_id"), "rank", (F.col("depth") - 1).alias("part"), F.col("id").alias("message_id"))
    for k in reversed(range(len(steps))):
        above = found.join(steps[k], ["tree_id", "message_id"]).select("tree_id", "leaf_id", "rank", (F.col("part") - (1 << k)).alias("part"), F.col("up").alias("message_id"))
        found = cut(found.unionByName(above))
    return found


def format_paths(messages: DataFrame, top: int | None = 1, unique: bool = False) -> DataFrame:
    """(tree_id, leaf_id, rank, part, formatted, loss_start, loss_end) of the chosen paths of ``messages``,
    which also has role and text (null: empty).

    The parts of a path, in order, are its conversation. A part is start mark, escaped role, newline,
    escaped text, stop mark, newline; the loss span is the text of an assistant's part, in code
    points from the part's start, and null for other roles.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = messages if unique else distinct_messages(messages, "role", "text")
    turn = rows.select("tree_id", "message_id", role.alias("role"), _escape_role(role).alias("r"), escape(text).alias("t"))
    from_here = F.length("r") + len(START) + 1
    return paths(messages, top, unique).join(turn, ["tree_id", "message_id"]).select(
        "tree_id",
        "leaf_id",
        "rank",
        "part",
        F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(f"{STOP}\n")).alias("formatted"),
        F.when(F.col("role") == "assistant", from_here).alias("loss_start"),
        F.when(F.col("role") == "assistant", from_here + F.length("t")).alias("loss_end"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a stretch of formatted conversation."""
    turns = []
    for part in formatted.split(f"{STOP}\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((_unescape_role(role), unescape(text)))
    return turns


def read_back(parts: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), each from the
    formatted parts alone, read in order as a stream with one part in memory."""
    names = ["tree_id", "leaf_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for tree, leaf, formatted, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[:2] != [tree, leaf]:
                    done += [now] if now else []
                    now = [tree, leaf, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    now[2] += 1
                    now[3].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    under = unescape(formatted[a:b])
                    now[4] += len(under)
                    now[5].update(under.encode("utf-8", "surrogatepass"))
                now[6] += len(formatted)
            if done:
                yield _digests(done)
                done = []
        if now:
            yield _digests([now])

    def _digests(rows: list[list]) -> pa.RecordBatch:
        plain = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in plain], k) for i, k in enumerate(kinds)], names=names)

    ordered = parts.repartition(shuffle_partitions(parts.sparkSession), "tree_id", "leaf_id").sortWithinPartitions("tree_id", "leaf_id", "part")
    return ordered.select("tree_id", "leaf_id", "formatted", "loss_start", "loss_end").mapInArrow(
        run, "tree_id string, leaf_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def chain_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees in which each turn answers the one before.

    Turns that share a number follow by role and text, nulls first; rows with a null conv_id are one
    conversation. The score of a message is the length of its text.
    """
    one = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree_id"), "turn", "role", F.col("text").cast("string").alias("text"))
    k = F.row_number().over(one).cast("long")
    return rows.withColumn("message_id", k).select(
        "tree_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score")
    )
