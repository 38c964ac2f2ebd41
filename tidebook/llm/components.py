"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        both.join(least, "a")
        .where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph whose links are the rows (a, b) of longs.

    Returns (node, component): every node that has a link to a smaller node of its component, with
    the smallest node of that component. The smallest nodes themselves and unlinked nodes have no
    row. Links with a null end and links of a node to itself are ignored; repeated links are one
    link; no links give no rows. Each round is written to the shared folder.
    """
    state = cut(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    mark = None
    for _ in range(max_rounds):
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or now["n"] == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
        state = cut(_small_star(_large_star(state)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
