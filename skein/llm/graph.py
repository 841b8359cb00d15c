"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import checkpointed

MAX_ROUNDS = 60
#: Narrow rows (some 50 bytes) that one task takes at least.
TASK_ROWS = 100_000


def dealt(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """df, which has been written, in as few partitions as its number of rows needs: a small one has one, and joins and groups of such are not shuffled."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, small: bool = False) -> DataFrame:
    """columns a, b (long) to node, label: label is the least node that node reaches.

    Alternates the large and the small star: each node hands the least of its neighbourhood to its
    greater neighbours, then to its lesser ones, until no link changes. Rounds grow with the
    logarithm of the longest path. Every round's links are written to the checkpoint folder, and
    only a count and a sum reach the driver. Without links the result is empty. small keeps
    each round's links in as few partitions as their number needs (see dealt()).
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    parts = lambda n: max(1, -(-n // TASK_ROWS))
    current, before = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    if small:
        current = current.coalesce(n := parts(current.count()))
    for _ in range(MAX_ROUNDS):
        # What a round puts together of links in one partition stays in one: one task and one file, not as many as there are shuffle partitions.
        joined = (lambda e: e.coalesce(1)) if small and n == 1 else (lambda e: e)
        e = joined(both(current))
        large = e.join(_least(e), "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = _least(down)
        lesser = joined(down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))).filter("a <> b").distinct()
        current = checkpointed(lesser)
        s = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if small:
            current = current.coalesce(n := parts(s["n"]))
        if (s["n"], s["h"]) == before:
            break
        before = (s["n"], s["h"])
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
