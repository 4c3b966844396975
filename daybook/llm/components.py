"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Every round links the neighbours of a node to the least of them, first upwards, then downwards,
    and the number of rounds grows with the logarithm of the longest chain.  Edges never leave the
    cluster; a round's table replaces the one before it.  Raises where ``most_rounds`` do not settle them.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _digest(now)
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now)))
        after = _digest(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _digest(edges: DataFrame):
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(mixed % 1_000_003), F.bit_xor(mixed)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    linked = edges.join(least, "a")
    return (
        linked.where("b <> least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(least.select("a", F.col("least").alias("b")))
        .distinct()
    )
