"""Connected components by alternating large-star and small-star steps.

Every step is a join and an aggregation over edges; nothing is gathered on the driver but two
numbers a round. Lineage is cut by checkpoint().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded, checkpointed, few_files

FILE_EDGES = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _beside(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges with m of their node a. A small table of least nodes is broadcast; a large one is cut off from its
    aggregation first, since Spark splits a hub's edges only if both sides of the join are plain shuffles."""
    small = bounded(least, n, 24)
    return edges.join(small if small is not least else checkpointed(least, -(-n // FILE_EDGES)), "a")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _beside(both.where("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _beside(down, least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); the root is the component's smallest node, itself included."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges, few_files(edges.sparkSession))
    before = _state(edges)
    while before[0]:
        edges = checkpointed(_small_star(_large_star(edges, before[0]), before[0]), files=-(-before[0] // FILE_EDGES))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
