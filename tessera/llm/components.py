"""Connected components by alternating stars, on tables: no graph is held by the driver or by one task.

The least neighbours of the wide step are a table of their own: a join of two tables is one that Spark splits where a key is hot, so
the edges of a cluster's hub needn't meet in one task; the least itself is found by partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

MOST_ROUNDS = 60


def _star(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """edges (a, b), a > b. Each node's greater neighbours, and the node, are tied to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stages.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
    tied = both.join(least, "a")
    return tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's lesser neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, stages: Stages, tag: str = "cc") -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge and isn't itself the least.
    edges: (a, b) of long ids, in any direction, repeats and loops allowed."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, last = stages.put(e, f"{tag}0"), None
    for k in range(1, MOST_ROUNDS + 1):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
        nxt = stages.put(_small_star(_star(e, stages, f"{tag}{k}least")), f"{tag}{k}")
        stages.drop(f"{tag}{k - 1}", f"{tag}{k}least")
        e = nxt
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
