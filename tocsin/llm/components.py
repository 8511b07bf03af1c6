"""Connected components of an edge table, by alternating star operations.

Each round replaces edges by stars around smaller nodes, with a hash aggregate
(partly done before the shuffle) and an equality join per half.  The aggregates'
results are written before they are joined, so both sides of a join are shuffled for it
and Spark's skew join can split hubs of any degree.  Rounds grow with the
logarithm of the longest path.  Every round is written to the shared folder, so
its lineage is one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.shared import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame, purpose: str) -> DataFrame:
    """Each larger neighbour of a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = stored(least, f"{purpose}-least")
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()


def _small(edges: DataFrame, purpose: str) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these; u < v in all edges."""
    least = stored(edges.groupBy("v").agg(F.min("u").alias("m")), f"{purpose}-least")
    moved = edges.join(least, "v").where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """node, root for every node of ``edges(u, v)``: the least node that a path reaches.

    Loops, repeated edges and either direction are allowed; nulls are not.
    A node without an edge to another node has no row.
    """
    ordered = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now = stored(ordered, purpose)
    before = _state(now)
    while before[0]:
        large = stored(_large(now, purpose), purpose)
        now = stored(_small(large, purpose), purpose)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node").unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
