"""Connected components by alternating stars, for graphs of any shape.

A round points every larger neighbour of a node to the least node it knows, then every node's smaller neighbours
to their least. All of it is least-value aggregation, combined before each shuffle, and joins whose other side holds one row
per node, so a hub is never gathered in one task. Each round is written to the shared folder; the loop ends when
a round changes nothing, after a number of rounds that grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    df, seen = stage(edges, "stars", mark=mark)
    return df, (seen["rows"], seen["mark"])


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    hung = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return low.select("a", F.col("m").alias("b")).unionByName(hung).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links(a, b)`` that isn't its component's least node."""
    ends = F.greatest("a", "b"), F.least("a", "b")
    edges, mark = _written(links.select(ends[0].alias("a"), ends[1].alias("b")).where("a <> b").distinct())
    while mark[0]:
        edges, now = _written(_stars(edges))
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
