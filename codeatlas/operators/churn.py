"""How often commits touch files and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from .ranking import top


def churn(touches: DataFrame, since=None) -> DataFrame:
    """Commits per path and per folder above it; a path counts once a commit.

    Touches are reduced to one per commit and file before folders are added, and again per
    commit and folder, so a busy root is spread over the commits, never over one key. They meet before they are
    reduced: what a task holds is bounded by the size of a shuffled partition, not by that of a piece of the input.
    """
    if since is not None:
        touches = touches.where(F.col("ts") >= F.lit(since))
    leaf = touches.select("repo", "commit_id", "path").repartition("commit_id", "path").distinct()
    files = leaf.withColumn("is_dir", F.lit(False))
    dirs = (
        leaf.select("repo", "commit_id", paths.parent(F.col("path")).alias("_own")).where("_own <> '.'").distinct()
        .select("repo", "commit_id", F.explode(paths.prefixes(F.col("_own"))).alias("path")).distinct()
        .withColumn("is_dir", F.lit(True))
    )
    return files.unionByName(dirs).groupBy("repo", "path", "is_dir").agg(F.count(F.lit(1)).alias("commits"))


def churn_approx(touches: DataFrame, rsd: float = 0.02) -> DataFrame:
    """As :func:`churn`, with a mergeable distinct-count sketch per path instead of exact sets."""
    every = touches.select("repo", "commit_id", F.explode(paths.prefixes(F.col("path"))).alias("path"))
    return every.groupBy("repo", "path").agg(F.approx_count_distinct("commit_id", rsd).alias("commits"))


def churn_max(counts: DataFrame) -> DataFrame:
    """The busiest file's and the busiest folder's count."""
    return counts.groupBy("repo", "is_dir").agg(F.max("commits").alias("max_commits"))


def churn_levels(counts: DataFrame) -> DataFrame:
    """Scale each count against its own kind: level 1-8, bar, and heat (2 over 2/3, 1 over 1/3)."""
    n, top_n = F.col("commits"), F.col("max_commits")
    level = (F.floor((n * 8 - 1) / top_n) + 1).cast("int")
    heat = F.when(n * 3 > top_n * 2, 2).when(n * 3 > top_n, 1).otherwise(0)
    return (
        counts.join(churn_max(counts), ["repo", "is_dir"])
        .withColumn("level", level)
        .withColumn("bar", text.churn_bar(F.col("level"), n))
        .withColumn("heat", heat.cast("int"))
    )


def hottest(counts: DataFrame, files: DataFrame, n: int = 5) -> DataFrame:
    """The most touched paths that still exist as files."""
    alive = counts.where("not is_dir").join(
        files.select("repo", F.col("rel").alias("path")), ["repo", "path"], "left_semi"
    )
    return top(alive, ["repo"], [F.col("commits").desc(), F.col("path")], n)
