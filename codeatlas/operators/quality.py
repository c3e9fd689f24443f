"""Scores: how well a graph matches the truth, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_total


def compare_edges(want: DataFrame, got: DataFrame, alt: DataFrame | None = None) -> DataFrame:
    """Each edge that is wanted or drawn, with ``wanted``, ``drawn`` and ``allowed`` flags.

    One shuffle on the edge replaces per-file sets, so a file with very many links is spread out.
    """
    flag = lambda df, w, g, a: df.select("repo", "src", "dst", F.lit(w).alias("w"), F.lit(g).alias("g"), F.lit(a).alias("a"))
    rows = flag(want, 1, 0, 1).unionByName(flag(got, 0, 1, 0))
    if alt is not None:
        rows = rows.unionByName(flag(alt, 0, 0, 1))
    one = lambda c, name: (F.max(c) == 1).alias(name)
    return rows.groupBy("repo", "src", "dst").agg(one("w", "wanted"), one("g", "drawn"), one("a", "allowed"))


def missed(flags: DataFrame) -> DataFrame:
    return flags.where("wanted and not drawn").select("repo", "src", "dst")


def wrong(flags: DataFrame) -> DataFrame:
    return flags.where("drawn and not allowed").select("repo", "src", "dst")


def graph_score(flags: DataFrame) -> DataFrame:
    """Recall and precision of drawn edges per repo; alternatives count as right, never as required."""
    n = lambda cond: F.count_if(F.expr(cond))
    counts = flags.groupBy("repo").agg(
        n("wanted").alias("want"), n("wanted and drawn").alias("hit"), n("drawn").alias("got"),
        n("drawn and allowed").alias("correct"), n("wanted and not drawn").alias("missed"),
        n("drawn and not allowed").alias("wrong"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.withColumn("recall", ratio("hit", "want")).withColumn("precision", ratio("correct", "got"))


def folder_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """File to folder edges, other folders only: how package-level links are compared."""
    from ..functions import paths

    dirs = files.select("repo", F.col("id").alias("dst"), paths.parent(F.col("rel")).alias("dir"))
    own = files.select("repo", F.col("id").alias("src"), paths.parent(F.col("rel")).alias("own"))
    return (
        edges.join(dirs, ["repo", "dst"]).join(own, ["repo", "src"]).where("dir <> own")
        .select("repo", "src", F.col("dir").alias("dst")).distinct()
    )


def run_summary(runs: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Per group: runs, failures, exact matches, and mean, median and sum of each metric over good runs.

    ``runs`` has ``ok`` and ``exact`` flags. Medians come from a distributed ranking, so a group
    of any size is never held in one aggregation buffer.
    """
    good = lambda c: F.when(F.col("ok"), F.col(c))
    aggs = [
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("ok") & F.col("exact")).alias("exact"),
    ]
    for m in metrics:
        aggs += [F.avg(good(m)).alias(f"mean_{m}"), F.sum(good(m)).alias(f"sum_{m}")]
    out = runs.groupBy(group).agg(*aggs)
    for m in metrics:
        out = out.join(_medians(runs.where("ok"), group, m), group, "left")
    return out


def _medians(rows: DataFrame, group: str, metric: str) -> DataFrame:
    """Exact medians from the counts of distinct values, so a value that most rows share is one row."""
    counts = rows.where(F.col(metric).isNotNull()).groupBy(group, metric).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running_total(counts, [group], [F.col(metric)], "_k", "_upto")
    sizes = counts.groupBy(group).agg(F.sum("_k").alias("_n"))
    holds = lambda rank: ((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_k"))).cast("int")
    hits = holds(F.floor((F.col("_n") + 1) / 2)) + holds(F.floor(F.col("_n") / 2) + 1)
    middle = ranked.join(sizes, group).withColumn("_hits", hits).where("_hits > 0")
    return middle.groupBy(group).agg((F.sum(F.col(metric) * F.col("_hits")) / 2).alias(f"median_{metric}"))
