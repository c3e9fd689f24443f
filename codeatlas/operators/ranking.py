"""Ranks, running totals, caps and budgets that hold for groups of any size.

A plain window sorts each group in one task. Full rankings here are range-partitioned
instead: rows are sorted across tasks, and only one count (or sum) per task and group is
carried over. Capped lists keep ``row_number() <= n``, which Spark limits per task before
the shuffle, so a huge group sends at most ``n`` rows from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stage


def _range_sorted(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Written rows in (keys, order) order, with the task that held them and an increasing number."""
    by = [F.col(k) for k in keys] + order
    placed = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    return stage(placed, "sorted")[0]


def _before(runs: DataFrame, keys: list[str], total: str) -> DataFrame:
    """Sum of ``total`` over a group's earlier tasks: one row per task and group."""
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("_before", F.coalesce(F.sum(total).over(earlier), F.lit(0)))


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``row_number`` per ``keys`` by ``order``, without putting a group into one task."""
    rows = _range_sorted(df, keys, order)
    runs = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    number = (F.col("_before") + F.col("_seq") - F.col("_first") + 1).cast("long")
    return rows.join(_before(runs, keys, "_n"), [*keys, "_part"]).select(*df.columns, number.alias(name))


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` per ``keys`` by ``order``, the row itself included."""
    rows = _range_sorted(df, keys, order)
    runs = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_n"))
    within = F.sum(value).over(W.partitionBy(*keys, "_part").orderBy("_seq"))
    return (
        rows.withColumn("_within", within)
        .join(_before(runs, keys, "_n"), [*keys, "_part"])
        .select(*df.columns, (F.col("_before") + F.col("_within")).cast("long").alias(name))
    )


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Leading rows whose running cost stays within ``budget``; costs aren't negative."""
    return running_total(df, keys, order, cost, "used").where(F.col("used") <= budget)


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows per ``keys``, numbered."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(
        F.col(name) <= n
    )


def capped_names(df: DataFrame, keys: list[str], order: list[Column], item: str, n: int) -> DataFrame:
    """Per ``keys``: the first ``n`` items joined, then ``+N more``, and the count left out."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    heads = (
        top(df, keys, order, n, "_rank")
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", item))), lambda s: s[item]).alias("_items"))
    )
    omitted = F.greatest(F.col("total") - n, F.lit(0))
    more = F.when(omitted > 0, F.array(F.concat(F.lit("+"), omitted.cast("string"), F.lit(" more"))))
    none = F.array().cast("array<string>")
    return totals.join(heads, keys).select(
        *keys,
        F.array_join(F.concat("_items", F.coalesce(more, none)), ", ").alias("items"),
        "total",
        omitted.alias("omitted"),
    )


def cap_files(entries: DataFrame, order: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` files of each folder (folders all stay), and per folder how many were left out."""
    keys = ["repo", "dir"]
    files = entries.where(~F.col("is_dir"))
    kept = top(files, keys, order, n, "_rank").drop("_rank").unionByName(entries.where("is_dir"))
    more = (
        files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))
        .where(F.col("files") > n)
        .select(*keys, (F.col("files") - n).alias("more"))
    )
    return kept, more


def sibling_order(
    entries: DataFrame, by: str = "name", reverse: bool = False, dirs_first: bool = False
) -> DataFrame:
    """Number the entries of each folder by name, size (largest first) or time (newest first).

    ``reverse`` flips the key but not the folders-first rule, and ties stay in name order.
    """
    order = [F.col("is_dir").desc()] if dirs_first else []
    return number_rows(entries, ["repo", "dir"], order + sibling_keys(by, reverse), "pos")


def sibling_keys(by: str, reverse: bool = False) -> list[Column]:
    """The sort of a folder's entries; equal keys stay in name order either way."""
    key = {"name": F.col("name"), "size": -F.col("size"), "time": F.col("mtime")}[by]
    return [key.desc() if reverse != (by == "time") else key.asc(), F.col("name").asc()]
