"""Reading repositories: folders of checkouts, and the selection of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, paths


def read_folder(spark: SparkSession, root: str, with_repo: bool = True) -> DataFrame:
    """(repo, rel, size, mtime, content) of every file below ``root``.

    With ``with_repo`` each folder right below ``root`` is a repository; otherwise ``root`` is one.
    Unreadable or corrupt files are skipped by Spark's own switches if the session sets them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    inside = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/")
    rel = F.substring(inside, F.locate(prefix, inside) + len(prefix), F.length(inside))
    rows = files.select(rel.alias("p"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    if with_repo:
        repo, path = F.substring_index("p", "/", 1), F.regexp_replace("p", "^[^/]*/", "")
    else:
        repo, path = F.lit(prefix.rstrip("/").split("/")[-1]), F.col("p")
    return rows.select(repo.alias("repo"), path.alias("rel"), "size", "mtime", "content")


def selected(rel: Column, tests: bool) -> Column:
    """A source file of the project itself: no samples, fixtures or vendored code."""
    own = labels.source_lang(rel).isNotNull() & ~paths.in_folder(rel, labels.SKIPPED_DIRS)
    return own if tests else own & ~labels.is_test(rel)


def select_sources(files: DataFrame, tests: bool = True) -> DataFrame:
    """(repo, id, rel, is_test): all source files."""
    rel = F.col("rel")
    return files.where(selected(rel, tests)).select("repo", rel.alias("id"), "rel", labels.is_test(rel).alias("is_test"))


def readable(contents: DataFrame) -> DataFrame:
    """Contents as text, without binary files."""
    text = F.decode("content", "UTF-8") if dict(contents.dtypes)["content"] == "binary" else F.col("content")
    return contents.withColumn("content", text).where(F.instr("content", "\0") == 0)


def drop_special(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files without links and pipes, and per repo how many of those were left out."""
    return files.where(~F.col("special")).drop("special"), files.groupBy("repo").agg(F.count_if("special").alias("special"))
