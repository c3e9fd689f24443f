"""What a change could affect, and the tests that reach it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, paths
from .graph import fixture_links, reach


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed paths and deleted paths of ``changes(repo, path, status)``."""
    paths_of = lambda df: df.select("repo", F.col("path").alias("rel"))
    return paths_of(changes.where("status <> 'D'")), paths_of(changes.where("status = 'D'"))


def seeds(changed: DataFrame, files: DataFrame) -> DataFrame:
    """Changed files that are in the graph."""
    return files.join(changed.select("repo", "rel").distinct(), ["repo", "rel"], "left_semi")


def not_in_graph(changed: DataFrame, files: DataFrame) -> DataFrame:
    """Changed paths the graph doesn't hold."""
    return changed.select("repo", "rel").distinct().join(files.select("repo", "rel"), ["repo", "rel"], "left_anti")


def affected(
    edges: DataFrame, files: DataFrame, changed: DataFrame, depth: int | None = None, parents: bool = False
) -> DataFrame:
    """Everything that depends on a changed file, at its shortest distance."""
    starts = seeds(changed, files).select("repo", F.lit("change").alias("start"), "id")
    return reach(
        edges, files, starts, reverse=True, depth=depth, parents=parents, fixtures=fixture_links(files)
    ).drop("start")


def tests_to_run(files: DataFrame, changed: DataFrame, hits: DataFrame) -> DataFrame:
    """Changed tests and tests that reach a change; helpers among the tests aren't run."""
    rel, test = F.col("rel"), F.col("is_test")
    every = seeds(changed, files).select("repo", "rel", "is_test").unionByName(hits.select("repo", "rel", "is_test"))
    return every.where(labels.is_runnable_test(rel, test)).select("repo", "rel").distinct()


def go_test_packages(tests: DataFrame) -> DataFrame:
    """Folders of Go tests as ``go test`` names them."""
    d = paths.parent(F.col("rel"))
    name = F.when(d == ".", ".").otherwise(F.concat(F.lit("./"), d))
    return tests.where(F.col("rel").endswith("_test.go")).select("repo", name.alias("package")).distinct()


def direct_importer_packages(edges: DataFrame, files: DataFrame, changed_dirs: DataFrame, hits: DataFrame) -> DataFrame:
    """Affected Go folders that depend on no other affected folder outside the changed ones."""
    go = hits.where(F.col("rel").endswith(".go")).withColumn("dir", paths.parent(F.col("rel"))).join(
        changed_dirs.select("repo", "dir").distinct(), ["repo", "dir"], "left_anti"
    )
    here = go.select("repo", F.col("id").alias("src"), "dir")
    other = (
        hits.select("repo", F.col("id").alias("dst"), paths.parent(F.col("rel")).alias("dep_dir"))
        .join(changed_dirs.select("repo", F.col("dir").alias("dep_dir")).distinct(), ["repo", "dep_dir"], "left_anti")
    )
    unsafe = (
        edges.join(here, ["repo", "src"]).join(other, ["repo", "dst"])
        .where("dep_dir <> dir").select("repo", "dir").distinct()
    )
    return go.select("repo", "dir").distinct().join(unsafe, ["repo", "dir"], "left_anti")
