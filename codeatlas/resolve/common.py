"""The joins all resolvers share. ``sources(repo, rel)`` are the files an import can reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def first_existing(candidates: DataFrame, keys: list[str], sources: DataFrame) -> DataFrame:
    """Ordered-candidate probe: per ``keys``, the first path of ``cands`` that is a source file."""
    tried = candidates.select(*keys, F.posexplode("cands").alias("_pos", "rel"))
    return (
        tried.join(sources.select("repo", "rel"), ["repo", "rel"])
        .groupBy(*keys).agg(F.min_by("rel", "_pos").alias("target"))
    )


def nearest(folders: DataFrame, marked: DataFrame, value: Column) -> DataFrame:
    """Nearest-ancestor join: for each ``folders(repo, dir)``, ``value`` of the closest marked folder.

    ``marked`` has one row per (repo, at).
    """
    up = folders.select("repo", "dir", F.posexplode(paths.folders_up(F.col("dir"))).alias("_up", "at"))
    return (
        up.join(marked, ["repo", "at"])
        .groupBy("repo", "dir").agg(F.min_by(F.struct(F.col("at"), value.alias("value")), "_up").alias("_n"))
        .select("repo", "dir", "_n.at", "_n.value")
    )


def longest_prefix(names: DataFrame, name: str, known: DataFrame, sep: str = "/") -> DataFrame:
    """For each distinct ``name``, the longest ``known`` key equal to it or ending at a ``sep`` in it.

    ``known`` has one row per (repo, key); its other columns come along.
    """
    p = F.split(F.col(name), F.lit("\\" + sep), -1)
    heads = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), sep))
    tried = names.select("repo", name).distinct().select("repo", name, F.explode(heads).alias("key"))
    extra = [c for c in known.columns if c not in ("repo", "key")]
    found = tried.join(known, ["repo", "key"])
    best = F.max_by(F.struct("key", *extra), F.length("key")).alias("_b")
    return found.groupBy("repo", name).agg(best).select("repo", name, "_b.*")


def suffix_index(sources: DataFrame) -> DataFrame:
    """(repo, suffix, rel): every tail of a path without extension; the first file in walk order has it."""
    rel = F.col("rel")
    tails = sources.select("repo", "rel", F.explode(paths.suffixes(paths.stem(rel))).alias("suffix"))
    return tails.groupBy("repo", "suffix").agg(F.min_by("rel", paths.walk_key(rel)).alias("rel"))


def links(specs: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Specs with their ``target``; a file never links to itself."""
    return specs.join(resolved, ["repo", *keys]).where("target <> src").select("repo", "src", "ord", "spec", "target")
