"""Manifests and configs as tables: go.mod, package.json, tsconfig, Cargo.toml."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import labels, paths
from .imports import js_code

_TARGETS = ArrayType(StructType([StructField("key", StringType()), StructField("targets", ArrayType(StringType()))]))
# Which condition of an exports map is tried first; others come between node and types.
CONDITION_RANK = {"source": 0, "development": 1, "import": 2, "default": 3, "require": 4, "node": 5, "types": 9}


def json_text(content: Column) -> Column:
    """JSON without comments and trailing commas."""
    return F.regexp_replace(js_code(content), r",(\s*[}\]])", "$1")


def go_modules(contents: DataFrame) -> DataFrame:
    """(repo, key, dir): module paths of go.mod files; the shallowest folder has a repeated one."""
    rel = F.col("rel")
    name = F.regexp_extract("content", r'(?md)^[^\S\n]*module[ ]+"?([^"\n]*?)"?[^\S\n]*$', 1)
    own = (paths.base(rel) == "go.mod") & ~paths.in_folder(rel, labels.SKIPPED_DIRS)
    mods = contents.where(own).select("repo", F.trim(name).alias("key"), paths.parent(rel).alias("dir"), "rel")
    return mods.where("key <> ''").groupBy("repo", "key").agg(
        F.min_by("dir", F.struct(paths.depth(rel), paths.walk_key(rel))).alias("dir")
    )


def _leaves(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for v in value for t in _leaves(v)]
    if isinstance(value, dict):
        ordered = sorted(value, key=lambda k: (CONDITION_RANK.get(k, 6), k))
        return [t for k in ordered for t in _leaves(value[k])]
    return []


def _flat_map(text: str | None, wrap: bool) -> list[dict] | None:
    try:
        value = None if text is None else json.loads(text)
    except ValueError:  # a plain string arrives without its quotes
        value = text
    if value is None:
        return None
    if wrap and not (isinstance(value, dict) and any(k.startswith(".") for k in value)):
        value = {".": value}
    items = value.items() if isinstance(value, dict) else []
    return [{"key": k, "targets": _leaves(v)} for k, v in items]


@pandas_udf(_TARGETS)
def export_targets(text: pd.Series) -> pd.Series:
    """An exports value as (subpath, targets in order of preference)."""
    return text.map(lambda t: _flat_map(t, True))


@pandas_udf(_TARGETS)
def import_targets(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _flat_map(t, False))


def js_packages(contents: DataFrame) -> DataFrame:
    """(repo, rel, at, name, exports, imports, entry, deps) of every readable package.json."""
    rel = F.col("rel")
    schema = (
        "name string, exports string, imports string, main string, module string, source string, types string, "
        "dependencies map<string,string>, devDependencies map<string,string>"
    )
    parsed = contents.where(paths.base(rel) == "package.json").select(
        "repo", "rel", paths.parent(rel).alias("at"), F.from_json(json_text(F.col("content")), schema).alias("p")
    )
    entry = F.filter(F.array("p.source", "p.module", "p.main", "p.types"), lambda e: e.isNotNull() & (e != ""))
    deps = F.array_union(
        F.coalesce(F.map_keys("p.dependencies"), F.array().cast("array<string>")),
        F.coalesce(F.map_keys("p.devDependencies"), F.array().cast("array<string>")),
    )
    return parsed.where("p is not null").select(
        "repo", "rel", "at", F.col("p.name").alias("name"), export_targets("p.exports").alias("exports"),
        import_targets("p.imports").alias("imports"), entry.alias("entry"), deps.alias("deps"),
    )


def ts_configs(contents: DataFrame) -> DataFrame:
    """(repo, rel, extends, base_url, paths) of every JSON file that could be a config or its parent."""
    schema = "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"
    parsed = contents.where(F.col("rel").endswith(".json")).select(
        "repo", "rel", F.from_json(json_text(F.col("content")), schema).alias("c")
    ).where("c is not null")
    many = F.from_json("c.extends", "array<string>")
    parents = F.when(F.col("c.extends").startswith("["), many).when(F.col("c.extends").isNotNull(), F.array("c.extends"))
    return parsed.select(
        "repo", "rel", F.coalesce(parents, F.array().cast("array<string>")).alias("extends"),
        F.col("c.compilerOptions.baseUrl").alias("base_url"), F.col("c.compilerOptions.paths").alias("paths"),
    )


def cargo_lines(contents: DataFrame) -> DataFrame:
    """(repo, rel, n, section, header, key, value): the key lines of Cargo.toml files under their headers.

    The window is over one manifest, a small file.
    """
    rel = F.col("rel")
    lines = contents.where(paths.base(rel) == "Cargo.toml").select(
        "repo", "rel", F.posexplode(F.split("content", "\n")).alias("n", "raw")
    ).withColumn("line", F.trim(F.regexp_replace("raw", r"\s", " ")))
    is_header = F.col("line").startswith("[")
    w = W.partitionBy("repo", "rel").orderBy("n")
    value = F.trim(F.regexp_extract("line", r"\A[^=]*=(.*)\z", 1))
    quoted = F.regexp_extract(value, r"""\A(?:"([^"]*)"|'([^']*)')""", 1)
    single = F.regexp_extract(value, r"""\A'([^']*)'""", 1)
    clean = F.when(value.rlike(r'\A"[^"]*"'), quoted).when(value.rlike(r"\A'[^']*'"), single).otherwise(value)
    marked = lines.withColumn("_h", F.when(is_header, F.struct("n", F.regexp_replace("line", r"\s*#.*\z", "").alias("text"))))
    here = marked.withColumn("_s", F.last("_h", ignorenulls=True).over(w))
    return here.select(
        "repo", "rel", "n", F.col("_s.text").alias("header"), F.col("_s.n").alias("section"), is_header.alias("is_header"),
        F.trim(F.substring_index("line", "=", 1)).alias("key"), F.when(F.col("line").contains("="), clean).alias("value"),
    )


def _section(name: str) -> Column:
    return F.regexp_replace("header", r"\A[\[\] ]+|[\[\] ]+\z", "") == name


def crates(contents: DataFrame) -> DataFrame:
    """(repo, at, name, lib_name, lib_path, bins) of manifests with a [package]."""
    value = lambda section, key: F.max_by(
        F.when(_section(section) & (F.col("key") == key), F.col("value")), F.when(_section(section) & (F.col("key") == key), F.col("n"))
    )
    bins = F.collect_list(F.when(_section("bin") & (F.col("key") == "path"), F.struct("n", "value")))
    return (
        cargo_lines(contents).groupBy("repo", "rel")
        .agg(
            F.max(F.coalesce(_section("package"), F.lit(False))).alias("pkg"), value("package", "name").alias("name"),
            value("lib", "name").alias("lib_name"), value("lib", "path").alias("lib_path"),
            F.transform(F.array_sort(bins), lambda s: s["value"]).alias("bins"),
        )
        .where("pkg").select("repo", paths.parent(F.col("rel")).alias("at"), "rel", "name", "lib_name", "lib_path", "bins")
    )


def cargo_tests(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared [[test]] targets (repo, at, file, name), and per manifest whether tests/*.rs run by themselves."""
    lines = cargo_lines(contents).withColumn("value", F.regexp_replace("value", r"\s*#.*\z", ""))
    pick = lambda key: F.max_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("n")))
    tables = lines.where("header = '[[test]]'").groupBy("repo", "rel", "section").agg(pick("name").alias("name"), pick("path").alias("path"))
    file = paths.clean(F.coalesce("path", F.concat(F.lit("tests/"), "name", F.lit(".rs"))))
    declared = tables.where("name <> ''").select("repo", paths.parent(F.col("rel")).alias("at"), file.alias("file"), "name")
    off = F.max(F.coalesce((F.col("header") == "[package]") & (F.col("key") == "autotests") & (F.col("value") == "false"), F.lit(False)))
    auto = lines.groupBy("repo", "rel").agg((~off).alias("auto")).select("repo", paths.parent(F.col("rel")).alias("at"), "auto")
    return declared, auto
