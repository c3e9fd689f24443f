"""Go: names to files, within a package and through imports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import golang as go
from ..extract.manifests import go_modules
from ..functions import paths
from ..storage import stage
from .common import longest_prefix


@dataclass(frozen=True)
class GoTables:
    """What Go files declare and use, keyed by file."""

    files: DataFrame  # repo, src, dir, pkg, is_test, walk
    facts: DataFrame  # one row per file
    declares: DataFrame  # repo, src, name
    methods: DataFrame  # repo, src, recv, name
    uses: DataFrame  # repo, src, name
    called: DataFrame  # repo, src, name
    imports: DataFrame  # repo, src, ord, path, name, to_dir
    selectors: DataFrame  # repo, src, pkg, name


def tables(contents: DataFrame, sources: DataFrame, manifests: DataFrame) -> GoTables:
    return tables_of(go.file_facts(contents), sources, manifests)


def tables_of(facts: DataFrame, sources: DataFrame, manifests: DataFrame) -> GoTables:
    """The same from ``facts`` at hand."""
    src = lambda df: df.withColumnRenamed("rel", "src")
    rel = F.col("rel")
    files = go.packages(facts).join(sources.select("repo", "rel", "is_test"), ["repo", "rel"]).select(
        "repo", rel.alias("src"), paths.parent(rel).alias("dir"), "pkg", "is_test", paths.walk_key(rel).alias("walk")
    )
    imps = go.imports(facts)
    modules = go_modules(manifests).select("repo", "key", F.col("dir").alias("mod_dir"))
    found = longest_prefix(imps, "path", modules)
    rest = F.substring(F.col("path"), F.length("key") + 2, F.length("path"))
    to_dir = F.when(rest == "", F.col("mod_dir")).otherwise(paths.join(F.col("mod_dir"), rest))
    dirs = found.select("repo", "path", to_dir.alias("to_dir"))
    return GoTables(
        stage(files, "go-files")[0], facts, src(go.declares(facts)), src(go.methods(facts)), src(go.uses(facts)), src(go.called(facts)),
        src(imps).join(dirs, ["repo", "path"], "left"), src(go.selectors(facts)),
    )


def owners(t: GoTables) -> DataFrame:
    """(repo, dir, pkg, name, is_test, owner): the first file of a package declaring a name."""
    named = t.declares.select("repo", "src", "name").join(t.files, ["repo", "src"])
    return named.groupBy("repo", "dir", "pkg", "name", "is_test").agg(F.min_by("src", "walk").alias("owner"))


def package_of(t: GoTables) -> DataFrame:
    """(repo, to_dir, to_pkg): the package name of a folder, from its first file other than a test."""
    return t.files.where("not is_test").groupBy("repo", F.col("dir").alias("to_dir")).agg(F.min_by("pkg", "walk").alias("to_pkg"))


def same_package(t: GoTables, own: DataFrame | None = None) -> DataFrame:
    """(repo, src, dst, name): uses of names the own package declares; tests may also use tests' names. ``own`` may hold :func:`owners`."""
    own = owners(t) if own is None else own
    used = t.uses.join(t.files.select("repo", "src", "dir", "pkg", "is_test"), ["repo", "src"])
    code = own.where("not is_test").selectExpr("repo", "dir", "pkg", "name", "owner as code_owner")
    tests = own.where("is_test").selectExpr("repo", "dir", "pkg", "name", "owner as test_owner")
    key = ["repo", "dir", "pkg", "name"]
    both = used.join(code, key, "left").join(tests, key, "left")
    return both.withColumn("dst", F.expr("coalesce(code_owner, case when is_test then test_owner end)")).where(
        "dst is not null").select("repo", "src", "dst", "name")


def methods_elsewhere(t: GoTables, own: DataFrame | None = None) -> DataFrame:
    """(repo, src, dst, name): calls of methods declared away from their type, in the same package. ``own`` may hold :func:`owners`."""
    own = owners(t) if own is None else own
    place = t.files.select("repo", "src", "dir", "pkg", "is_test")
    declared = t.methods.join(place.where("not is_test"), ["repo", "src"])
    types = own.where("not is_test").selectExpr("repo", "dir", "pkg", "name as recv", "owner")
    away = declared.join(types, ["repo", "dir", "pkg", "recv"]).where("owner <> src").selectExpr(
        "repo", "dir", "pkg", "name", "src as dst").distinct()
    calls = t.called.join(place, ["repo", "src"]).select("repo", "src", "dir", "pkg", "name")
    return calls.join(away, ["repo", "dir", "pkg", "name"]).where("src <> dst").select("repo", "src", "dst", "name")


def imported(t: GoTables, own: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links through imports: (repo, src, dst, pkg, name) by selected name, and (repo, src, to_dir) by package.

    Blank and dot imports, and imports none of whose selected names is found, take the whole package. ``own`` may hold :func:`owners`.
    """
    own = owners(t) if own is None else own
    reach = t.imports.where("to_dir is not null").join(package_of(t), ["repo", "to_dir"])
    reach = reach.withColumn("local", F.expr("coalesce(name, to_pkg)"))
    whole = reach.where("local in ('_', '.')").select("repo", "src", "to_dir")
    # Of two imports with one local name the later one holds.
    named = reach.where("local not in ('_', '.')").groupBy("repo", "src", F.col("local").alias("pkg")).agg(
        F.max_by(F.struct("to_dir", "to_pkg"), "ord").alias("i")
    ).select("repo", "src", "pkg", "i.*")
    code = own.where("not is_test").selectExpr("repo", "dir as to_dir", "pkg as to_pkg", "name", "owner as dst")
    named, _ = stage(named, "go-named")
    picked = t.selectors.join(named, ["repo", "src", "pkg"]).join(code, ["repo", "to_dir", "to_pkg", "name"])
    picked, _ = stage(picked, "go-picked")
    unresolved = named.select("repo", "src", "to_dir").distinct().join(
        picked.select("repo", "src", "to_dir").distinct(), ["repo", "src", "to_dir"], "left_anti"
    )
    return picked.select("repo", "src", "dst", "pkg", "name"), whole.unionByName(unresolved).distinct()


def package_links(t: GoTables, whole: DataFrame) -> DataFrame:
    """(repo, src, dst): all files of a package other than tests, for each (repo, src, to_dir)."""
    members = t.files.where("not is_test").select("repo", F.col("dir").alias("to_dir"), "pkg", F.col("src").alias("dst")).join(
        package_of(t).withColumnRenamed("to_pkg", "pkg"), ["repo", "to_dir", "pkg"]
    )
    return whole.join(members, ["repo", "to_dir"]).select("repo", "src", "dst")


def edges(t: GoTables) -> DataFrame:
    """(repo, src, dst) of all Go links, repeats included."""
    own, _ = stage(owners(t), "go-owners")
    by_name, whole = imported(t, own)
    pair = lambda df: df.select("repo", "src", "dst")
    return (
        pair(same_package(t, own)).unionByName(pair(methods_elsewhere(t, own))).unionByName(pair(by_name))
        .unionByName(package_links(t, whole)).where("src <> dst")
    )
