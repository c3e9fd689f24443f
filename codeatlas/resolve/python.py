"""Python imports: relative climbs, script folders, manifest roots and re-exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract.imports import py_from_clauses
from ..functions import paths
from ..storage import stage
from .common import first_existing, links

MANIFESTS = ["pyproject.toml", "setup.py", "setup.cfg"]


def roots(files: DataFrame) -> DataFrame:
    """(repo, at, ord): folders holding a Python manifest, each followed by its src/, in walk order."""
    rel = F.col("rel")
    d = paths.parent(rel)
    src = F.when(d == ".", F.lit("src")).otherwise(F.concat(d, F.lit("/src")))
    found = files.where(paths.base(rel).isin(*MANIFESTS)).select(
        "repo", paths.walk_key(rel).alias("k"), F.posexplode(F.array(d, src)).alias("i", "at")
    )
    return found.groupBy("repo", "at").agg(F.min(F.struct("k", "i")).alias("ord"))


def _module_candidates(base: Column) -> Column:
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


def _under(folder: Column, rest: Column) -> Column:
    return F.when(rest == "", folder).when(folder == ".", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _relative(asked: DataFrame, sources: DataFrame) -> DataFrame:
    dots = F.length(F.regexp_extract("spec", r"\A(\.+)", 1))
    climb = paths.folders_up(F.col("dir"))
    up = F.get(climb, F.least(dots, F.size(climb)) - 1)
    rest = F.translate(F.substring(F.col("spec"), dots + 1, F.length("spec")), ".", "/")
    rows = asked.where(F.col("spec").startswith(".")).withColumn("cands", _module_candidates(_under(up, rest)))
    return first_existing(rows, ["repo", "dir", "spec"], sources)


def _from_script_folders(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """Absolute names from the folders above that aren't packages themselves, each with its src/."""
    rel = F.col("rel")
    packages = sources.where(paths.base(rel) == "__init__.py").select("repo", paths.parent(rel).alias("at"), F.lit(True).alias("pkg"))
    dirs = asked.select("repo", "dir").distinct()
    up = dirs.select("repo", "dir", F.posexplode(paths.folders_up(F.col("dir"))).alias("n", "at"))
    # At most one row per folder level, so the list stays as short as a path.
    bases = (
        up.join(packages, ["repo", "at"], "left").where("pkg is null")
        .groupBy("repo", "dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "at"))), lambda s: s["at"]).alias("bases"))
    )
    each = F.flatten(F.transform("bases", lambda b: F.array(b, F.when(b == ".", F.lit("src")).otherwise(F.concat(b, F.lit("/src"))))))
    bases = bases.select("repo", "dir", each.alias("bases"))
    rest = F.translate("spec", ".", "/")
    rows = asked.where(~F.col("spec").startswith(".")).withColumn("first", F.when(rest.contains("/"), F.substring_index(rest, "/", 1)))
    lone = rows.where("first is null").join(bases, ["repo", "dir"])
    # A longer name can only lie in a folder that holds its first part as a folder: that is asked once per folder and first part.
    held = sources.select(F.col("repo"), paths.parent(rel).alias("at")).distinct().select("repo", F.explode(paths.folders_up(F.col("at"))).alias("held")).distinct()
    parts = rows.where("first is not null").select("repo", "dir", "first").distinct().join(bases, ["repo", "dir"])
    parts = parts.select("repo", "dir", "first", F.posexplode("bases").alias("n", "at")).withColumn("held", _under(F.col("at"), F.col("first")))
    holding = parts.join(held, ["repo", "held"]).groupBy("repo", "dir", "first").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "at"))), lambda s: s["at"]).alias("bases")
    )
    every = lone.unionByName(rows.join(holding, ["repo", "dir", "first"]).select(lone.columns))
    every = every.withColumn("cands", F.flatten(F.transform("bases", lambda b: _module_candidates(_under(b, rest)))))
    return first_existing(every, ["repo", "dir", "spec"], sources)


def _from_manifest_roots(asked: DataFrame, sources: DataFrame, root_dirs: DataFrame) -> DataFrame:
    """Absolute names below a manifest root: files are indexed by module name, roots aren't tried."""
    rel = F.col("rel")
    below = sources.where(rel.endswith(".py")).select("repo", "rel", F.explode(paths.ancestors_up(rel)).alias("at"))
    inside = F.when(F.col("at") == ".", rel).otherwise(F.substring(rel, F.length("at") + 2, F.length(rel)))
    is_init = paths.base(rel) == "__init__.py"
    module = F.when(is_init, F.regexp_replace(inside, r"/?__init__\.py\z", "")).otherwise(F.regexp_replace(inside, r"\.py\z", ""))
    # __init__.py is also a module of that name, like any other file
    index = below.join(root_dirs, ["repo", "at"]).select(
        "repo", "ord", "rel", F.explode(F.array(
            F.struct(F.lit(1).alias("kind"), F.when(is_init, module).alias("mod")),
            F.struct(F.lit(0).alias("kind"), F.regexp_replace(inside, r"\.py\z", "").alias("mod")),
        )).alias("m"),
    ).where("m.mod is not null and m.mod <> ''")
    best = index.groupBy("repo", F.col("m.mod").alias("mod")).agg(F.min_by("rel", F.struct("ord", "m.kind")).alias("target"))
    names = asked.where(~F.col("spec").startswith(".")).withColumn("mod", F.translate("spec", ".", "/"))
    return names.join(best, ["repo", "mod"]).select("repo", "dir", "spec", "target")


def resolve_modules(asked: DataFrame, sources: DataFrame, root_dirs: DataFrame) -> DataFrame:
    """(repo, dir, spec, target) for distinct ``asked(repo, dir, spec)`` that name a module."""
    found = _relative(asked, sources).withColumn("_o", F.lit(0))
    found = found.unionByName(_from_script_folders(asked, sources).withColumn("_o", F.lit(1)))
    found = found.unionByName(_from_manifest_roots(asked, sources, root_dirs).withColumn("_o", F.lit(2)))
    return found.groupBy("repo", "dir", "spec").agg(F.min_by("target", "_o").alias("target"))


def reexports(contents: DataFrame, sources: DataFrame, root_dirs: DataFrame) -> DataFrame:
    """(repo, init, name, to, to_name): what each __init__.py re-exports from inside its own package."""
    rel = F.col("rel")
    clauses = contents.where(paths.base(rel) == "__init__.py").select(
        "repo", F.col("rel").alias("init"), paths.parent(rel).alias("dir"),
        F.posexplode(py_from_clauses(F.col("content"))).alias("i", "c"),
    ).select("repo", "init", "dir", "i", F.col("c.mod").alias("spec"), F.arrays_zip("c.names", "c.bound").alias("items"))
    resolved = resolve_modules(clauses.select("repo", "dir", "spec").distinct(), sources, root_dirs)
    inside = clauses.join(resolved, ["repo", "dir", "spec"]).where(
        F.startswith("target", F.concat("dir", F.lit("/"))) & (F.col("target") != F.col("init"))
    )
    names = inside.select("repo", "init", "i", "target", F.posexplode("items").alias("j", "it")).where("it.names <> '*'")
    last = F.max_by(F.struct(F.col("target").alias("to"), F.col("it.names").alias("to_name")), F.struct("i", "j"))
    return names.groupBy("repo", "init", F.col("it.bound").alias("name")).agg(last.alias("e")).select("repo", "init", "name", "e.*")


def _chase(heads: DataFrame, exports: DataFrame) -> DataFrame:
    """Follow ``heads(repo, dir, spec, pkg, name)`` through re-exports to the file that holds the name."""
    keys = ["repo", "dir", "spec", "pkg", "name"]
    open_, size = stage(heads.select(*keys).distinct(), "py-open")
    seen, done = open_, heads.where("false").select("repo", "dir", "spec", F.col("pkg").alias("target"))
    while size["rows"]:
        step, _ = stage(open_.join(exports.withColumnRenamed("init", "pkg"), ["repo", "pkg", "name"]), "py-step")
        final = (paths.base(F.col("to")) != "__init__.py") | (F.col("to") == F.col("pkg"))
        done = done.unionByName(step.where(final).select("repo", "dir", "spec", F.col("to").alias("target")))
        onward = step.where(~final).select("repo", "dir", "spec", F.col("to").alias("pkg"), F.col("to_name").alias("name"))
        # A place seen before closes a circle of re-exports.
        open_, size = stage(onward.distinct().join(seen, keys, "left_anti"), "py-open")
        seen = seen.unionByName(open_)
    return done


def resolve(specs: DataFrame, sources: DataFrame, contents: DataFrame, files: DataFrame) -> DataFrame:
    """Links of Python specs. A name that is no module goes where the package re-exports it from."""
    asked = specs.where("lang = 'py'").select("repo", "dir", "spec").distinct()
    root_dirs, _ = stage(roots(files), "py-roots")
    named = F.regexp_extract("spec", r"\A(.*)\.([^.]*)\z", 1)
    heads = asked.select("repo", "dir", "spec", named.alias("head"), F.substring_index("spec", ".", -1).alias("name")).where(
        F.col("head").rlike(r"[^.]")
    )
    everything = asked.unionByName(heads.select("repo", "dir", F.col("head").alias("spec"))).distinct()
    modules, _ = stage(resolve_modules(everything, sources, root_dirs), "py-modules")
    unknown = heads.join(modules.select("repo", "dir", "spec"), ["repo", "dir", "spec"], "left_anti")
    at = unknown.join(
        modules.select("repo", "dir", F.col("spec").alias("head"), F.col("target").alias("pkg")), ["repo", "dir", "head"]
    )
    exports, _ = stage(reexports(contents, sources, root_dirs), "py-exports")
    chased = _chase(at.select("repo", "dir", "spec", "pkg", "name"), exports)
    return links(specs.where("lang = 'py'"), modules.unionByName(chased), ["dir", "spec"])
