"""Rust: modules below each crate root, workspace crates by name, and child modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract.manifests import crates
from ..functions import paths
from ..storage import stage
from .common import first_existing, links, nearest


def _with_roots(manifests: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, at, lib, roots): crate root files that exist, the library first; and a crate at the top."""
    base = manifests.select("repo", "at", "lib_path", "bins", F.lit(1).alias("real")).unionByName(
        sources.select("repo").distinct().select(
            "repo", F.lit(".").alias("at"), F.lit(None).cast("string").alias("lib_path"),
            F.array().cast("array<string>").alias("bins"), F.lit(0).alias("real"),
        )
    )
    base = base.groupBy("repo", "at").agg(F.max_by(F.struct("lib_path", "bins"), "real").alias("m")).select("repo", "at", "m.*")
    declared = F.coalesce("lib_path", F.lit("")) != ""
    tried = F.concat(
        F.array(F.coalesce(F.when(declared, F.col("lib_path")), F.lit("src/lib.rs"))), F.array(F.lit("src/main.rs")), "bins"
    )
    rows = base.select("repo", "at", declared.alias("declared"), F.posexplode(tried).alias("i", "p")).withColumn("rel", paths.join(F.col("at"), F.col("p")))
    alive = rows.join(sources.select("repo", "rel", F.lit(True).alias("ok")), ["repo", "rel"], "left").where("ok or (declared and i = 0)")
    return alive.groupBy("repo", "at").agg(
        F.max(F.when(F.col("i") == 0, F.col("rel"))).alias("lib"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", paths.parent(F.col("rel")).alias("dir"), F.col("rel").alias("file")))),
            lambda s: F.struct(s["dir"].alias("dir"), s["file"].alias("file")),
        ).alias("roots"),
    )


def modules(sources: DataFrame, manifests: DataFrame) -> DataFrame:
    """(repo, src, here, root_dir, root_file): each Rust file's module path under its crate root."""
    rel = F.col("rel")
    rs = sources.where(rel.endswith(".rs")).select("repo", "rel", paths.parent(rel).alias("dir"))
    owner = nearest(rs.select("repo", "dir").distinct(), _with_roots(manifests, sources), F.col("roots"))
    rows = rs.join(owner, ["repo", "dir"], "left").withColumn("roots", F.coalesce("value", F.array().cast("array<struct<dir:string,file:string>>")))
    is_root = F.get(F.filter("roots", lambda r: r["file"] == rel), 0)
    around = F.filter("roots", lambda r: F.startswith(rel, F.concat(r["dir"], F.lit("/"))))
    longest = F.array_max(F.transform(around, lambda r: F.length(r["dir"])))
    best = F.get(F.filter(around, lambda r: F.length(r["dir"]) == longest), 0)
    inside = F.substring(rel, F.length(best["dir"]) + 2, F.length(rel))
    own = is_root.isNull() & (best.isNull() | F.startswith(inside, F.lit("bin/")))
    here = F.split(F.regexp_replace(F.regexp_replace(inside, r"\.rs\z", ""), r"/mod\z", ""), "/")
    none = F.array().cast("array<string>")
    return rows.select(
        "repo", rel.alias("src"), "dir",
        F.when(is_root.isNotNull() | own, none).otherwise(here).alias("here"),
        F.when(is_root.isNotNull(), is_root["dir"]).when(own, F.col("dir")).otherwise(best["dir"]).alias("root_dir"),
        F.when(is_root.isNotNull(), is_root["file"]).when(own, rel).otherwise(best["file"]).alias("root_file"),
    )


def _module_files(root_dir: Column, root_file: Column, mod: Column) -> Column:
    """The files of ever shorter prefixes of a module path, and last the crate root."""
    under = lambda rest: F.when(root_dir == ".", rest).otherwise(F.concat(root_dir, F.lit("/"), rest))
    each = F.when(F.size(mod) > 0, F.flatten(F.transform(
        F.reverse(F.sequence(F.lit(1), F.size(mod))),
        lambda k: F.array(
            F.concat(under(F.array_join(F.slice(mod, F.lit(1), k), "/")), F.lit(".rs")),
            F.concat(under(F.array_join(F.slice(mod, F.lit(1), k), "/")), F.lit("/mod.rs")),
        ),
    ))).otherwise(F.array().cast("array<string>"))
    return F.concat(each, F.array(root_file))


def _child_files(name: Column) -> Column:
    """Where ``mod name;`` looks: beside a crate root or mod.rs, else in a folder named after the file."""
    beside = (F.size("here") == 0) | (paths.base(F.col("src")) == "mod.rs")
    folder = F.when(beside, F.col("dir")).otherwise(F.regexp_replace("src", r"\.rs\z", ""))
    at = F.when(folder == ".", name).otherwise(F.concat(folder, F.lit("/"), name))
    return F.array(F.concat(at, F.lit(".rs")), F.concat(at, F.lit("/mod.rs")))


def resolve(specs: DataFrame, sources: DataFrame, contents: DataFrame) -> DataFrame:
    """Links of Rust specs."""
    manifests, _ = stage(crates(contents), "rs-crates")
    where, _ = stage(modules(sources, manifests), "rs-modules")
    asked = specs.where("lang = 'rs'").select("repo", "src", "spec").distinct().join(where, ["repo", "src"])
    asked = asked.withColumn("segs", F.split("spec", "::")).withColumn("first", F.get("segs", F.lit(0)))
    key = ["repo", "src", "spec"]

    declared = asked.where(~F.col("spec").contains("::")).withColumn("cands", _child_files(F.col("spec")))
    paths_ = asked.where(F.col("spec").contains("::"))

    tail = F.slice("segs", F.lit(2), F.size("segs"))
    from_crate = paths_.where("first = 'crate'").withColumn("mod", tail)

    # Leading self steps stay; each super drops one more level of the file's own module.
    lead = F.size("segs") - F.size(F.aggregate(
        "segs", F.array().cast("array<string>"),
        lambda acc, s: F.when((F.size(acc) == 0) & s.isin("self", "super"), acc).otherwise(F.concat(acc, F.array(s))),
    ))
    ups = F.size(F.filter(F.slice("segs", F.lit(1), lead), lambda s: s == "super"))
    kept = F.slice("here", F.lit(1), F.greatest(F.size("here") - ups, F.lit(0)))
    from_self = paths_.where("first in ('self', 'super')").withColumn("mod", F.concat(kept, F.slice("segs", lead + 1, F.size("segs"))))

    with_lib = _with_roots(manifests, sources).where("lib is not null").select("repo", "at", "lib")
    named = manifests.join(with_lib, ["repo", "at"]).select(
        "repo", F.translate(F.coalesce(F.when(F.col("lib_name") != "", F.col("lib_name")), F.col("name")), "-", "_").alias("first"), "lib", "rel"
    ).groupBy("repo", "first").agg(F.max_by("lib", paths.walk_key(F.col("rel"))).alias("lib"))
    other = paths_.where("first not in ('crate', 'self', 'super')").join(named, ["repo", "first"], "left")
    from_crate_name = other.where("lib is not null").withColumn("root_file", F.col("lib")).withColumn(
        "root_dir", paths.parent(F.col("lib"))).withColumn("mod", tail)

    maybe_child = other.where("lib is null")
    child = first_existing(maybe_child.withColumn("cands", _child_files(F.col("first"))), key, sources).select(*key)
    from_child = maybe_child.join(child, key, "left_semi").withColumn("mod", F.concat("here", "segs"))

    module = ["repo", "root_dir", "root_file", "mod"]
    columns = [*key, *module[1:]]
    rooted = from_crate.select(*columns)
    for more in (from_self, from_crate_name, from_child):
        rooted = rooted.unionByName(more.select(*columns))
    # Many files name one module: its files are tried once.
    rooted, _ = stage(rooted, "rs-rooted")
    tried = rooted.select(*module).distinct().withColumn("cands", _module_files(F.col("root_dir"), F.col("root_file"), F.col("mod")))
    at = rooted.join(first_existing(tried, module, sources), module).select(*key, "target")
    found = first_existing(declared, key, sources).unionByName(at).groupBy(*key).agg(F.min("target").alias("target"))
    return links(specs.where("lang = 'rs'"), found, ["src", "spec"])
