"""JavaScript and TypeScript: relative paths, config aliases, workspace packages, ``#`` imports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract.manifests import js_packages, ts_configs
from ..functions import paths
from ..storage import checkpoint, stage
from .common import links, longest_prefix, nearest

# A base is dear to work on and short: without this bound a few tasks would read them all.
SPECS_PER_FILE = 50_000

# The extensions tried, in order.
EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".d.ts"]


def probe_candidates(base: Column) -> Column:
    """The files a module path can mean: itself, with an extension, an index, or .ts written as .js."""
    tail = lambda s: F.concat(base, F.lit(s))
    ext = paths.ext(base)
    stem = paths.stem(base)
    rewritten = F.array(*[F.when(ext != "", F.concat(stem, F.lit(e))) for e in (".ts", ".tsx")],
                        F.when(ext == ".mjs", F.concat(stem, F.lit(".mts"))))
    return F.array_compact(F.concat(
        F.array(base, *[tail(e) for e in EXTS], *[tail("/index" + e) for e in EXTS]), rewritten
    ))


def _parents(configs_: DataFrame, named: DataFrame) -> DataFrame:
    """(repo, rel, i, up): the files each config names as parents, in order; ``named(repo, key, pkg_dir)`` are the packages."""
    with_json = lambda c: F.when(c.endswith(".json"), c).otherwise(F.concat(c, F.lit(".json")))
    asked = configs_.select("repo", "rel", F.posexplode("extends").alias("i", "ext"))
    relative = asked.where(F.col("ext").startswith(".")).select(
        "repo", "rel", "i", with_json(paths.join(paths.parent(F.col("rel")), F.col("ext"))).alias("up")
    )
    bare = asked.where(~F.col("ext").startswith("."))
    rest = F.substring(F.col("ext"), F.length("key") + 2, F.length("ext"))
    packaged = bare.join(longest_prefix(bare, "ext", named), ["repo", "ext"]).select(
        "repo", "rel", "i", F.when(rest == "", paths.join(F.col("pkg_dir"), F.lit("tsconfig.json"))).otherwise(
            with_json(paths.join(F.col("pkg_dir"), rest))).alias("up")
    )
    return relative.unionByName(packaged)


def configs(contents: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, at, base_url, base, paths): each folder's config with what it inherits.

    A config takes unset settings from the last parent it can read, and so on up the chain; every
    setting stays relative to the file that set it.
    """
    named = packages.where("name <> ''").groupBy("repo", F.col("name").alias("key")).agg(
        F.min_by("at", paths.walk_key(F.col("rel"))).alias("pkg_dir")
    )
    name = paths.base(F.col("rel"))
    wanted = contents.where(name.isin("tsconfig.json", "jsconfig.json")).select("repo", "rel")
    every, asked = None, None
    while True:  # only configs and what they inherit from are parsed, a generation at a time
        texts = contents.where(F.col("rel").endswith(".json")).join(wanted, ["repo", "rel"], "left_semi")
        found, size = stage(ts_configs(texts), "js-configs")
        every, asked = (found, _parents(found, named)) if every is None else (every.unionByName(found), asked.unionByName(_parents(found, named)))
        if not size["rows"]:
            break
        wanted = _parents(found, named).select("repo", F.col("up").alias("rel")).distinct().join(every.select("repo", "rel"), ["repo", "rel"], "left_anti")
    readable = every.select("repo", F.col("rel").alias("up"))
    parent = asked.join(readable, ["repo", "up"], "left_semi").groupBy("repo", "rel").agg(F.max_by("up", "i").alias("up"))
    own = every.select(
        "repo", F.col("rel").alias("at_file"),
        F.when(F.col("base_url").isNotNull(), paths.join(paths.parent(F.col("rel")), F.col("base_url"))).alias("base_url"),
        F.when(F.col("paths").isNotNull(), F.struct(paths.parent(F.col("rel")).alias("dir"), F.map_entries("paths").alias("entries"))).alias("paths"),
    )
    frontier, size = checkpoint(
        every.where(name.isin("tsconfig.json", "jsconfig.json")).select("repo", "rel", F.col("rel").alias("at_file"), F.array("rel").alias("trail")),
        "octet_length(rel)",
    )
    chain = None
    hop = 0
    while size["rows"]:
        here = frontier.select("repo", "rel", "at_file", F.lit(hop).alias("hop"))
        chain = here if chain is None else chain.unionByName(here)
        step = frontier.join(parent.select("repo", F.col("rel").alias("at_file"), "up"), ["repo", "at_file"]).where(
            ~F.array_contains("trail", F.col("up"))
        ).select("repo", "rel", F.col("up").alias("at_file"), F.concat("trail", F.array("up")).alias("trail"))
        frontier, size = checkpoint(step, "octet_length(rel)")
        hop += 1
    if chain is None:
        chain = frontier.select("repo", "rel", "at_file", F.lit(0).alias("hop"))
    settled = chain.join(own, ["repo", "at_file"]).groupBy("repo", "rel").agg(
        F.min_by("base_url", F.when(F.col("base_url").isNotNull(), F.col("hop"))).alias("base_url"),
        F.min_by("paths", F.when(F.col("paths").isNotNull(), F.col("hop"))).alias("paths"),
    )
    # A jsconfig.json only counts where there is no tsconfig.json.
    per_dir = settled.groupBy("repo", paths.parent(F.col("rel")).alias("at")).agg(
        F.max_by(F.struct("base_url", "paths"), F.col("rel").endswith("tsconfig.json")).alias("c")
    )
    star = F.locate("*", F.col("e.key"))
    entry = F.transform(F.col("c.paths.entries"), _pattern)
    return per_dir.select(
        "repo", "at", F.col("c.base_url").alias("base_url"), F.coalesce("c.base_url", "c.paths.dir").alias("base"),
        # the longest text before the star first
        F.array_sort(entry).alias("paths"),
    )


def _pattern(e: Column) -> Column:
    key = e["key"]
    wild = key.contains("*")
    pre = F.substring_index(key, "*", 1)
    return F.struct(
        (-F.length(pre)).alias("order"), key.alias("pattern"), pre.alias("pre"),
        F.when(wild, F.substring(key, F.length(pre) + 2, F.length(key))).alias("post"), e["value"].alias("targets"),
    )


def _matches(p: Column, text: Column) -> Column:
    """Whether a pattern with at most one star matches."""
    fixed = F.length(p["pre"]) + F.length(F.coalesce(p["post"], F.lit("")))
    return F.when(p["post"].isNull(), p["pattern"] == text).otherwise(
        F.startswith(text, p["pre"]) & F.endswith(text, p["post"]) & (F.length(text) >= fixed)
    )


def _star_text(p: Column, text: Column) -> Column:
    return F.when(p["post"].isNull(), F.lit("")).otherwise(
        F.substring(text, F.length(p["pre"]) + 1, F.length(text) - F.length(p["pre"]) - F.length(p["post"]))
    )


def _alias_bases(asked: DataFrame, config: DataFrame) -> DataFrame:
    """Paths a config's best-matching alias points to, then the path below baseUrl."""
    dirs = asked.select("repo", "dir").distinct()
    near = nearest(dirs, config, F.struct("base_url", "base", "paths"))
    rows = asked.join(near, ["repo", "dir"])
    best = F.get(F.filter("value.paths", lambda p: _matches(p, F.col("spec"))), 0)
    rows = rows.withColumn("best", best).withColumn("star", _star_text(F.col("best"), F.col("spec")))

    def put(t):
        cut = F.locate("*", t)
        head = F.substring_index(t, "*", 1)
        filled = F.when(t.contains("*"), F.concat(head, F.col("star"), F.substring(t, F.length(head) + 2, F.length(t)))).otherwise(t)
        return paths.join(F.col("value.base"), filled)

    aliased = rows.where("best is not null").select(
        "repo", "dir", "spec", F.lit(0).alias("o"), F.posexplode(F.transform("best.targets", put)).alias("i", "base")
    )
    below = rows.where("value.base_url is not null").select(
        "repo", "dir", "spec", F.lit(2).alias("o"), F.lit(0).alias("i"), paths.join(F.col("value.base_url"), F.col("spec")).alias("base")
    )
    return aliased.unionByName(below)


def _with_targets(df: DataFrame, mapping: str, sub: str) -> DataFrame:
    """Add ``targets``: what a map gives for a subpath, by its own key or the pattern with the longest prefix."""
    text = F.col(sub)
    key_pre = lambda t: F.substring_index(t["key"], "*", 1)
    wild = F.transform(
        F.filter(F.col(mapping), lambda t: t["key"].contains("*")),
        lambda t: F.struct(
            (-F.length(key_pre(t))).alias("order"), t["key"].alias("pattern"), key_pre(t).alias("pre"),
            F.substring(t["key"], F.length(key_pre(t)) + 2, F.length(t["key"])).alias("post"), t["targets"].alias("targets"),
        ),
    )
    df = df.withColumn("_exact", F.get(F.filter(mapping, lambda t: t["key"] == text), 0)["targets"])
    df = df.withColumn("_wild", F.get(F.array_sort(F.filter(wild, lambda p: _matches(p, text))), 0))
    df = df.withColumn("_star", F.when(F.col("_exact").isNull(), _star_text(F.col("_wild"), text)).otherwise(F.lit("")))
    raw = F.coalesce("_exact", "_wild.targets", F.array().cast("array<string>"))
    return df.withColumn("targets", F.transform(raw, lambda t: F.replace(t, F.lit("*"), F.col("_star")))).drop("_exact", "_wild", "_star")


def _package_bases(asked: DataFrame, packages: DataFrame) -> DataFrame:
    """Paths inside a package of the repository: through its exports, else its entries and index."""
    known = packages.where("name <> ''").groupBy("repo", F.col("name").alias("key")).agg(
        F.min_by(F.struct("at", "exports", "entry"), paths.walk_key(F.col("rel"))).alias("p")
    )
    rows = asked.join(longest_prefix(asked, "spec", known), ["repo", "spec"])
    sub = F.concat(F.lit("."), F.substring(F.col("spec"), F.length("key") + 1, F.length("spec")))
    rows = _with_targets(rows.withColumn("sub", sub), "p.exports", "sub")
    plain = F.when(F.col("sub") == ".", F.concat("p.entry", F.array(F.lit("index"), F.lit("src/index")))).otherwise(
        F.array(F.col("sub"), F.concat(F.lit("src/"), F.col("sub")))
    )
    rows = rows.withColumn("targets", F.when(F.col("p.exports").isNotNull(), F.col("targets")).otherwise(plain))
    return rows.select(
        "repo", "dir", "spec", F.lit(1).alias("o"),
        F.posexplode(F.transform("targets", lambda t: paths.join(F.col("p.at"), t))).alias("i", "base"),
    )


# Longest first, as nothing is tried twice.
_TOKEN = "(?:" + "|".join(re.escape(e) for e in sorted({"." + t for e in EXTS for t in e[1:].split(".")}, reverse=True)) + ")"
_CORE_END = rf"{_TOKEN}*+(?:/index{_TOKEN}*+)*+\z"


def _core(path: Column) -> Column:
    """A path without its trailing extensions of ``EXTS`` and index names: the same for a base and all it can mean but a rewritten one."""
    plain = ~paths.base(path).contains(".") & ~path.endswith("/index")  # nothing to cut: not searched
    return F.when(plain, path).otherwise(F.regexp_replace(path, _CORE_END, ""))


def _position(base: Column, rel: Column) -> Column:
    """Where ``rel`` is among :func:`probe_candidates` of ``base``, in their order; null if it isn't. No candidate is made."""
    tails = ["", *EXTS, *["/index" + e for e in EXTS]]
    fixed = F.array_position(F.array(*[F.lit(t) for t in tails]), F.substring(rel, F.length(base) + 1, F.length(rel)))
    ext, stem = paths.ext(base), paths.stem(base)
    swapped = F.when(rel == F.concat(stem, F.lit(".ts")), 1).when(rel == F.concat(stem, F.lit(".tsx")), 2).when(
        (ext == ".mjs") & (rel == F.concat(stem, F.lit(".mts"))), 3) + len(tails)
    return F.coalesce(F.when(rel.startswith(base) & (fixed > 0), fixed), F.when(ext != "", swapped))


def _first_base(bases: DataFrame, sources: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per ``keys``, the file of the first base that has one.

    A base and a source file meet once, by what both are without extension; no candidate is a row of its own.
    """
    base = F.col("base")
    asked = bases.select(*keys, *order, "base", F.explode(F.array_distinct(F.array(_core(base), _core(paths.stem(base))))).alias("core"))
    met = asked.join(sources.select("repo", "rel", _core(F.col("rel")).alias("core")), ["repo", "core"])
    return met.withColumn("_pos", _position(base, F.col("rel"))).where("_pos is not null").groupBy(*keys).agg(F.min_by("rel", F.struct(*order, "_pos")).alias("target"))


def resolve(specs: DataFrame, sources: DataFrame, contents: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Links of JavaScript and TypeScript specs. Corpora without configs or packages skip those joins.

    ``manifests`` may hold the package files of ``contents`` by themselves.
    """
    keys = ["repo", "dir", "spec"]
    asked, n = stage(
        specs.where("lang = 'js'").select(*keys).distinct(), "js-asked", SPECS_PER_FILE,
        hashed=F.expr("count_if(spec like '#%')"), bare=F.expr("count_if(spec not like '#%' and spec not like '.%')"),
    )
    bases = asked.where(F.col("spec").startswith(".")).select(
        *keys, F.lit(0).alias("o"), F.lit(0).alias("i"), paths.join(F.col("dir"), F.col("spec")).alias("base")
    )
    if not (n["hashed"] or n["bare"]):
        return links(specs.where("lang = 'js'"), _first_base(bases, sources, keys, ["o", "i"]), ["dir", "spec"])

    packages, p = stage(js_packages(contents if manifests is None else manifests), "js-packages")
    bare = asked.where(~F.col("spec").rlike(r"\A[.#]"))
    if n["hashed"] and p["rows"]:
        mapped = _hash_targets(asked.where(F.col("spec").startswith("#")), packages)
        outside = mapped.where(~F.col("to").rlike(r"\A(#|/|\.\./|\./)"))
        bare = bare.unionByName(outside.select("repo", "dir", F.col("to").alias("spec"))).distinct()
    bases = bases.unionByName(_alias_bases(bare, configs(contents, packages)))
    if p["rows"]:
        bases = bases.unionByName(_package_bases(bare, packages))
    found, _ = stage(_first_base(bases, sources, keys, ["o", "i"]), "js-direct")
    if n["hashed"] and p["rows"]:
        files_of = mapped.where(F.col("to").startswith("./")).select(*keys, "t", paths.join(F.col("at"), F.col("to")).alias("base"))
        inner = _first_base(files_of, sources, [*keys, "t"], ["t"]).unionByName(
            outside.join(found.select("repo", "dir", F.col("spec").alias("to"), "target"), ["repo", "dir", "to"]).select(*keys, "t", "target")
        )
        found = found.unionByName(inner.groupBy(*keys).agg(F.min_by("target", "t").alias("target")))
    return links(specs.where("lang = 'js'"), found, ["dir", "spec"])


def _hash_targets(hashed: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, dir, spec, at, t, to): what the nearest package.json maps a ``#name`` to, in order."""
    every = packages.groupBy("repo", "at").agg(F.min("imports").alias("imports"))
    owner = nearest(hashed.select("repo", "dir").distinct(), every, F.col("imports"))
    rows = _with_targets(hashed.join(owner, ["repo", "dir"]), "value", "spec")
    return stage(rows.select("repo", "dir", "spec", "at", F.posexplode("targets").alias("t", "to")), "js-hash")[0]
