"""Refreshing a corpus: only new and changed texts are extracted again.

A file that is only edited can't change how others' imports resolve, with an exception that makes its whole
repository be resolved anew: packages that re-export names. So do added and removed files and manifests.

In Go links follow from what the other files declare. There the kept facts serve as an index from names to the files that use
them, and only the users of names that came, went or moved are resolved again (:func:`update_go`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract.imports import import_specs
from ..functions import labels, paths
from ..extract import golang as go
from ..resolve import golang
from ..resolve.graph import spec_links
from ..sources.corpus import readable, selected
from ..storage import stage

# Files that decide how imports resolve.
MANIFESTS = ["package.json", "Cargo.toml", "pyproject.toml", "setup.py", "setup.cfg", "go.mod"]


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, rel, change): added, removed or modified between two snapshots (repo, rel, size, mtime)."""
    a = old.select("repo", "rel", F.struct("size", "mtime").alias("was"))
    b = new.select("repo", "rel", F.struct("size", "mtime").alias("now"))
    both = a.join(b, ["repo", "rel"], "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(
        F.col("was") != F.col("now"), "modified")
    return both.select("repo", "rel", kind.alias("change")).where("change is not null")


def repos_to_resolve(changed: DataFrame) -> DataFrame:
    """(repo): repositories where a change can move other files' links, Go aside."""
    name = paths.base(F.col("rel"))
    structural = F.col("change").isin("added", "removed") & selected(F.col("rel"), True) & ~name.endswith(".go")
    config = name.isin(*MANIFESTS) | name.endswith(".json")
    exporting = name == "__init__.py"
    return changed.where(structural | config | exporting).select("repo").distinct()


def update(
    specs: DataFrame, links: DataFrame, changed: DataFrame, contents: DataFrame, sources: DataFrame, files: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New (specs, links) of the languages with import specs, from the old ones and the ``changed`` files.

    ``contents``, ``sources`` and ``files`` describe the new snapshot. Texts of unchanged files are
    read only in repositories whose manifests or packages decide anew.
    """
    texts = readable(contents)
    touched = changed.select("repo", "rel")
    again = texts.join(changed.where("change <> 'removed'").select("repo", "rel"), ["repo", "rel"], "left_semi")
    own = again.join(sources.select("repo", "rel"), ["repo", "rel"], "left_semi")
    fresh, _ = stage(import_specs(own), "fresh-specs")
    kept = specs.join(touched.withColumnRenamed("rel", "src"), ["repo", "src"], "left_anti")
    new_specs, _ = stage(kept.unionByName(fresh), "specs")
    dirty, _ = stage(repos_to_resolve(changed), "dirty-repos")
    ask = new_specs.join(dirty, "repo", "left_semi").unionByName(fresh.join(dirty, "repo", "left_anti"))
    moved = spec_links(ask, sources, texts, files)
    still = links.join(dirty, "repo", "left_anti").join(touched.withColumnRenamed("rel", "src"), ["repo", "src"], "left_anti")
    return new_specs, stage(still.unionByName(moved), "links")[0]


def _moved_names(before: golang.GoTables, after: golang.GoTables, touched: DataFrame) -> DataFrame:
    """(repo, dir, name): names that a touched file declares in only one of the two snapshots, or in another package or kind of file."""
    def rows(t: golang.GoTables) -> DataFrame:
        place = t.files.join(touched.withColumnRenamed("rel", "src"), ["repo", "src"], "left_semi")
        plain = t.declares.select("repo", "src", "name", F.lit("").alias("recv"))
        every = plain.unionByName(t.methods.select("repo", "src", "name", "recv"))
        return every.join(place, ["repo", "src"]).select("repo", "dir", "pkg", "name", "recv", "src", "is_test")

    a, b = rows(before), rows(after)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("repo", "dir", "name", "recv").distinct()


def _users(t: golang.GoTables, moved: DataFrame, regrouped: DataFrame) -> DataFrame:
    """(repo, src): files whose links follow from ``moved(repo, dir, name, recv)``, or from the files of a ``regrouped(repo, dir)`` package."""
    here = t.files.select("repo", "src", "dir")
    names = moved.select("repo", "dir", "name").distinct()
    # First by name alone: only what says a moved name meets the files, not all that every file says.
    saying = lambda df, said, c="name": df.join(said.select("repo", F.col("name").alias(c)).distinct(), ["repo", c], "left_semi")
    inside = saying(t.uses, names).join(here, ["repo", "src"]).join(names, ["repo", "dir", "name"], "left_semi").select("repo", "src")
    # A type that moves takes its methods' links along.
    of_types = saying(t.methods, names, "recv").join(here, ["repo", "src"]).join(names.withColumnRenamed("name", "recv"), ["repo", "dir", "recv"], "left_semi")
    methods = moved.where("recv <> ''").select("repo", "dir", "name").unionByName(of_types.select("repo", "dir", "name")).distinct()
    calling = saying(t.called, methods).join(here, ["repo", "src"]).join(methods, ["repo", "dir", "name"], "left_semi").select("repo", "src")
    into = t.imports.where("to_dir is not null").select("repo", "src", F.col("to_dir").alias("dir")).distinct()
    picking = t.selectors.select("repo", "src", "name").distinct().join(names, ["repo", "name"]).join(into, ["repo", "src", "dir"], "left_semi").select("repo", "src")
    whole = into.join(regrouped, ["repo", "dir"], "left_semi").select("repo", "src")
    return inside.unionByName(calling).unionByName(picking).unionByName(whole).distinct()


def update_go(
    facts: DataFrame, edges: DataFrame, old_sources: DataFrame, changed: DataFrame, contents: DataFrame, sources: DataFrame,
    old_contents: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New (facts, edges) of Go, and the (repo, src) files resolved again, from the old ones and the ``changed`` files.

    Only texts of changed files are read; ``contents`` and ``sources`` describe the new snapshot, ``old_sources`` the old one. A changed go.mod moves
    import paths: all files of its repository are resolved again; ``old_contents`` then tells the old paths (else the new ones serve).
    """
    texts = readable(contents)
    touched = changed.where(F.col("rel").endswith(".go")).select("repo", "rel", "change")
    ask = touched.where("change <> 'removed'").select("repo", "rel").join(sources.select("repo", "rel"), ["repo", "rel"], "left_semi")
    fresh = go.file_facts(texts.join(ask, ["repo", "rel"], "left_semi"))
    new_facts, _ = stage(facts.join(touched.select("repo", "rel"), ["repo", "rel"], "left_anti").unionByName(fresh), "go-facts")
    modules = lambda df: df.where(paths.base(F.col("rel")) == "go.mod")
    before = golang.tables_of(facts, old_sources, modules(texts if old_contents is None else readable(old_contents)))
    after = golang.tables_of(new_facts, sources, modules(texts))
    moved, _ = stage(_moved_names(before, after, touched.select("repo", "rel")), "moved-names")
    # A package whose files or package clauses changed: who takes it whole, or by another name, follows its files.
    clause = lambda t: t.files.join(touched.select("repo", F.col("rel").alias("src")), ["repo", "src"], "left_semi").select("repo", "dir", "src", "pkg", "is_test")
    regrouped = clause(before).exceptAll(clause(after)).unionByName(clause(after).exceptAll(clause(before))).select("repo", "dir").distinct()
    dirty = changed.where(paths.base(F.col("rel")) == "go.mod").select("repo").distinct()
    again = _users(before, moved, regrouped).unionByName(_users(after, moved, regrouped)).unionByName(
        touched.select("repo", F.col("rel").alias("src"))).unionByName(after.files.join(dirty, "repo", "left_semi").select("repo", "src"))
    again, _ = stage(again.distinct(), "go-again")
    only = lambda df: df.join(again, ["repo", "src"], "left_semi")
    asking = golang.GoTables(after.files, after.facts, after.declares, after.methods, only(after.uses), only(after.called), only(after.imports), only(after.selectors))
    found = golang.edges(asking).join(again, ["repo", "src"], "left_semi").select("repo", "src", "dst").distinct()
    own = edges.where(F.col("src").endswith(".go")).join(again, ["repo", "src"], "left_anti").select("repo", "src", "dst")
    return new_facts, stage(own.unionByName(found), "edges")[0], again
