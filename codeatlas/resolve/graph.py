"""The whole dependency graph of a corpus: every language's links as one edge table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract.imports import import_specs
from ..functions import paths
from ..operators.graph import distinct_edges
from ..operators.tree import ScanOptions, visible_files
from ..sources.corpus import readable, select_sources, selected
from ..storage import stage
from . import golang, javascript, jvm, python, rust


@dataclass(frozen=True)
class CodeGraph:
    """``files(repo, id, rel, is_test)``, ``edges(repo, src, dst)``, and the tables they came from."""

    files: DataFrame
    edges: DataFrame
    specs: DataFrame  # import specs of all languages but Go
    links: DataFrame  # (repo, src, ord, spec, target) of those specs
    go: golang.GoTables | None


def spec_links(
    specs: DataFrame, sources: DataFrame, contents: DataFrame, files: DataFrame, langs: set[str] = frozenset(("js", "py", "rs", "java", "kt")),
    manifests: DataFrame | None = None,
) -> DataFrame:
    """(repo, src, ord, spec, target) of every spec that names a source file; only ``langs`` are planned.

    ``manifests`` may hold the manifests of ``contents`` by themselves, so their kinds don't each read all texts.
    """
    manifests = contents if manifests is None else manifests
    found = specs.sparkSession.createDataFrame([], "repo string, src string, ord int, spec string, target string")
    if "js" in langs:
        found = found.unionByName(javascript.resolve(specs, sources, contents, manifests))
    if "py" in langs:
        found = found.unionByName(python.resolve(specs, sources, contents, files))
    if "rs" in langs:
        found = found.unionByName(rust.resolve(specs, sources, manifests))
    if langs & {"java", "kt"}:
        found = found.unionByName(jvm.resolve(specs, sources))
    return found


def build(
    contents: DataFrame, files: DataFrame | None = None, tests: bool = True, options: ScanOptions | None = None
) -> CodeGraph:
    """Extract and resolve ``contents(repo, rel, size, content)``; ``files`` may list more paths.

    What a scan with ``options`` hides (installed packages, build output, ignored files) is left out first.

    Languages the corpus doesn't hold are left out of the plan; the counts come with the writes.
    """
    options = options or ScanOptions()
    contents = visible_files(contents, options)
    alone = files is None
    files = contents.select("repo", "rel") if alone else visible_files(files, options)
    sources, n = stage(select_sources(files, tests), "sources", go=F.expr("count_if(rel like '%.go')"))
    texts = readable(contents)
    if alone:  # the texts are the files: a text says itself whether it is a source
        own = texts.where(selected(F.col("rel"), tests) & F.col("repo").isNotNull())
    else:
        own = texts.join(sources.select("repo", "rel"), ["repo", "rel"], "left_semi")
    specs, by_lang = stage(
        import_specs(own), "specs", **{k: F.expr(f"count_if(lang = '{k}')") for k in ("js", "py", "rs", "java", "kt")}
    )
    langs = {k for k, rows in by_lang.items() if rows and k != "rows"}
    manifests = texts
    if len(langs & {"js", "rs"}) + bool(n["go"]) > 1:  # several kinds are asked for: one pass over the texts takes them all out
        manifests, _ = stage(texts.where(paths.base(F.col("rel")).isin("go.mod", "package.json", "Cargo.toml")), "manifests")
    links, _ = stage(spec_links(specs, sources, texts, files, langs, manifests), "links")
    edges = links.select("repo", "src", F.col("target").alias("dst"))
    go = golang.tables(own, sources, manifests) if n["go"] else None
    if go is not None:
        edges = edges.unionByName(golang.edges(go).select("repo", "src", "dst"))
    return CodeGraph(sources, stage(distinct_edges(edges), "edges")[0], specs, links, go)


def all_symbols(contents: DataFrame, graph: CodeGraph | None = None) -> DataFrame:
    """(repo, rel, symbols): the declarations of every source file, exported Go ones first.

    A ``graph`` of the same contents lends its Go facts.
    """
    from ..extract import decls, golang as go

    texts = readable(contents)
    facts = graph.go.facts if graph is not None and graph.go is not None else go.file_facts(texts)
    return decls.symbols(texts).unionByName(go.signature_symbols(facts))


def declarations(graph: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """Go declarations (repo, dir, file, name) and references (repo, dir, file, name, ref), for impact."""
    from ..extract import golang as go

    decls = go.names(graph.go.facts).select(
        "repo", paths.parent(F.col("rel")).alias("dir"), F.col("rel").alias("file"),
        F.expr("case when recv is null then name else concat(recv, '.', name) end").alias("name"),
    ).distinct()
    return decls, stage(go.refs(graph.go.facts), "go-refs")[0]
