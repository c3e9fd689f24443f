"""Whole reports per repository or file, composed from the operators."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..extract import decls as decl_patterns
from ..extract import readme
from ..functions import labels, paths, text
from ..operators import churn as churn_ops
from ..operators import declarations, explain, impact, ranking, testplan, tree
from ..operators import graph as graph_ops
from ..operators.structure import structure
from ..resolve.graph import CodeGraph, declarations as go_declarations
from ..storage import stage


def related(
    graph: CodeGraph, starts: DataFrame, reverse: bool, depth: int | None = 1, no_tests: bool = False, reasons: DataFrame | None = None
) -> DataFrame:
    """What each of ``starts(repo, rel)`` depends on, or with ``reverse`` what depends on it, and why.

    (repo, start, rel, depth, via, reason, is_test).
    """
    seeds = starts.select("repo", F.col("rel").alias("start"), F.col("rel").alias("id"))
    fixtures = graph_ops.fixture_links(graph.files) if reverse else None
    hits = graph_ops.reach(
        graph.edges, graph.files, seeds, reverse=reverse, depth=depth, no_tests=no_tests, parents=True, fixtures=fixtures
    )
    reasons = explain.edge_reasons(graph) if reasons is None else reasons
    return explain.explain(hits, reasons, reverse).select(
        "repo", "start", "rel", "depth", "via", "reason", "is_test"
    )


def impact_report(graph: CodeGraph, contents: DataFrame, changes: DataFrame, depth: int | None = None) -> dict[str, DataFrame]:
    """Everything a change set of ``changes(repo, path, status)`` could affect, as named tables."""
    changed, deleted = impact.split_changes(changes)
    hits = impact.affected(graph.edges, graph.files, changed, depth, parents=True)
    tests = impact.tests_to_run(graph.files, changed, hits)
    out = {
        "changed": impact.seeds(changed, graph.files).select("repo", "rel"),
        "deleted": deleted,
        "not_in_graph": impact.not_in_graph(changed, graph.files),
        "affected": explain.explain(hits, explain.edge_reasons(graph), True).select("repo", "rel", "depth", "via", "reason", "is_test"),
        "tests": tests,
        "go_test_packages": impact.go_test_packages(tests),
        "test_commands": testplan.test_commands(tests, contents),
    }
    if graph.go is not None:
        decls, refs = go_declarations(graph)
        in_graph = out["changed"]
        run, whole = declarations.go_test_run(graph.edges, graph.files, decls, refs, in_graph, hits if depth is None else None)
        out["go_test_run"], out["go_run_whole"] = run, whole
    return out


def used_signatures(
    contents: DataFrame, symbols: DataFrame, links: DataFrame, names: DataFrame | None
) -> DataFrame:
    """(repo, src, dst, ord, symbol): declarations of ``dst`` that ``src`` uses, for ``links(repo, src, dst)``.

    Go names are exact; elsewhere a declaration counts when its name occurs in the text. The words of the texts are an index that is cut
    to declared names first; a link then meets only the words its own file says, and those the declarations of its
    target. ``names`` are the exact names along Go links, if the corpus has any.
    """
    pair = ["repo", "src", "dst"]
    each = symbols.select("repo", F.col("rel").alias("dst"), F.posexplode("symbols").alias("ord", "symbol"))
    each = each.withColumn("name", F.regexp_extract("symbol", decl_patterns.DECLARED_NAME, 1)).withColumn(
        "recv", F.nullif(F.regexp_extract("symbol", decl_patterns.GO_METHOD, 1), F.lit(""))).where("name <> ''")
    links = links.select(*pair).distinct()
    sources = links.select("repo", F.col("src").alias("rel")).distinct()
    words = contents.join(sources, ["repo", "rel"], "left_semi").select(
        "repo", F.col("rel").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)))).alias("name")
    ).join(each.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    said = links.join(words, ["repo", "src"]).join(each, ["repo", "dst", "name"])
    if names is None:
        return said.select(*pair, "ord", "symbol")
    said, _ = stage(said, "said")
    exact = names.join(links, pair, "left_semi").select(*pair, "name").distinct()
    loose = said.join(exact.select(*pair).distinct(), pair, "left_anti")
    named = exact.join(each, ["repo", "dst", "name"])
    # A method of a used type that the text calls.
    methods = said.where("recv is not null").join(exact.select(*pair, F.col("name").alias("recv")), [*pair, "recv"], "left_semi")
    columns = [*pair, "ord", "symbol"]
    return loose.select(columns).unionByName(named.select(columns)).unionByName(methods.select(columns)).distinct()


# The sections of a file's context, and the share of what is left each may spend.
SECTIONS = [("depends on (and what it uses from each)", 0.45), ("used by", 0.4), ("tests that reach it", 0.45), ("declares", 1.0)]


def _cost(s: str) -> int:
    return (len(s.encode()) + 3) // 4


def _section(title: str, lines: list, total: int, room: int) -> tuple[str, int]:
    """A section within ``room`` tokens, and what it costs."""
    text = [f"\n## {title}\n", *[f"{line}\n" for line in lines]]
    spent = list(accumulate(map(_cost, text)))
    if spent[0] + 8 > room:
        return f"\n## {title}: {total} (raise --budget)\n", 6
    fit = bisect_right(spent, room)
    if fit == len(text):
        return "".join(text), spent[-1]
    return "".join([*text[:fit], f"+{total - fit + 1} more\n"]), spent[fit - 1] + 3


def _render(head: str, budget: int, lists: list, totals: list) -> str:
    """The sections that have lines, each within its share of the tokens that earlier ones left."""
    parts, left = [head], budget - _cost(head)
    for (title, share), lines, total in zip(SECTIONS, lists, totals):
        if total:
            part, cost = _section(title, lines, total, int(left * share))
            parts.append(part)
            left -= cost
    return "".join(parts)


@pandas_udf(StringType())
def _fitted(head: pd.Series, budget: pd.Series, lists: pd.Series, totals: pd.Series) -> pd.Series:
    return pd.Series([_render(*row) for row in zip(head, budget, lists, totals)])


def context(graph: CodeGraph, contents: DataFrame, symbols: DataFrame, starts: DataFrame, budget: int = 1500) -> DataFrame:
    """(repo, rel, text) for each of ``starts(repo, rel)``: what it uses, who uses it, its tests, what it declares.

    A section is cut by its running cost, counted over range-sorted tasks: lines that begin beyond the budget can't be
    shown, so they are never gathered, and only their number is kept.
    """
    start = starts.select("repo", F.col("rel").alias("start"))
    names = None if graph.go is None else stage(explain.used_names(graph), "used-names")[0]
    reasons, _ = stage(explain.edge_reasons(graph, names), "reasons")
    deps, _ = stage(related(graph, starts, reverse=False, reasons=reasons), "deps")
    users, _ = stage(related(graph, starts, reverse=True, reasons=reasons).where("not is_test"), "users")
    symbols, _ = stage(symbols, "symbols")
    reach = graph_ops.reach(
        graph.edges, graph.files, start.withColumn("id", F.col("start")), reverse=True, fixtures=graph_ops.fixture_links(graph.files)
    )
    links = deps.select("repo", F.col("start").alias("src"), F.col("rel").alias("dst"))
    sigs, _ = stage(used_signatures(contents, symbols, links, names), "signatures")
    why = lambda: F.concat("rel", F.coalesce(F.concat(F.lit(" — "), "reason"), F.lit("")))
    lines = lambda df, sec, order, line: df.select("repo", "start", F.lit(sec).alias("sec"), F.struct(*order).cast(_ORDER).alias("o"), line.alias("line"))
    zero, low = F.lit(0).alias("b"), lambda c: F.col(c).cast("long")
    dep_lines = lines(deps, 0, [low("is_test").alias("a"), F.col("rel").alias("r"), zero], why())
    sig_rank = ranking.top(sigs, ["repo", "src", "dst"], [F.col("ord")], 4, "_n")
    total = sigs.groupBy("repo", "src", "dst").agg((F.count(F.lit(1)) - 4).alias("over"))
    is_test = graph.files.select("repo", F.col("rel").alias("dst"), low("is_test").alias("a"))
    sig_rows = sig_rank.selectExpr("repo", "src as start", "dst", "_n as b", "symbol").unionByName(
        total.where("over > 0").selectExpr("repo", "src as start", "dst", "5L as b", "concat('+', over, ' more') as symbol")
    ).join(is_test, ["repo", "dst"])
    sig_lines = lines(sig_rows, 0, [F.col("a"), F.col("dst").alias("r"), F.col("b")], F.concat(F.lit("  "), "symbol"))
    user_lines = lines(users, 1, [F.lit(0).alias("a"), F.col("rel").alias("r"), zero], why())
    tests = reach.where(labels.is_runnable_test(F.col("rel"), F.col("is_test")))
    go_dirs = tests.where(F.col("rel").endswith("_test.go")).select(
        "repo", "start", F.when(paths.parent(F.col("rel")) == ".", ".").otherwise(F.concat(F.lit("./"), paths.parent(F.col("rel")))).alias("p")).distinct()
    go_line = ranking.capped_names(go_dirs, ["repo", "start"], [F.col("p")], "p", 8).select(
        "repo", "start", F.lit(2).alias("sec"), F.struct(F.lit(-1).alias("a"), F.lit("").alias("r"), zero).cast(_ORDER).alias("o"),
        F.concat(F.lit("go test "), F.replace("items", F.lit(", "), F.lit(" "))).alias("line"))
    near = ranking.top(tests, ["repo", "start"], [F.col("depth"), F.col("rel")], 8, "_n")
    test_count = tests.groupBy("repo", "start").agg(F.count(F.lit(1)).alias("n"))
    test_lines = lines(near, 2, [F.lit(0).alias("a"), F.lit("").alias("r"), F.col("_n").alias("b")], F.col("rel"))
    more_tests = lines(test_count.where("n > 8"), 2, [F.lit(1).alias("a"), F.lit("").alias("r"), zero], F.concat(F.lit("+"), (F.col("n") - 8).cast("string"), F.lit(" more")))
    own = symbols.join(start.withColumn("rel", F.col("start")), ["repo", "rel"]).select("repo", "start", F.posexplode("symbols").alias("i", "symbol"))
    own_lines = lines(own, 3, [F.col("i").cast("long").alias("a"), F.lit("").alias("r"), zero], F.col("symbol"))
    every = dep_lines
    for more in (sig_lines, user_lines, go_line, test_lines, more_tests, own_lines):
        every = every.unionByName(more)
    every, _ = stage(every, "context-lines")
    cost = F.ceil((F.octet_length("line") + 1) / 4).cast("long")
    shown = ranking.running_total(every.withColumn("_c", cost), ["repo", "start", "sec"], [F.col("o"), F.col("line")], "_c", "_n").where(
        F.col("_n") - F.col("_c") <= budget)
    per = every.groupBy("repo", "start", "sec").agg(F.count(F.lit(1)).alias("total")).join(
        shown.groupBy("repo", "start", "sec").agg(F.expr("transform(array_sort(collect_list(struct(_n, line))), s -> s.line) as lines")), ["repo", "start", "sec"])
    files = per.groupBy("repo", "start").agg(F.map_from_entries(F.collect_list(F.struct("sec", F.struct("total", "lines").alias("v")))).alias("m"))
    counts = start
    for name, df in (("deps", deps), ("users", users), ("tests", tests), ("affected", reach.where("not is_test"))):
        counts = counts.join(df.groupBy("repo", "start").agg(F.count(F.lit(1)).alias(name)), ["repo", "start"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    through = F.when(n("affected") > n("users"), F.concat(n("affected").cast("string"), F.lit(" affected through them")))
    summary = F.concat_ws(
        " · ", text.plural(n("deps"), "dependency"), text.plural(n("users"), "direct user"), through,
        F.concat(text.plural(n("tests"), "test"), F.lit(" reach it")))
    head = F.concat(F.lit("# "), "start", F.lit("\n"), summary, F.lit("\n"))
    rows = counts.join(files, ["repo", "start"], "left").withColumn("head", head)
    at = lambda i, f: F.try_element_at("m", F.lit(i))[f]
    none = F.array().cast("array<string>")
    return rows.select(
        "repo", F.col("start").alias("rel"),
        _fitted("head", F.lit(budget), F.array(*[F.coalesce(at(i, "lines"), none) for i in range(4)]),
                F.array(*[F.coalesce(at(i, "total"), F.lit(0)) for i in range(4)])).alias("text"),
    )


_ORDER = "struct<a: bigint, r: string, b: bigint>"

# What a reader of a tour should know about it.
CAVEATS = [
    "File names decide what counts as an entry point, and dependencies are those the sources state: what runs may differ.",
    "Ranks cover Go, JavaScript, TypeScript, Python, Rust, Java and Kotlin sources, without tests, samples and vendored code.",
]


def tour(files: DataFrame, contents: DataFrame, edges: DataFrame, graph_files: DataFrame, limit: int = 8) -> DataFrame:
    """One row per repo: purpose, ecosystems, languages, layout and a reading plan.

    Lists are cut per task to ``limit`` before they are gathered; counts of what was left out stay.
    """
    stats = tree.corpus_stats(files)
    purpose = readme.purposes(contents).select("repo", F.struct("path", "text").alias("purpose"))
    eco = tree.ecosystems(files).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("ord", "manifest", "language", "package_manager"))).alias("e"))
    eco = eco.select("repo", F.transform("e", lambda s: F.struct(s["manifest"].alias("manifest"), s["language"].alias("language"), s["package_manager"].alias("packageManager"))).alias("projects"))
    langs = tree.languages(files).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("languages"))
    shown, omitted = tree.layout(files, limit)
    shown = shown.groupBy("repo").agg(F.expr("transform(array_sort(collect_list(struct(rank, dir, files))), s -> struct(s.dir as path, s.files as files)) as layout"))
    steps = graph_ops.reading_order(files, edges, graph_files, limit)
    plain = F.when(F.col("reason") == "entry point", "likely entry point (filename convention)").when(
        F.col("reason") == "what the project is", "project overview (README)").otherwise(F.col("reason"))
    steps = steps.withColumn("reason", plain).groupBy("repo").agg(
        F.expr("transform(array_sort(collect_list(struct(rank, rel, reason))), s -> struct(s.rel as path, s.reason as reason)) as readingOrder"))
    left = reading_candidates(files, edges, graph_files)
    out = stats
    for df in (purpose, eco, langs, shown, omitted.withColumnRenamed("omitted", "omittedLayout"), steps, left):
        out = out.join(df, "repo", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return out.select(
        "repo", "purpose", empty("projects", "array<struct<manifest:string,language:string,packageManager:string>>"), "languages",
        "files", "directories", empty("layout", "array<struct<path:string,files:bigint>>"),
        empty("readingOrder", "array<struct<path:string,reason:string>>"),
        F.coalesce("omittedLayout", F.lit(0)).cast("long").alias("omittedLayout"),
        F.greatest(F.coalesce("candidates", F.lit(0)) - limit, F.lit(0)).cast("long").alias("omittedReading"),
        F.array(*[F.lit(c) for c in CAVEATS]).alias("caveats"),
    )


def reading_candidates(files: DataFrame, edges: DataFrame, graph_files: DataFrame) -> DataFrame:
    """(repo, candidates): how many files the uncut reading order would hold."""
    rel = F.col("rel")
    readme_ = ranking.top(files.withColumn("_r", labels.readme_rank(rel)).where("_r is not null"), ["repo"], [F.col("_r"), rel], 1, "_n")
    entry = ranking.top(files.where(labels.is_entry_point(rel)), ["repo"], [paths.walk_key(rel)], 10, "_n")
    every = readme_.select("repo", "rel").unionByName(entry.select("repo", "rel")).unionByName(
        graph_ops.used_files(edges, graph_files).select("repo", "rel")).distinct()
    return every.groupBy("repo").agg(F.count(F.lit(1)).alias("candidates"))


def key_file_lines(edges: DataFrame, graph_files: DataFrame, symbols: DataFrame, budget: DataFrame) -> DataFrame:
    """(repo, text): the most used files with up to eight declarations each, within ``budget(repo, tokens)``."""
    header = "\n## key files (most used first)\n"
    sym = symbols.select("repo", "rel", F.slice("symbols", 1, 8).alias("s"), (F.size("symbols") - 8).alias("over"))
    more = F.when(F.col("over") > 0, F.concat(F.lit("; +"), F.col("over").cast("string"), F.lit(" more"))).otherwise("")
    rows = graph_ops.used_files(edges, graph_files).join(sym, ["repo", "rel"], "left").withColumn("line", F.concat(
        "rel", F.lit(" (used by "), F.col("used_by").cast("string"), F.lit(")"),
        F.when(F.size(F.coalesce("s", F.array().cast("array<string>"))) > 0, F.concat(F.lit(": "), F.array_join("s", "; "), more)).otherwise("")))
    rows = rows.withColumn("cost", text.tokens(F.concat("line", F.lit("\n"))))
    totals = ranking.running_total(rows, ["repo"], [F.col("used_by").desc(), F.col("rel")], "cost", "used")
    kept = totals.join(budget, "repo").where(F.col("used") + _cost(header) <= F.col("tokens"))
    return kept.groupBy("repo").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(used, line))), s -> s.line), '\\n') as body"
    )).select("repo", F.concat(F.lit(header), "body", F.lit("\n")).alias("text"))


def ai_map(
    files: DataFrame, contents: DataFrame, edges: DataFrame, graph_files: DataFrame, symbols: DataFrame,
    budget: int, touches: DataFrame | None = None,
) -> DataFrame:
    """(repo, text): what a project is, where things are and which files matter, within ``budget`` tokens."""
    rel = F.col("rel")
    none = F.lit("")
    line = lambda df, label, col: df.select("repo", F.concat(F.lit(label), col, F.lit("\n")).alias("t"))
    stats = tree.corpus_stats(files)
    eco = tree.ecosystems(files).groupBy("repo").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(ord, language, manifest))), s -> concat(s.language, ' (', s.manifest, ')')), ', ') as c"))
    langs = tree.language_shares(files).groupBy("repo").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(rank, language, percent))), s -> concat(s.language, ' ', s.percent, '%')), ', ') as c"))
    entry = ranking.capped_names(files.where(labels.is_entry_point(rel)), ["repo"], [paths.walk_key(rel)], "rel", 10)
    config = ranking.capped_names(files.where(labels.is_config(rel)), ["repo"], [paths.walk_key(rel)], "rel", 15)
    size = F.concat(text.plural(F.col("files"), "file"), F.lit(", "), text.plural(F.col("directories"), "directory"))
    parts = [
        line(readme.purposes(contents), "", F.col("text")), line(eco, "stack: ", F.col("c")), line(langs, "languages: ", F.col("c")),
        line(stats, "size: ", size),
    ]
    if touches is not None:
        hot = churn_ops.hottest(churn_ops.churn(touches), files).groupBy("repo").agg(F.expr(
            "array_join(transform(array_sort(collect_list(struct(rank, path, commits))), s -> concat(s.path, ' (', s.commits, ')')), ', ') as c"))
        parts.append(line(hot, "most changed (90d, commits): ", F.col("c")))
    parts += [line(entry, "entry points: ", F.col("items")), line(config, "config: ", F.col("items"))]
    out = stats.select("repo", F.concat(F.lit("# "), "repo", F.lit("\n")).alias("head"))
    for i, p in enumerate(parts):
        gap = F.lit("\n") if i == 0 else none  # a blank line after the description
        out = out.join(p.withColumnRenamed("t", "_t"), "repo", "left").select(
            "repo", F.concat("head", F.coalesce("_t", none), gap).alias("head"))
    out = out.withColumn("head", F.concat("head", F.lit("\n## structure\n"))).withColumn("left", budget - text.tokens(F.col("head")))
    ranked = graph_ops.used_files(edges, graph_files).select("repo").distinct().withColumn("has", F.lit(True))
    share = F.when(F.col("has"), F.floor(F.col("left") * 3 / 5)).otherwise(F.col("left"))
    out = out.join(ranked, "repo", "left")
    shape = structure(files, out.select("repo", share.cast("long").alias("tokens"))).withColumnRenamed("text", "shape")
    out = out.join(shape, "repo", "left").withColumn("shape", F.coalesce("shape", none))
    rest = out.select("repo", (F.col("left") - text.tokens(F.col("shape"))).alias("tokens"))
    keys = key_file_lines(edges, graph_files, symbols, rest).withColumnRenamed("text", "keys")
    return out.join(keys, "repo", "left").select("repo", F.concat("head", "shape", F.coalesce("keys", none)).alias("text"))


def hotspots(touches: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Churn of every path with level, bar and heat; only paths that still exist if ``files`` is given."""
    counts = churn_ops.churn(touches)
    if files is not None:
        alive = files.select("repo", F.explode(paths.prefixes(F.col("rel"))).alias("path")).distinct()
        counts = counts.join(alive, ["repo", "path"], "left_semi")
    return churn_ops.churn_levels(counts)


def diff_tree(changes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """A diff's footprint: changed files with their lines, and every folder's totals."""
    totals = tree.diff_rollup(changes, max_depth).where("dir <> '.'").selectExpr(
        "repo", "dir as rel", "true as is_dir", "cast(null as string) as status", "added", "deleted", "changes", "truncated")
    rows = changes.selectExpr("repo", "path as rel", "false as is_dir", "status", "added", "deleted", "cast(null as bigint) as changes", "false as truncated")
    if max_depth is not None:
        rows = rows.where(paths.depth(F.col("rel")) < max_depth)
    return rows.unionByName(totals)


def file_tree(
    files: DataFrame, options: tree.ScanOptions, *, changes: DataFrame | None = None, sort: str = "name", reverse: bool = False,
    dirs_first: bool = False, max_depth: int | None = None, max_files: int | None = None,
) -> DataFrame:
    """The visible tree with sizes, status and order: (repo, rel, is_dir, size, mtime, status, changes, pos, ...)."""
    entries = tree.entries(tree.visible_files(files, options))
    if max_depth is not None:
        entries = tree.truncate_depth(entries, max_depth)
    if changes is not None:
        counts = tree.change_counts(changes).withColumnRenamed("dir", "rel")
        entries = tree.insert_changes(entries, changes, options, max_depth).join(counts, ["repo", "rel"], "left")
    if max_files is not None:
        entries, more = ranking.cap_files(entries, ranking.sibling_keys(sort, reverse), max_files)
        entries = entries.join(more.withColumnRenamed("dir", "rel"), ["repo", "rel"], "left")
    return ranking.sibling_order(entries, sort, reverse, dirs_first)
