"""The dependency graph as an edge table, and breadth-first reach over it.

``files(repo, id, rel, is_test)`` are the nodes, ``edges(repo, src, dst)`` say that ``src``
depends on ``dst``. Ids may be any type; extracted graphs use the path itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, paths
from ..storage import checkpoint, small, stage
from .ranking import number_rows

# A node with more neighbours than this is split into several join keys.
NEIGHBOURS_PER_KEY = 200_000


def distinct_edges(links: DataFrame) -> DataFrame:
    """Edges without self links and repeats."""
    return links.where(F.col("src") != F.col("dst")).select("repo", "src", "dst").distinct()


def used_by(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Per file, the files other than tests that depend on it."""
    sources = files.where(~F.col("is_test")).select("repo", F.col("id").alias("src"))
    return (
        edges.join(sources, ["repo", "src"], "left_semi")
        .groupBy("repo", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("used_by"))
    )


def used_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Files other than tests that something else uses, with the count."""
    return files.where(~F.col("is_test")).select("repo", "id", "rel").join(used_by(edges, files), ["repo", "id"])


def ranked(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Most used files first: ``rank`` per repo by users, then path."""
    return number_rows(used_files(edges, files), ["repo"], [F.col("used_by").desc(), F.col("rel").asc()])


def one_hop(edges: DataFrame, files: DataFrame, start: DataFrame, reverse: bool) -> DataFrame:
    """What each ``start(repo, id)`` depends on, or with ``reverse`` what depends on it."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    near = edges.join(start.select("repo", F.col("id").alias(here)), ["repo", here])
    names = files.select("repo", F.col("id").alias(there), "rel", "is_test")
    return near.select("repo", F.col(here).alias("start"), there).join(names, ["repo", there]).select(
        "repo", "start", F.col(there).alias("id"), "rel", "is_test"
    )


def fixture_links(files: DataFrame) -> DataFrame:
    """Tests a conftest.py serves, without importing it: those in its folder and below."""
    rel = F.col("rel")
    tests = files.where(rel.endswith(".py") & labels.is_runnable_test(rel, F.col("is_test"))).select(
        "repo", F.col("id").alias("src"), F.explode(paths.ancestors_up(rel)).alias("dir")
    )
    conftest = files.where(paths.base(rel) == "conftest.py").select(
        "repo", F.col("id").alias("dst"), paths.parent(rel).alias("dir")
    )
    return tests.join(conftest, ["repo", "dir"]).where("src <> dst").select("repo", "src", "dst")


def neighbours(edges: DataFrame, files: DataFrame, reverse: bool, fixtures: DataFrame | None = None, named: bool = True) -> DataFrame:
    """The edge table laid out for a traversal, written once.

    One row per (node, neighbour), with what a step needs of the neighbour, so no level joins
    the file table again; paths only if ``named``. A node with very many neighbours is spread over ``keys`` salted
    join keys; the neighbour's own number of keys comes along for the next level.
    """
    here, there = ("dst", "src") if reverse else ("src", "dst")
    links = edges.selectExpr("repo", f"{here} as node", f"{there} as next", "false as fixture")
    if reverse and fixtures is not None:
        links = links.unionByName(fixtures.selectExpr("repo", "dst as node", "src as next", "true as fixture"))
    # Only nodes over the bound are listed: at most edges / NEIGHBOURS_PER_KEY rows.
    split = (
        links.groupBy("repo", "node").agg(F.expr("count(1) as n")).where(f"n > {NEIGHBOURS_PER_KEY}")
        .selectExpr("repo", "node", f"cast(ceil(n / {NEIGHBOURS_PER_KEY}) as int) as keys")
    )
    about = files.selectExpr("repo", "id as next", *["rel as next_rel"][:named], "is_test as next_test").join(
        split.selectExpr("repo", "node as next", "keys as next_keys"), ["repo", "next"], "left"
    )
    laid_out = links.join(about, ["repo", "next"]).join(split, ["repo", "node"], "left").selectExpr(
        "repo", "node", "cast(pmod(xxhash64(next), coalesce(keys, 1)) as int) as key", "next", *["next_rel"][:named], "next_test",
        "coalesce(next_keys, 1) as next_keys", "fixture",
    )
    return stage(laid_out, "neighbours")[0]


def reach(
    edges: DataFrame,
    files: DataFrame,
    starts: DataFrame,
    *,
    reverse: bool = False,
    depth: int | None = None,
    no_tests: bool = False,
    parents: bool = False,
    fixtures: DataFrame | None = None,
) -> DataFrame:
    """Breadth-first reach from ``starts(repo, start, id)``, all starts at once.

    Returns ``(repo, start, id, rel, is_test, depth)``: each file once per start, at its shortest
    distance, seeds left out. With ``no_tests`` test files are neither reported nor followed.
    ``parents`` adds ``parent_id``, ``parent_rel`` (the earliest reached neighbour that led there)
    and ``via`` (the same, from the second hop on).

    Without parents a level is one row per file reached, however many starts reach it (:func:`_reach_sets`).
    With them it is one row per start and file, in one checkpointed step: frontier joined to neighbours, reduced
    to one row, minus what was seen. The measured size decides between broadcast and shuffle.
    """
    # Asked for at every level: where they come from a query, it would run again each time.
    starts, _ = stage(starts.select("repo", "start", "id"), "starts")
    links = neighbours(edges, files, reverse, fixtures, parents)
    if no_tests:
        links = links.where("not next_test")
    if not parents:
        return _reach_sets(links, files, starts, depth)
    frontier, size = checkpoint(_seeds(links, files, starts), ROW_BYTES)
    seen, seen_bytes = starts.select("repo", "start", "id"), size["bytes"]
    levels: list[DataFrame] = []
    while size["rows"] and (depth is None or len(levels) < depth):
        here = small(_positioned(frontier) if parents else frontier, size["bytes"])
        fresh = _next_level(here, links, parents).join(small(seen, seen_bytes), ["repo", "start", "id"], "left_anti")
        frontier, size = checkpoint(fresh, ROW_BYTES)
        if size["rows"]:
            levels.append(frontier.selectExpr("*", f"{len(levels) + 1} as depth"))
            seen = seen.unionByName(frontier.select("repo", "start", "id"))
            seen_bytes += size["bytes"]
    return _collect_levels(levels, files, starts, parents)


# A row of a level holds sets of starts, 64 to a number; more starts than fit into one row's numbers make further blocks.
SET_NUMBERS = 16


def _reach_sets(links: DataFrame, files: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """Reach with sets of starts: per node, a bit for every start of a block that has come there.

    A level's step sends each node's new bits along its links and ors them with the node's earlier ones in one
    aggregation, combined before its shuffle; no level is compared with all earlier ones. Starts become rows only in the result.
    """
    numbered = number_rows(starts.select("repo", "start").distinct(), ["repo"], [F.col("start")], "_n")
    numbered, seen = stage(numbered, "starts", most=F.max("_n"))
    n = max(1, min(SET_NUMBERS, -(-(seen["most"] or 0) // 64)))
    at = lambda name: [f"{name}{i}" for i in range(n)]
    here = numbered.selectExpr("repo", "start", f"cast((_n - 1) div {64 * n} as int) as block", f"cast((_n - 1) % {64 * n} as int) as bit")
    fan_out = links.join(starts.select("repo", F.col("id").alias("node")).distinct(), ["repo", "node"], "left_semi").groupBy("repo", "node").agg(
        F.expr("max(key) + 1 as keys"))
    seeds = starts.join(files.select("repo", "id"), ["repo", "id"]).join(here, ["repo", "start"]).withColumnRenamed("id", "node")
    mine = [f"bit_or(case when bit div 64 = {i} then shiftleft(1L, bit % 64) else 0L end) as f{i}" for i in range(n)]
    state = seeds.join(fan_out, ["repo", "node"]).groupBy("repo", "block", "node").agg(F.max("keys").alias("keys"), *[F.expr(e) for e in mine])
    state = state.selectExpr("repo", "block", "node", "keys", *[f"f{i} as s{i}" for i in range(n)], *at("f"))
    new = " or ".join(f"{f} <> 0" for f in at("f"))
    width = F.expr(f"cast(coalesce(sum(case when {new} then 100 + 16 * {n} else 0 end), 0) as bigint)")
    state, size = stage(state, "reach", bytes=width)
    levels: list[DataFrame] = []
    while size["bytes"] and (depth is None or len(levels) < depth):
        front = small(state.where(new).selectExpr("repo", "block", "node", "explode(sequence(0, keys - 1)) as key", *at("f")), size["bytes"])
        came = links.join(front, ["repo", "node", "key"]).selectExpr(
            "repo", "block", "next as node", "next_keys as keys", *[f"0L as s{i}" for i in range(n)], *at("f"))
        both = state.selectExpr("repo", "block", "node", "keys", *at("s"), *[f"0L as f{i}" for i in range(n)]).unionByName(came)
        ored = both.groupBy("repo", "block", "node").agg(F.max("keys").alias("keys"), *[F.expr(f"bit_or({c}) as {c}") for c in at("s") + at("f")])
        state, size = stage(ored.selectExpr(
            "repo", "block", "node", "keys", *[f"s{i} | f{i} as s{i}" for i in range(n)], *[f"f{i} & ~s{i} as f{i}" for i in range(n)]
        ), "reach", bytes=width)
        if size["bytes"]:
            levels.append(state.where(new).selectExpr("repo", "block", "node as id", *at("f"), f"{len(levels) + 1} as depth"))
    if not levels:
        return _collect_levels([], files, starts, False)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    # One row per block: the starts its bits stand for, at most 64 * SET_NUMBERS.
    names = here.groupBy("repo", "block").agg(F.expr("transform(array_sort(collect_list(struct(bit, start))), x -> x.start) as names"))
    rows = found.join(files.select("repo", "id", "rel", "is_test"), ["repo", "id"]).join(names, ["repo", "block"])
    words = rows.selectExpr("repo", "id", "rel", "is_test", "depth", "names", f"posexplode(array({', '.join(at('f'))})) as (word, bits)").where("bits <> 0")
    return words.selectExpr(
        "repo", "explode(transform(filter(sequence(0, 63), b -> shiftright(bits, b) & 1 = 1), b -> names[word * 64 + b])) as start",
        "id", "rel", "is_test", "depth",
    )


# Bytes of one frontier row for the broadcast check: its path twice, and the fixed columns.
ROW_BYTES = "2 * octet_length(rel) + 200"


def _seeds(links: DataFrame, files: DataFrame, starts: DataFrame) -> DataFrame:
    """The first frontier. A seed without neighbours reaches nothing and is left out."""
    fan_out = (
        links.withColumnRenamed("node", "id").join(starts.select("repo", "id").distinct(), ["repo", "id"], "left_semi")
        .groupBy("repo", "id").agg(F.expr("max(key) + 1 as keys"))
    )
    return (
        starts.join(files.select("repo", "id", "rel", "is_test"), ["repo", "id"]).join(fan_out, ["repo", "id"])
        .selectExpr(
            "repo", "start", "id", "rel", "is_test", "keys", "id as parent_id", "rel as parent_rel",
            "cast(0 as bigint) as parent_pos", "false as fixture", "rel as walk",
        )
    )


def _positioned(frontier: DataFrame) -> DataFrame:
    """Add ``pos``, the order in which a level was discovered."""
    # Ids that increase along a range-sorted table keep the order without one task per start.
    return frontier.orderBy("repo", "start", "parent_pos", "fixture", "walk").selectExpr(
        "*", "monotonically_increasing_id() as pos"
    )


def _next_level(here: DataFrame, links: DataFrame, parents: bool) -> DataFrame:
    """One row per start and file next to the frontier, with the earliest parent if asked."""
    pos = "pos" if parents else "cast(0 as bigint)"
    here = here.selectExpr(
        "repo", "start", "id as node", "rel as parent_rel", f"{pos} as parent_pos", "explode(sequence(0, keys - 1)) as key"
    )
    # next_rel, next_test and next_keys are equal in every row of a file.
    aggs = ["min(struct(next_rel, next_test, next_keys)) as about"]
    if parents:
        aggs.append("min(struct(parent_pos, fixture, node, parent_rel)) as best")
    grouped = (
        links.join(here, ["repo", "node", "key"]).withColumnRenamed("next", "id")
        .groupBy("repo", "start", "id").agg(*[F.expr(a) for a in aggs])
    )
    columns = ["repo", "start", "id", "about.next_rel as rel", "about.next_test as is_test", "about.next_keys as keys"]
    if parents:
        columns += [
            "best.node as parent_id", "best.parent_rel as parent_rel", "best.parent_pos as parent_pos",
            "best.fixture as fixture", "translate(about.next_rel, '/', '\u0001') as walk",
        ]
    return grouped.selectExpr(*columns)


def _collect_levels(levels: list[DataFrame], files: DataFrame, starts: DataFrame, parents: bool) -> DataFrame:
    columns = ["repo", "start", "id", "rel", "is_test", "depth"]
    if not levels:
        kinds = {**dict(files.dtypes), **dict(starts.dtypes)}
        schema = f"repo string, start {kinds['start']}, id {kinds['id']}, rel string, is_test boolean, depth int"
        if parents:
            schema += f", parent_id {kinds['id']}, parent_rel string, via string"
        return files.sparkSession.createDataFrame([], schema)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    if parents:
        return found.selectExpr(*columns, "parent_id", "parent_rel", "case when depth > 1 then parent_rel end as via")
    return found.select(*columns)


def hit_order() -> list[Column]:
    """Nearest first, code before tests, then by path."""
    return [F.col("depth"), F.col("is_test"), F.col("rel")]


def reading_order(files: DataFrame, edges: DataFrame, graph_files: DataFrame, limit: int = 15) -> DataFrame:
    """Where to start reading: README, up to ten entry points, then the most used files."""
    from ..functions.text import plural
    from .ranking import top

    rel = F.col("rel")
    row = lambda src, order, why: ["repo", "rel", F.lit(src).alias("source"), order.alias("ord"), why.alias("reason")]
    readme = files.withColumn("_r", labels.readme_rank(rel)).where("_r is not null")
    readme = top(readme, ["repo"], [F.col("_r"), rel], 1, "_n").select(*row(0, F.lit(1).cast("long"), F.lit("what the project is")))
    entry = top(
        files.where(labels.is_entry_point(rel)).withColumn("_k", paths.walk_key(rel)), ["repo"], [F.col("_k")], 10, "_n"
    ).select(*row(1, F.col("_n"), F.lit("entry point")))
    # At most `limit` used files can make the list; 11 of those may repeat an earlier source.
    used = top(used_files(edges, graph_files), ["repo"], [F.col("used_by").desc(), rel], limit + 11, "_n").select(
        *row(2, F.col("_n"), F.concat(F.lit("used by "), plural(F.col("used_by"), "file")))
    )
    first = F.min(F.struct("source", "ord", "reason")).alias("f")
    steps = readme.unionByName(entry).unionByName(used).groupBy("repo", "rel").agg(first)
    flat = steps.select("repo", "rel", "f.*")
    return top(flat, ["repo"], [F.col("source"), F.col("ord")], limit).select("repo", "rank", "rel", "reason")


def reason_text(names: DataFrame, keys: list[str], name: str, prefix: str) -> DataFrame:
    """Per ``keys``: the first three distinct names in order, and ``+N more``.

    The three are picked by a per-task limit, so an edge or file with very many names doesn't
    gather them in one place.
    """
    from .ranking import top

    one_each = names.select(*keys, name).distinct()
    totals = one_each.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    heads = top(one_each, keys, [F.col(name)], 3, "_n").groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias("head"))
    more = F.when(F.col("total") > 3, F.concat(F.lit(" +"), (F.col("total") - 3).cast("string"), F.lit(" more")))
    joined = F.concat(F.lit(prefix), F.array_join("head", ", "), F.coalesce(more, F.lit("")))
    return totals.join(heads, keys).select(*keys, joined.alias("reason"))
