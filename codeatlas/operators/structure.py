"""A project's structure within a token budget, one line per folder.

Every folder starts collapsed to a summary. Folders open breadth-first while the text still fits; one
that doesn't fit stays closed without stopping cheaper ones, and samples, fixtures and vendored code
wait for what is left. What opening a folder adds is computed for all folders at once; only
the fit itself is sequential. It runs in rounds over the open folders' children, in order and at most ``AT_ONCE`` of a
repository at a time; in between, folders that can't fit any more are left out by all tasks, so a repository with any number of
folders on one level never comes into one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, paths
from ..storage import checkpoint, stage
from .ranking import top
from .tree import folder_summary, folders

# How many files a line names.
MAX_FILES, MAX_ROOT_FILES = 8, 40
# Folders of a repository that one task fits at a time.
AT_ONCE = 4096
TRUNCATED = "(more folders than the budget holds)\n"


def _file_lists(files: DataFrame) -> DataFrame:
    """(repo, dir, list, all_bytes): the first file names of a folder, dotfiles last, and ``+N more``."""
    f = files.select("repo", paths.parent(F.col("rel")).alias("dir"), paths.base(F.col("rel")).alias("name"))
    totals = f.groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("name") + 1).alias("all_bytes"))
    order = [F.col("name").startswith("."), F.col("name")]
    heads = top(f, ["repo", "dir"], order, MAX_ROOT_FILES, "_n").groupBy("repo", "dir").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda s: s["name"]).alias("names")
    )
    cap = F.when(F.col("dir") == ".", MAX_ROOT_FILES).otherwise(MAX_FILES)
    more = F.when(F.col("n") > cap, F.concat(F.lit(" +"), (F.col("n") - cap).cast("string"), F.lit(" more"))).otherwise("")
    return totals.join(heads, ["repo", "dir"]).select(
        "repo", "dir", "all_bytes", F.concat(F.array_join(F.slice("names", F.lit(1), cap), " "), more).alias("list")
    )


def _folder_lines(files: DataFrame) -> DataFrame:
    """(repo, rel, dir, depth, low, open_line, closed_line, full_bytes, delta) of every folder."""
    rel = F.col("rel")
    lists = _file_lists(files).select("repo", F.col("dir").alias("rel"), "list", "all_bytes")
    sums = folder_summary(files).select("repo", F.col("dir").alias("rel"), "summary")
    indent = F.expr("repeat('  ', depth)")
    d = folders(files).join(lists, ["repo", "rel"], "left").join(sums, ["repo", "rel"]).select(
        "repo", "rel", paths.parent(rel).alias("dir"), paths.depth(rel).alias("depth"), paths.base(rel).alias("name"), "list", "all_bytes", "summary"
    )
    d = d.select(
        "repo", "rel", "dir", "depth", F.col("name").isin(*labels.LOW_VALUE_DIRS).alias("low"),
        F.concat(indent, "name", F.lit("/"), F.coalesce(F.concat(F.lit(" "), "list"), F.lit(""))).alias("open_line"),
        F.concat(indent, "name", F.lit("/ ("), "summary", F.lit(")")).alias("closed_line"),
        (F.octet_length(F.concat(indent, "name")) + 2 + F.coalesce("all_bytes", F.lit(0))).alias("full_bytes"),
    )
    below = d.groupBy("repo", F.col("dir").alias("rel")).agg(F.sum(F.octet_length("closed_line") + 1).alias("below"))
    return d.join(below, ["repo", "rel"], "left").withColumn(
        "delta", F.octet_length("open_line") - F.octet_length("closed_line") + F.coalesce("below", F.lit(0))
    )


def _fit(batch: pd.DataFrame) -> pd.DataFrame:
    """Some folders of one repo, in order: open them while they fit."""
    batch = batch.sort_values(["round", "key"])
    used, room = int(batch["used"].iloc[0]), int(batch["room"].iloc[0])
    opened = []
    for delta in batch["delta"]:
        opened.append(used + delta <= room)
        used += delta if opened[-1] else 0
    return batch.assign(opened=opened, used=used)[["repo", "rel", "round", "key", "opened", "used"]]


def structure(files: DataFrame, budget: DataFrame) -> DataFrame:
    """(repo, text) for ``files(repo, rel)`` and ``budget(repo, tokens)``."""
    lines, _ = stage(_folder_lines(files), "folder-lines")
    lists = _file_lists(files).where("dir = '.'").select(
        "repo", F.concat(F.lit("./ "), "list").alias("root_line"), (F.col("all_bytes") + 3).alias("root_full")
    )
    top_cost = lines.where("dir = '.'").groupBy("repo").agg(F.sum(F.octet_length("closed_line") + 1).alias("top"))
    full = lines.groupBy("repo").agg(F.sum("full_bytes").alias("full"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    repos = budget.join(lists, "repo", "left").join(top_cost, "repo", "left").join(full, "repo", "left").select(
        "repo", (F.col("tokens") * 4).alias("room"), "root_line",
        (zero("top") + zero(F.octet_length("root_line") + 1)).alias("used"),
        (zero("full") + zero("root_full") <= F.col("tokens") * 4).alias("whole"),
    )
    repos, _ = stage(repos, "structure-repos")
    # Repos that fit whole are printed whole; their size is within the budget.
    whole = repos.where("whole").select("repo", "room")
    every_name = files.join(whole, "repo", "left_semi").select("repo", paths.parent(F.col("rel")).alias("dir"), paths.base(F.col("rel")).alias("name"))
    named = every_name.groupBy("repo", F.col("dir").alias("rel")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("name").startswith(".").alias("dot"), "name"))), lambda s: s["name"]).alias("names"))
    head = F.when(F.col("rel") == ".", "./").otherwise(F.concat(F.expr("repeat('  ', size(split(rel, '/')) - 1)"), paths.base(F.col("rel")), F.lit("/")))
    whole_dirs = lines.join(whole, "repo", "left_semi").select("repo", "rel").unionByName(named.where("rel = '.'").select("repo", "rel"))
    whole_lines = whole_dirs.join(named, ["repo", "rel"], "left").select(
        "repo", F.when(F.col("rel") == ".", "").otherwise(paths.walk_key(F.col("rel"))).alias("k"),
        F.concat(head, F.coalesce(F.concat(F.lit(" "), F.array_join("names", " ")), F.lit(""))).alias("line"),
    )
    opened = _rounds(lines, repos)
    shown = _shown_lines(lines, opened, repos)
    text = whole_lines.unionByName(shown).groupBy("repo").agg(F.expr(
        "concat(array_join(transform(array_sort(collect_list(struct(k, line))), s -> s.line), '\\n'), '\\n') as text"))
    over = (F.octet_length("text") > F.col("room")) & ~F.col("whole")
    return text.join(repos, "repo").select("repo", F.when(over, F.concat("text", F.lit(TRUNCATED))).otherwise(F.col("text")).alias("text"))


def _key() -> Column:
    """Sorts like the path's elements, with room for a lower separator between keys."""
    return F.translate("rel", "/", "\u0002")


def _rounds(lines: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, rel) of the folders that are opened.

    Folders are taken in the order they were found: by round, then by their parents' order, then name.
    """
    state = repos.where("not whole").select("repo", "used", "room")
    waiting = lines.where("dir = '.'").join(state.select("repo"), "repo", "left_semi").select(
        "repo", "rel", "delta", F.col("low").alias("late"), F.lit(0).alias("round"), _key().alias("key")
    )
    waiting, size = checkpoint(waiting, "octet_length(rel)")
    opened = None
    schema = "repo string, rel string, round int, key string, opened boolean, used bigint"
    turn = 0
    while size["rows"]:
        turn += 1
        # A repo takes its own code first; what waits for leftovers goes when nothing else is left.
        busy = waiting.where("not late").select("repo").distinct()
        now = waiting.where("not late").unionByName(waiting.join(busy, "repo", "left_anti"))
        children, todo = None, now
        while True:
            # What opening others could give back: some folders are shorter open than closed.
            slack = todo.groupBy("repo").agg(F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("slack"))
            able = todo.join(state, "repo").join(slack, "repo").where("delta <= room - used + slack").drop("slack")
            able, size = checkpoint(able, "octet_length(rel)")
            if not size["rows"]:
                break
            part, _ = checkpoint(top(able, ["repo"], [F.col("round"), F.col("key")], AT_ONCE, "_n").drop("_n"), "octet_length(rel)")
            fitted, _ = checkpoint(part.groupBy("repo").applyInPandas(_fit, schema), "octet_length(rel)")
            newly = fitted.where("opened").select("repo", "rel", F.concat(F.lpad(F.col("round").cast("string"), 9, "0"), "key").alias("key"))
            opened = newly if opened is None else opened.unionByName(newly)
            state, _ = checkpoint(state.join(fitted.groupBy("repo").agg(F.max("used").alias("_u")), "repo", "left").select(
                "repo", F.coalesce("_u", "used").alias("used"), "room"), "octet_length(repo)")
            found = lines.join(newly.select("repo", F.col("rel").alias("dir"), F.col("key").alias("_key")), ["repo", "dir"]).select(
                "repo", "rel", "delta", F.col("low").alias("late"), F.lit(turn).alias("round"),
                F.concat_ws("\u0001", "_key", _key()).alias("key"),
            )
            children = found if children is None else children.unionByName(found)
            todo = able.select(*now.columns).join(part.select("repo", "rel"), ["repo", "rel"], "left_anti")
        rest = waiting.join(now.select("repo", "rel"), ["repo", "rel"], "left_anti")
        waiting, size = checkpoint(rest if children is None else rest.unionByName(children), "octet_length(rel)")
    if opened is None:
        return waiting.select("repo", "rel")
    return opened.select("repo", "rel")


def _shown_lines(lines: DataFrame, opened: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, k, line): opened folders with files, their closed children, and the root's files."""
    parents = opened.select("repo", F.col("rel").alias("dir")).unionByName(
        repos.where("not whole").select("repo", F.lit(".").alias("dir")))
    marks = opened.withColumn("open", F.lit(True))
    rows = lines.join(parents, ["repo", "dir"], "left_semi").join(marks, ["repo", "rel"], "left").select(
        "repo", paths.walk_key(F.col("rel")).alias("k"), F.when(F.col("open"), F.col("open_line")).otherwise(F.col("closed_line")).alias("line")
    )
    root = repos.where("not whole and root_line is not null").select("repo", F.lit("").alias("k"), F.col("root_line").alias("line"))
    return rows.unionByName(root)
