"""The file tree: visibility, pruning, totals, summaries and statistics.

Input is ``files(repo, rel, size, mtime, ...)``. Folders are derived from the paths, so a
file decides alone whether it or a folder above it is hidden: no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, labels, paths, text


@dataclass(frozen=True)
class ScanOptions:
    """What a scan leaves out. ``vcs_aware`` repos carry their own ignore rules as a visible set."""

    show_hidden: bool = False
    no_ignore: bool = False
    vcs_aware: bool = False
    ignore: list[str] = field(default_factory=list)
    only: list[str] = field(default_factory=list)
    since: datetime | None = None

    def rules_around(self) -> tuple[list[globs.IgnoreRule], list[globs.IgnoreRule]]:
        """The rules that come before a repository's own, and those after."""
        patterns = [".git/"]
        if not self.no_ignore and not self.vcs_aware:
            patterns += labels.DEFAULT_IGNORES
        return globs.ignore_rules(patterns), globs.ignore_rules(self.ignore)

    def rules(self) -> list[globs.IgnoreRule]:
        before, after = self.rules_around()
        return before + after


def _hidden_entry(options: ScanOptions, rel: Column, is_dir: bool) -> Column:
    name = paths.base(rel)
    hidden = globs.matches(options.rules(), rel, name, is_dir)
    return hidden if options.show_hidden else hidden | name.startswith(".")


def mark_hidden(files: DataFrame, options: ScanOptions, visible: DataFrame | None = None) -> DataFrame:
    """Add ``hidden_at``: the topmost entry that hides a file (the walk never looks below it), or null.

    ``visible(repo, path)`` is the version-controlled set with parent folders.
    """
    rel = F.col("rel")
    # A walk stops at the first hidden folder, so a later "!" below it can't bring a file back.
    likely = rel.rlike(globs.touched(options.rules(), not options.show_hidden))
    folder = F.when(likely, F.get(F.filter(paths.ancestors(rel), lambda a: _hidden_entry(options, a, True)), 0))
    own = F.when(likely, _hidden_entry(options, rel, False)).otherwise(False)
    if options.only:
        own = own | ~globs.matches(globs.ignore_rules(options.only), rel, paths.base(rel), False)
    if options.since is not None:
        own = own | (F.col("mtime") < F.lit(options.since))
    at = F.coalesce(folder, F.when(own, rel))
    if visible is None:
        return files.withColumn("hidden_at", at)
    # The set is closed under parents: a file's first missing ancestor is where the walk stops.
    tops = (
        files.select("repo", "rel", F.posexplode(paths.prefixes(rel)).alias("lvl", "path"))
        .join(visible.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
        .groupBy("repo", "rel").agg(F.min_by("path", "lvl").alias("_unseen"))
    )
    both = files.withColumn("_rule", at).join(tops, ["repo", "rel"], "left")
    shorter = F.when(F.length("_unseen") < F.length("_rule"), F.col("_unseen")).otherwise(F.col("_rule"))
    return both.withColumn(
        "hidden_at", F.when(F.col("_rule").isNull() | F.col("_unseen").isNull(), F.coalesce("_rule", "_unseen")).otherwise(shorter)
    ).drop("_rule", "_unseen")


def visible_files(files: DataFrame, options: ScanOptions, visible: DataFrame | None = None) -> DataFrame:
    return mark_hidden(files, options, visible).where(F.col("hidden_at").isNull()).drop("hidden_at")


def skipped(marked: DataFrame) -> DataFrame:
    """Hidden entries per repo: a hidden folder counts once, not its contents."""
    return marked.groupBy("repo").agg(F.count_distinct("hidden_at").alias("skipped"))


def scan_summary(scanned: DataFrame, options: ScanOptions) -> DataFrame:
    """Per repo of a ``walk.scan``: files shown, entries skipped (hidden ones, links and pipes), and unreadable folders shown.

    A hidden folder counts once, and nothing below it counts.
    """
    rel = F.col("rel")
    folder = F.get(F.filter(paths.ancestors(rel), lambda a: _hidden_entry(options, a, True)), 0)
    own = F.when(F.col("is_dir"), _hidden_entry(options, rel, True)).otherwise(_hidden_entry(options, rel, False))
    at = F.coalesce(folder, F.when((rel != ".") & own, rel))
    seen = scanned.withColumn("hidden_at", at)
    shown = F.col("hidden_at").isNull()
    return seen.groupBy("repo").agg(
        F.count_if(shown & (F.col("kind") == "file")).alias("files"),
        (F.count_distinct("hidden_at") + F.count_if(shown & F.col("special"))).alias("skipped"),
        F.count_if(shown & F.col("err").isNotNull()).alias("unreadable"),
    )


def with_parents(tracked: DataFrame) -> DataFrame:
    """Tracked ``(repo, path)`` with every parent folder."""
    return tracked.select("repo", F.explode(paths.prefixes(F.rtrim(F.col("path"), F.lit("/")))).alias("path")).distinct()


def folders(files: DataFrame) -> DataFrame:
    """Every folder above a file, once."""
    leaf = files.select("repo", paths.parent(F.col("rel")).alias("dir")).distinct()
    return (
        leaf.where("dir <> '.'").select("repo", F.explode(paths.prefixes(F.col("dir"))).alias("rel")).distinct()
    )


def entries(files: DataFrame) -> DataFrame:
    """Files and their folders as one table; folders carry the totals of what is below."""
    totals = folder_totals(files)
    return (
        files.select("repo", "rel", F.lit(False).alias("is_dir"), "size", "mtime")
        .unionByName(totals.where("dir <> '.'").select("repo", F.col("dir").alias("rel"), F.lit(True).alias("is_dir"), "size", "mtime"))
        .withColumn("name", paths.base(F.col("rel")))
        .withColumn("dir", paths.parent(F.col("rel")))
    )


def rollup_folders(df: DataFrame, sums: list[str], maxes: list[str] = (), count: str | None = None) -> DataFrame:
    """Totals of ``df(repo, rel, ...)`` for every folder above, the root ``.`` included.

    Rows are first reduced per own folder, so only folder rows are repeated for their ancestors.
    """
    own = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxes]
    if count:
        own.append(F.count(F.lit(1)).alias(count))
    per_folder = df.groupBy("repo", paths.parent(F.col("rel")).alias("_own")).agg(*own)
    again = [F.sum(c).cast("long").alias(c) for c in [*sums, *([count] if count else [])]]
    return (
        per_folder.withColumn("dir", F.explode(paths.folders_up(F.col("_own"))))
        .groupBy("repo", "dir").agg(*again, *[F.max(c).alias(c) for c in maxes])
    )


def folder_totals(files: DataFrame) -> DataFrame:
    """Size of everything below each folder, its newest change, and its file count."""
    return rollup_folders(files, ["size"], ["mtime"], "files")


def diff_rollup(changes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Changed files and line counts per folder; folders below ``max_depth`` fold into it."""
    rows = rollup_folders(changes.withColumnRenamed("path", "rel"), ["added", "deleted"], count="changes")
    level = F.when(F.col("dir") == ".", 0).otherwise(paths.depth(F.col("dir")) + 1)
    if max_depth is None:
        return rows.withColumn("truncated", F.lit(False))
    return rows.where(level <= max_depth).withColumn("truncated", level == max_depth)


def change_counts(changes: DataFrame) -> DataFrame:
    """Number of changed paths below each folder, without the root."""
    rows = rollup_folders(changes.withColumnRenamed("path", "rel"), [], count="changes")
    return rows.where("dir <> '.'").select("repo", "dir", "changes")


def truncate_depth(all_entries: DataFrame, max_depth: int) -> DataFrame:
    """Entries down to ``max_depth`` levels; a folder at the limit is shown closed, totals unchanged."""
    level = paths.depth(F.col("rel")) + 1
    return all_entries.where(level <= max_depth).withColumn("truncated", F.col("is_dir") & (level == max_depth))


def insert_changes(
    all_entries: DataFrame, changes: DataFrame, options: ScanOptions | None = None, max_depth: int | None = None
) -> DataFrame:
    """Add status to entries, and the changed paths missing on disk with their missing parents.

    A missing path below a hidden entry, or below a folder closed by ``max_depth``, isn't added.
    """
    marks = changes.select("repo", F.col("path").alias("rel"), "status")
    below = changes.select("repo", F.col("path").alias("rel"))
    if options is not None:
        below = visible_files(below, options)
    tops = F.explode(paths.prefixes(F.col("rel")))
    implied = below.select("repo", tops.alias("path"), "rel").select(
        "repo", F.col("path").alias("rel"), (F.col("path") != F.col("rel")).alias("_dir")
    )
    implied = implied.groupBy("repo", "rel").agg(F.max("_dir").alias("_dir"))
    if max_depth is not None:
        implied = implied.where(paths.depth(F.col("rel")) + 1 <= max_depth)
    full = all_entries.join(implied, ["repo", "rel"], "full_outer").join(marks, ["repo", "rel"], "left")
    return (
        full.withColumn("missing", F.col("is_dir").isNull())
        .withColumn("is_dir", F.coalesce("is_dir", "_dir"))
        .withColumn("name", F.coalesce("name", paths.base(F.col("rel"))))
        .withColumn("dir", F.coalesce("dir", paths.parent(F.col("rel"))))
        .drop("_dir")
    )


def folder_summary(files: DataFrame) -> DataFrame:
    """``42 files, mostly .tsx`` per folder: the leading extension if more than half have it."""
    per_ext = files.groupBy("repo", paths.parent(F.col("rel")).alias("_own"), paths.ext(F.col("rel")).alias("ext")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spread = (
        per_ext.withColumn("dir", F.explode(paths.folders_up(F.col("_own"))))
        .groupBy("repo", "dir", "ext").agg(F.sum("n").alias("n"))
    )
    # Ties go to the smaller extension: the least (-n, ext) is the leader.
    leader = F.min(F.when(F.col("ext") != "", F.struct((-F.col("n")).alias("neg"), "ext")))
    best = spread.groupBy("repo", "dir").agg(F.sum("n").cast("long").alias("files"), leader.alias("best"))
    mostly = F.when(-2 * F.col("best.neg") > F.col("files"), F.concat(F.lit(", mostly "), F.col("best.ext")))
    return best.select(
        "repo", "dir", "files",
        F.concat(text.plural(F.col("files"), "file"), F.coalesce(mostly, F.lit(""))).alias("summary"),
    )


def corpus_stats(files: DataFrame) -> DataFrame:
    """Files, folders and bytes per repo."""
    dirs = folders(files).groupBy("repo").agg(F.count(F.lit(1)).alias("directories"))
    return (
        files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("total_size"))
        .join(dirs, "repo", "left")
        .select("repo", "files", F.coalesce("directories", F.lit(0)).cast("long").alias("directories"), "total_size")
    )


def languages(files: DataFrame) -> DataFrame:
    """Files per language label and repo; files without one are left out."""
    return (
        files.select("repo", labels.language(F.col("rel")).alias("language"))
        .where(F.col("language").isNotNull())
        .groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"))
    )


def language_shares(files: DataFrame, limit: int = 6) -> DataFrame:
    """Rounded percent of each known language among all known ones, the ``limit`` largest."""
    from .ranking import top

    known = languages(files).where(labels.is_known_language(F.col("language")))
    totals = known.groupBy("repo").agg(F.sum("files").alias("total"))
    half = F.floor(F.col("total") / 2)
    percent = F.floor((F.col("files") * 100 + half) / F.col("total")).cast("long")
    leaders = top(known, ["repo"], [F.col("files").desc(), F.col("language")], limit)
    return leaders.join(totals, "repo").select("repo", "rank", "language", "files", percent.alias("percent"))


def layout(files: DataFrame, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """The first top-level folders with their file counts, and how many were left out."""
    from .ranking import top

    tops = rollup_folders(files.select("repo", "rel"), [], count="files").where(
        ~F.col("dir").contains("/") & (F.col("dir") != ".") & ~F.col("dir").startswith(".")
    )
    omitted = tops.groupBy("repo").agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("omitted"))
    return top(tops, ["repo"], [F.col("dir")], limit), omitted


def ecosystems(files: DataFrame) -> DataFrame:
    """Known manifests at a repo's root with language and package manager, in fixed order."""
    order = {m: i for i, (m, _, _) in enumerate(labels.ECOSYSTEMS)}
    found = files.where(F.col("rel").isin(*order)).select("repo", F.col("rel").alias("manifest")).distinct()
    return found.select(
        "repo",
        F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("manifest")).alias("ord"),
        "manifest",
        labels.lookup(F.col("manifest"), {m: l for m, l, _ in labels.ECOSYSTEMS}).alias("language"),
        labels.lookup(F.col("manifest"), {m: p for m, _, p in labels.ECOSYSTEMS}).alias("package_manager"),
    )


def ecosystem_lines(found: DataFrame) -> DataFrame:
    """One row per language: its manifests, and its managers split at ``/`` without repeats."""
    listed = found.groupBy("repo", "language").agg(
        F.array_sort(F.collect_list(F.struct("ord", "manifest", "package_manager"))).alias("m")
    )
    managers = F.array_distinct(F.flatten(F.transform("m", lambda s: F.split(s["package_manager"], "/"))))
    return listed.select(
        "repo", "language", F.get(F.col("m"), 0)["ord"].alias("ord"),
        F.array_join(F.transform("m", lambda s: s["manifest"]), ", ").alias("manifests"),
        F.array_join(managers, "/").alias("managers"),
    )


def fingerprint(files: DataFrame) -> DataFrame:
    """One order-sensitive hash per repo over paths, sizes and times.

    Each file's hash is bound to its path, so summing 64-bit halves doesn't lose order and stays
    a partial aggregate: no repo's file list is collected.
    """
    row = F.sha2(F.concat_ws("|", "rel", F.col("size").cast("string"), F.coalesce(F.col("mtime").cast("string"), F.lit(""))), 256)
    half = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")
    return files.groupBy("repo").agg(
        F.sha2(
            F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(half(1)).cast("string"), F.sum(half(17)).cast("string"), F.sum(half(33)).cast("string")),
            256,
        ).alias("fingerprint")
    )
