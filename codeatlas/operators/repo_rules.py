"""Rules that the repositories themselves carry: ignore files and architecture rules, as tables keyed by repo.

A repository's rules meet that repository's files only. One row per repo holds its rules, in order; ignore
rules are matched once per distinct folder, not per file, and rule sides once per file. No list passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, paths
from ..storage import stage
from .tree import ScanOptions

IGNORE_FILE, RULES_FILE = ".atlasignore", "atlas.rules"


def _lines(contents: DataFrame, name: str) -> DataFrame:
    """(repo, line, text) of the file ``name`` at each repository's root."""
    rows = contents.where(F.col("rel") == name).select("repo", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line") + 1)


# ---- ignore files ---------------------------------------------------------------------------


def ignore_rows(contents: DataFrame, name: str = IGNORE_FILE) -> DataFrame:
    """(repo, rules): the ordered ignore rules of each repository that has such a file."""
    rules = _lines(contents, name).withColumn("rule", globs.ignore_rule_of(F.col("text"))).where("rule is not null")
    ordered = F.array_sort(F.collect_list(F.struct("line", "rule")))  # one file's lines
    return rules.groupBy("repo").agg(F.transform(ordered, lambda r: r["rule"]).alias("rules"))


def _hidden(options: ScanOptions, rules: Column, rel: Column, is_dir: bool) -> Column:
    """Built-in patterns, then the repository's, then the user's: the last match decides."""
    before, after = options.rules_around()
    name = paths.base(rel)
    decision = globs.matches_rows(rules, rel, name, is_dir, globs.matches(before, rel, name, is_dir))
    decision = globs.matches(after, rel, name, is_dir, decision)
    return decision if options.show_hidden else decision | name.startswith(".")


def mark_hidden(files: DataFrame, rules: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Add ``hidden_at`` like ``tree.mark_hidden``, with each repository's own ``rules(repo, rules)`` as well."""
    options = options or ScanOptions()
    rules = rules.limit(0) if options.no_ignore else rules
    rel = F.col("rel")
    at_home = files.withColumn("_dir", paths.parent(rel))
    folders = at_home.select("repo", "_dir").distinct().join(rules, "repo", "left")
    above = F.when(F.col("_dir") == ".", F.array().cast("array<string>")).otherwise(paths.prefixes(F.col("_dir")))
    hidden = F.get(F.filter(above, lambda a: _hidden(options, F.col("rules"), a, True)), 0)
    # One row per folder that holds files: whether it is hidden, and the rules its files meet.
    folders, _ = stage(folders.select("repo", "_dir", hidden.alias("_at"), "rules"), "folder-rules")
    own = _hidden(options, F.col("rules"), rel, False)
    if options.only:
        own = own | ~globs.matches(globs.ignore_rules(options.only), rel, paths.base(rel), False)
    if options.since is not None:
        own = own | (F.col("mtime") < F.lit(options.since))
    return at_home.join(folders, ["repo", "_dir"]).withColumn("hidden_at", F.coalesce("_at", F.when(own, rel))).select(*files.columns, "hidden_at")


def visible_files(files: DataFrame, rules: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    return mark_hidden(files, rules, options).where("hidden_at is null").drop("hidden_at")


# ---- architecture rules ---------------------------------------------------------------------


def arch_rules(contents: DataFrame, name: str = RULES_FILE) -> DataFrame:
    """(repo, line, rule, from_regex, to_regex) of the ``FROM -> TO`` lines of each repository's rules file, written.

    Blank and ``#`` lines are skipped. A line that is no rule, or a file without one, is an error that names its place.
    """
    text = F.trim(F.regexp_replace("text", r"\s", " "))
    rows = _lines(contents, name).withColumn("text", text)
    real = (F.col("text") != "") & ~F.col("text").startswith("#")
    left, right = F.trim(F.substring_index("text", "->", 1)), F.trim(F.regexp_replace("text", r"\A(?s:.*?)->", ""))
    good = F.col("text").contains("->") & (left != "") & (right != "")
    parsed = rows.where(real).select(
        "repo", "line", "text", good.alias("good"), F.concat_ws(" -> ", left, right).alias("rule"),
        globs.rule_side_regex_of(left).alias("from_regex"), globs.rule_side_regex_of(right).alias("to_regex"),
    )
    parsed, seen = stage(parsed, "arch-rules", bad=F.count_if(~F.col("good")))
    if seen["bad"]:
        at = parsed.where(~F.col("good")).orderBy("repo", "line").first()
        raise ValueError(f"{at.repo}/{name}, line {at.line}: {at.text!r} isn't of the form web/ -> db/")
    empty = contents.where(F.col("rel") == name).select("repo").join(parsed, "repo", "left_anti").orderBy("repo").first()
    if empty is not None:
        raise ValueError(f"{empty.repo}/{name} holds no rule; one looks like web/ -> db/")
    return parsed.drop("text", "good")


def _sides(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files of repositories with rules, and the lines of the rules whose left (``_l``) and right (``_r``) side each matches."""
    by_repo = rules.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("line", "from_regex", "to_regex"))).alias("_rules"))  # one file's lines
    lines = lambda side: F.transform(F.filter("_rules", lambda r: F.regexp_like(F.col("rel"), r[side])), lambda r: r["line"])
    return files.join(by_repo, "repo").withColumn("_l", lines("from_regex")).withColumn("_r", lines("to_regex")).drop("_rules")


def violations(edges: DataFrame, files: DataFrame, rules: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(repo, line, rule, from, to): like ``rules.violations``, by each repository's own rules."""
    sides, _ = stage(_sides(files.select("repo", "id", "rel", "is_test"), rules), "rule-sides")
    left = sides.where("not is_test and size(_l) > 0")
    if changed is not None:
        left = left.join(changed.select("repo", "rel").distinct(), ["repo", "rel"], "left_semi")
    left = left.select("repo", F.col("id").alias("src"), F.col("rel").alias("from"), "_l")
    right = sides.where("size(_r) > 0").select("repo", F.col("id").alias("dst"), F.col("rel").alias("to"), "_r")
    hits = edges.join(left, ["repo", "src"]).join(right, ["repo", "dst"]).withColumn("line", F.explode(F.array_intersect("_l", "_r")))
    return hits.join(rules.select("repo", "line", "rule"), ["repo", "line"]).select("repo", "line", "rule", "from", "to")


def unmatched(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, line, rule) of rules that match no file on at least one side."""
    sides = _sides(files.select("repo", "rel"), rules)
    seen = sides.select("repo", F.explode(F.concat(
        F.transform("_l", lambda n: F.struct(n.alias("line"), F.lit(1).alias("side"))), F.transform("_r", lambda n: F.struct(n.alias("line"), F.lit(2).alias("side")))
    )).alias("s")).select("repo", "s.*").distinct().groupBy("repo", "line").agg(F.count(F.lit(1)).alias("sides"))
    return rules.join(seen, ["repo", "line"], "left").where("coalesce(sides, 0) < 2").select("repo", "line", "rule")


def report(edges: DataFrame, files: DataFrame, rules: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(repo, line, rule, violations, unmatched, checked): like ``rules.rule_report``, by each repository's own rules."""
    scope = files.where("not is_test")
    if changed is not None:
        scope = scope.join(changed.select("repo", "rel").distinct(), ["repo", "rel"], "left_semi")
    checked = scope.groupBy("repo").agg(F.count(F.lit(1)).alias("checked"))
    counts = violations(edges, files, rules, changed).groupBy("repo", "line").agg(F.count(F.lit(1)).alias("violations"))
    missing = unmatched(files, rules).select("repo", "line", F.lit(True).alias("unmatched"))
    return rules.join(counts, ["repo", "line"], "left").join(missing, ["repo", "line"], "left").join(checked, "repo", "left").select(
        "repo", "line", "rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
        F.coalesce("unmatched", F.lit(False)).alias("unmatched"), F.coalesce("checked", F.lit(0)).cast("long").alias("checked"),
    )
