"""Architecture rules: edges that must not exist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, labels


@dataclass(frozen=True)
class ArchRule:
    line: int
    rule: str
    from_regex: str
    to_regex: str


def parse_rules(content: str) -> list[ArchRule]:
    """Read ``FROM -> TO`` lines. Blank and ``#`` lines are skipped; anything else must be a rule."""
    rules = []
    for n, raw in enumerate(content.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        left, arrow, right = (s.strip() for s in line.partition("->"))
        if not (left and arrow and right):
            raise ValueError(f"line {n}: {line!r} isn't of the form web/ -> db/")
        rules.append(ArchRule(n, f"{left} -> {right}", globs.rule_side_regex(left), globs.rule_side_regex(right)))
    if not rules:
        raise ValueError("no rule in the file; one looks like web/ -> db/")
    return rules


def _lines_matching(rules: list[ArchRule], side: str, rel: Column) -> Column:
    """The lines of the rules whose side matches a path: every rule checked in one pass."""
    found = F.array(*[F.when(rel.rlike(getattr(r, side)), F.lit(r.line)) for r in rules])
    return F.array_compact(found)


def violations(
    edges: DataFrame, files: DataFrame, rules: list[ArchRule], changed: DataFrame | None = None
) -> DataFrame:
    """Edges from a file other than a test to a file a rule forbids: ``(repo, line, rule, from, to)``.

    Each file is matched against all rules once; edges then meet the two short rule lists by
    equi-joins, so there is no edges-times-rules product. ``changed(repo, rel)`` limits the left side.
    """
    sources = files.where(~F.col("is_test"))
    if changed is not None:
        sources = sources.join(changed.select("repo", "rel").distinct(), ["repo", "rel"], "left_semi")
    left = sources.select(
        "repo", F.col("id").alias("src"), F.col("rel").alias("from"), _lines_matching(rules, "from_regex", F.col("rel")).alias("_l")
    ).where(F.size("_l") > 0)
    right = files.select(
        "repo", F.col("id").alias("dst"), F.col("rel").alias("to"), _lines_matching(rules, "to_regex", F.col("rel")).alias("_r")
    ).where(F.size("_r") > 0)
    both = edges.join(left, ["repo", "src"]).join(right, ["repo", "dst"])
    hits = both.withColumn("line", F.explode(F.array_intersect("_l", "_r")))
    text = F.create_map(*[F.lit(x) for r in rules for x in (r.line, r.rule)])
    return hits.select("repo", "line", F.element_at(text, F.col("line")).alias("rule"), "from", "to")


def broken_links(links: DataFrame, rules: list[ArchRule]) -> DataFrame:
    """Violations among ``links(repo, from, to)``, decided row by row: also on a stream of new links."""
    both = F.array_intersect(_lines_matching(rules, "from_regex", F.col("from")), _lines_matching(rules, "to_regex", F.col("to")))
    text = F.create_map(*[F.lit(x) for r in rules for x in (r.line, r.rule)])
    hits = links.where(~labels.is_test(F.col("from"))).withColumn("line", F.explode(both))
    return hits.withColumn("rule", F.element_at(text, F.col("line")))


def unmatched_rules(files: DataFrame, rules: list[ArchRule]) -> DataFrame:
    """Rules that match no file on at least one side, per repo."""
    seen = [F.max(F.col("rel").rlike(getattr(r, s))).alias(f"{s}_{r.line}") for r in rules for s in ("from_regex", "to_regex")]
    flags = files.groupBy("repo").agg(*seen)
    missing = F.array(*[
        F.when(~(F.col(f"from_regex_{r.line}") & F.col(f"to_regex_{r.line}")), F.struct(F.lit(r.line).alias("line"), F.lit(r.rule).alias("rule")))
        for r in rules
    ])
    return flags.select("repo", F.explode(F.array_compact(missing)).alias("r")).select("repo", "r.*")


def rule_report(
    edges: DataFrame, files: DataFrame, rules: list[ArchRule], changed: DataFrame | None = None
) -> DataFrame:
    """One row per rule and repo: violations, whether both sides match a file, and files checked."""
    checked = files.where(~F.col("is_test"))
    if changed is not None:
        checked = checked.join(changed.select("repo", "rel").distinct(), ["repo", "rel"], "left_semi")
    # Every repo is reported, also one with no file in scope.
    scope = files.select("repo").distinct().join(
        checked.groupBy("repo").agg(F.count(F.lit(1)).alias("checked")), "repo", "left"
    )
    every = scope.select(
        "repo", F.coalesce("checked", F.lit(0)).cast("long").alias("checked"),
        F.explode(F.array(*[F.struct(F.lit(r.line).alias("line"), F.lit(r.rule).alias("rule")) for r in rules])).alias("r"),
    ).select("repo", "checked", "r.*")
    counts = violations(edges, files, rules, changed).groupBy("repo", "line").agg(F.count(F.lit(1)).alias("violations"))
    missing = unmatched_rules(files, rules).select("repo", "line", F.lit(True).alias("unmatched"))
    return (
        every.join(counts, ["repo", "line"], "left").join(missing, ["repo", "line"], "left")
        .select(
            "repo", "line", "rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
            F.coalesce("unmatched", F.lit(False)).alias("unmatched"), "checked",
        )
    )
