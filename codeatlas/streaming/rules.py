"""Architecture-rule violations among links as they arrive: each is reported once, however often its link comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.rules import ArchRule, broken_links

_ONE = ["repo", "line", "from", "to"]


def _broken(links: DataFrame, rules: list[ArchRule] | DataFrame) -> DataFrame:
    """Violations by one list for all repositories, or by each repository's own ``rules(repo, line, rule, from_regex, to_regex)``."""
    if not isinstance(rules, DataFrame):
        return broken_links(links, rules).select(*_ONE, "rule")
    own = rules.groupBy("repo").agg(F.collect_list(F.struct("line", "rule", "from_regex", "to_regex")).alias("_rules"))  # one file's lines
    hit = lambda r: F.regexp_like(F.col("from"), r["from_regex"]) & F.regexp_like(F.col("to"), r["to_regex"])
    met = links.where(~labels.is_test(F.col("from"))).join(own, "repo")
    return met.withColumn("_r", F.explode(F.filter("_rules", hit))).select("repo", "_r.line", "from", "to", "_r.rule")


def new_violations(links: DataFrame, rules: list[ArchRule] | DataFrame) -> DataFrame:
    """(repo, line, from, to, rule): violations among a stream of ``links(repo, from, to)`` that haven't been seen before.

    What has been reported is the stream's state, kept by key in its checkpoint: as many rows as there are violations. It grows
    with them and not with the links. A restart goes on where the last batch ended.
    """
    return _broken(links, rules).dropDuplicates(_ONE)


def violation_feed(links: DataFrame, rules: list[ArchRule] | DataFrame, out: str, checkpoint: str):
    """Append the new violations to Parquet files at ``out``; each batch is written exactly once."""
    return (
        new_violations(links, rules).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out)
    )
