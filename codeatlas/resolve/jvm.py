"""Java and Kotlin: an import is a path tail below any source root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from .common import links, suffix_index


def resolve(specs: DataFrame, sources: DataFrame) -> DataFrame:
    """Links of ``specs`` whose dotted name is the tail of a source path."""
    known = suffix_index(sources.where(labels.source_lang(F.col("rel")).isin("java", "kt")))
    named = specs.where(F.col("lang").isin("java", "kt")).withColumn("suffix", F.translate("spec", ".", "/"))
    return links(named, known.select("repo", "suffix", F.col("rel").alias("target")), ["suffix"])
