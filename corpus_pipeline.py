"""The cleaning pipeline over ``documents``: each stage's result is written and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm import bpe, decontaminate, pii, quality, simhash
from codeatlas.llm.common import table
from codeatlas.storage import scratch_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the document with the least id stays."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded, and replaced by what their ids decode to; ``ids`` and ``n_tokens`` are added, or replaced where they stood."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "ids", "n_tokens")}
    out = bpe.encoded(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], "text"))
    text = F.when(F.col("text").isNotNull(), F.decode("decoded", "UTF-8")).alias("text")
    kept = [text if c == "text" else F.col(own[c]).alias(c) for c in docs.columns if c not in ("ids", "n_tokens")]
    return out.select(*kept, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can't express the fingerprints' hash or the token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
