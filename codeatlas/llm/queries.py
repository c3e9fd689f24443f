"""The operators of this package over the given tables, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, decontaminate, hilbert, langid, phrases, pii, quality, repeats, simhash, spelling, suffix_tree, toxicity, warc
from .common import remainder, table


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a model of the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model, base = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.flagged(toxicity.score(docs, model, base), model).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.PREDICT).cast("int").alias("predicted"), "threshold", "flagged",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality rules for every document."""
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of the languages that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that also start earlier."""
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and all spans of personal data for every document."""
    base = tuple(k.name for k in pii.KINDS if k.base)
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base],
        F.sha2(F.expr(pii.joined("pii", base)), 256).alias("base_sha256"), F.expr(pii.joined("pii")).alias("spans"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of a document that an item of the benchmark covers."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document along the curve."""
    return hilbert.shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and suffix-tree scores of every document."""
    return suffix_tree.learned_scores(table(spark, sf_dir, "documents")).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    out = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of ZIP-packaged archives, read back from them."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.read(warc.written(pages)).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its neighbours, its form and its root."""
    return spelling.variants(spelling.vocabulary(spelling.occurrences(table(spark, sf_dir, "documents"))))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best collocations."""
    return phrases.collocations(phrases.frequent(table(spark, sf_dir, "documents"))).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned documents with their token ids."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op10_byte_bpe": op10_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op5_language": op5_language,
    "op6_repeats": op6_repeats,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_suffix_tree": op9_suffix_tree,
    "op11_warc": op11_warc,
    "op12_spelling": op12_spelling,
    "op13_phrases": op13_phrases,
    "op4_quality_rules": op4_quality_rules,
    "op7_pii": op7_pii,
    "pipeline": pipeline,
}
