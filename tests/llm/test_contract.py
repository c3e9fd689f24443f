"""The bound queries over small whole tables: columns, types and digests."""

import hashlib

import public_tokenizers
import numpy as np
import pytest
import tiktoken

from codeatlas.llm import bpe
from codeatlas.llm.queries import QUERIES

from .test_documents import SCHEMA, plain_classes, plain_fingerprint, plain_kept, prose, texts_of

COLUMNS = {
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_hilbert_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_suffix_tree": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op10_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(k, prose(k % 9, 40 + k % 9), "en" if k % 2 else "fr", "s", 1) for k in range(40)] + [(50, None, None, None, None), (51, "", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(k, 1, k % 3 // 2) for k in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(1, prose(3, 43))], "item_id bigint, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, tables, name):
    out = QUERIES[name](spark, tables)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c, _ in (x.split() for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == [*range(40), 50, 51]


def test_digests(spark, tables):
    docs = texts_of(spark.read.parquet(f"{tables}/documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_repeats"](spark, tables).collect()}
    assert got == {(d, n, n - len(left), k, sha(left)) for d, n, k, left in plain_kept(docs)}
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, tables).collect())
    assert got == sorted((d, f"{f:016x}", c) for d, f, c in plain_classes([(d, plain_fingerprint(t)) for d, t in docs]))
    ranks = bpe.ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {d: np.array(library.encode_ordinary(t), "<u4") for d, t in docs}
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_byte_bpe"](spark, tables).collect()}
    assert got == {(d, len(ids[d]), sha(ids[d].tobytes()), sha(t.encode())) for d, t in docs}
    assert {r.doc_id for r in QUERIES["op1_decontamination"](spark, tables).select("doc_id").collect()} == {3, 12, 21, 30, 39}
