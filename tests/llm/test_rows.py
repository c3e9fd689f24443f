"""Rows that share ids, have none, tie or carry clashing columns; and texts with very many matches."""

import random
import re
import time

import corpus_pipeline
from codeatlas.llm import decontaminate, pii, simhash

from .test_documents import prose


def test_keep_clean_judges_each_row_by_its_text(spark):
    item = prose(900, 40)
    rows = [(None, prose(1)), (None, prose(2) + " " + item), (None, None), (7, prose(3)), (7, item + " and more"), (7, prose(3))]
    docs = spark.createDataFrame([(*r, k, {"a": k}) for k, r in enumerate(rows)], "doc_id bigint, text string, item_id int, windows map<string, int>").repartition(3)
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string")
    kept = decontaminate.keep_clean(docs, items)
    assert kept.schema == docs.schema
    assert sorted(r.item_id for r in kept.collect()) == [0, 2, 3, 5]
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == 6


def test_keep_first_settles_ties_and_keeps_columns(spark):
    a, b = prose(5), prose(6)
    rows = [(4, a, "z", 1), (4, a, "y", 2), (4, a, "y", 2), (4, b, "x", 3), (2, a, "w", 4), (None, b, "v", 5), (None, "other words alone here", "u", 6), (None, "other words alone here", "u", 6)]
    docs = spark.createDataFrame([(*r, {"k": r[3]}) for r in rows], "doc_id bigint, text string, _sim_a string, _s_row int, m map<string, int>")
    runs = {tuple(sorted(map(repr, simhash.keep_first(docs.repartition(n)).collect()))) for n in (1, 3, 5)}
    assert len(runs) == 1
    out = simhash.keep_first(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id or 0, r.text == a, r._sim_a, r._s_row) for r in out.collect()) == [(0, False, "u", 6), (2, True, "w", 4), (4, False, "x", 3)]


def test_tokens_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 9, b"x"), (2, None, None, None, None)], "doc_id bigint, text string, decoded string, n_tokens int, ids binary")
    out = corpus_pipeline.tokens(spark, docs, "")
    assert out.columns == ["doc_id", "text", "decoded", "ids", "n_tokens"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].decoded == "mine" and rows[1].text == "a b" and rows[1].n_tokens == len(rows[1].ids) // 4 and rows[2].text is None and rows[2].n_tokens == 0


def plain_redacted(text, spans):
    out, at = [], 0
    for kind, start, stop in spans:
        if stop <= at:
            continue
        out.append(text[at:max(start, at)])
        if start >= at:
            out.append(f"[{kind.upper()}]")
        at = stop
    return "".join(out) + text[at:]


def test_personal_data_in_dense_texts(spark):
    """Spans next to and inside each other, over the borders of pieces, with the context that counts at every distance."""
    rng = random.Random(4)
    bits = ["a@b.cd", "1.2.3.4", "4539 1488 0343 6467", "+49 30 1234567", "377-555-0271", " tel ", "é", "\U0001f600", " ", "x" * 37, "word ", ".", "1.2.3.4.5.6@x.yz", "tel: 377 555-0272,", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 400))) for _ in range(60)] + ["", "y" * 5000 + " a@b.cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    local = next(k for k in pii.KINDS if k.name == "local_phone")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for r in pii.spans(df).collect():
        text, found = texts[r.doc_id], [(s.kind, s.start, s.stop) for s in r.pii]
        shape = r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
        want = [(m.start(), m.end()) for m in re.finditer(shape, text) if re.search(local.near.replace("(?i)", ""), text[max(0, m.start() - pii.CONTEXT):m.start()], re.I)]
        assert [f[1:] for f in found if f[0] == "local_phone"] == want
        emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert [f[1:] for f in found if f[0] == "email"] == emails
        assert clean[r.doc_id] == plain_redacted(text, found)


def test_very_many_matches_in_one_text(spark):
    n = 100_000
    text = "".join(f"mail u{k}@host{k % 7}.example.com, " for k in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    row = pii.redact(df).first()
    assert row.text == "mail [EMAIL], " * n
    assert time.time() - began < 30  # with the square of the matches it took hours
    spans = pii.spans(df).first().pii
    assert [(s.start, s.stop) for s in spans] == [m.span() for m in re.finditer(r"u[0-9]+@host[0-9].example.com", text)]
