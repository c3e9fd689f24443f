"""Spelling variants and collocations against plain versions of their contracts."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codeatlas.llm import phrases, spelling

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, word string, n int, hot boolean, node int"


def rows_of(spark, rows, schema=SCHEMA):
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# ---- spelling ------------------------------------------------------------------------------


def plain_counts(docs, occurs, slip=spelling.SLIP):
    n = Counter()
    for id, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= spelling.LENGTH:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= occurs}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    c = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[c + (len(a) >= len(b)):] == b[c + (len(b) >= len(a)):]


def plain_variants(words, times=spelling.TIMES):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def found(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_one_edit_of_the_test_itself():
    assert one_edit("abcdef", "abcdeg") and one_edit("abcdef", "abcde") and one_edit("aaaaaa", "aaaaaaa") and one_edit("abcdef", "xabcdef")
    assert not one_edit("abcdef", "abcdef") and not one_edit("abcdef", "abdcef") and not one_edit("abcdef", "abcdefgh")


@pytest.mark.parametrize("seed, letters", [(0, "ab"), (1, "abc"), (2, "aéÿ")])
def test_dense_words(spark, seed, letters):
    """Few letters: nearly everything is near something, in all places and with runs of one letter."""
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), rng.integers(6, 10))): int(rng.integers(1, 400)) for _ in range(220)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert found(spelling.variants(df)) == plain_variants(words)


def test_chains_branches_and_long_words(spark):
    long = "".join(np.random.default_rng(5).choice(list("abcdefgh"), 3000))
    words = {"aaaaaa" + "a" * k: 5 * 6 ** (k % 4) for k in range(12)}
    words |= {long: 1000, long[:-1]: 10, long[:1500] + "z" + long[1501:]: 11, "z" + long: 12, long[1:]: 13, long[:700]: 7}
    words |= {"colour": 900, "color" + "s": 5, "colours": 60, "xcolour": 9, "dolour": 5, "colouz": 5, "coloux": 900}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert found(spelling.variants(df)) == plain_variants(words)


def test_hot_and_cold_nodes_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = {"shared" + "".join(rng.choice(list("abcd"), rng.integers(1, 6))): int(rng.integers(5, 99)) for _ in range(150)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    for share in (3, 1_000_000):
        monkeypatch.setattr(spelling, "HOT_SHARE", share)
        assert found(spelling.variants(df)) == plain_variants(words)


def test_words_of_documents(spark):
    rng = np.random.default_rng(3)
    stems = ["garden", "Gardens", "gärden", "Straße", "ÉCOLES", "écoles", "éçoles", "lettersx", "letter", "abc"]
    docs = [(k, "1".join(rng.choice(stems, 60)) + " x\nlettering" * 3) for k in range(40)]
    docs += [(None, "gardens" * 1), (None, None), (7, ""), (7, "garden "), (7, "garden "), (8, " \t"), (9, "w" * 100_000)]
    df = rows_of(spark, docs)
    words = plain_counts(docs, spelling.OCCURS)
    got = spelling.vocabulary(spelling.occurrences(df))
    assert {(r.word, r.n) for r in got.collect()} == set(words.items())
    assert found(spelling.variants(got)) == plain_variants(words)
    # every run slips where one in one does
    every = spelling.vocabulary(spelling.occurrences(df, slip=1), 1)
    assert {(r.word, r.n) for r in every.collect()} == set(plain_counts(docs, 1, 1).items())


def test_no_words(spark):
    empty = rows_of(spark, [])
    assert found(spelling.variants(spelling.vocabulary(spelling.occurrences(empty)))) == set()
    lone = spark.createDataFrame([("garden", 7)], "word string, n bigint")
    assert found(spelling.variants(lone)) == {("garden", None, "garden", 7, 0, None)}


def test_exploded_tables_are_never_broadcast(spark, monkeypatch):
    """The prefixes of a small vocabulary look as small as its words."""
    plans, stage = {}, spelling.stage

    def seen(df, label, *args, **metrics):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label, *args, **metrics)

    monkeypatch.setattr(spelling, "stage", seen)
    words = {"garden": 90, "gardan": 3, "gardann": 1, "harbour": 40, "harbor": 7}
    df = spark.createDataFrame([*words.items()], "word string, n long")
    result = spelling.variants(df)
    assert found(result) == plain_variants(words)
    plans["result"] = [result._jdf.queryExecution().executedPlan().toString()]
    met = [p for label in ("trie", "edges", "forms", "ways", "result") for p in plans[label]]
    assert len(met) >= 5 and not [p for p in met if "BroadcastHashJoin" in p]
    # A step broadcasts the edges of hot nodes, once for states that follow and once for those that branch.
    assert len(plans["frontier"]) > 1 and all(p.count("BroadcastHashJoin") <= 2 for p in plans["frontier"])
    assert all(p.count("SortMergeJoin") == 2 for p in plans["frontier"][1:])  # at the root all states are hot


# ---- phrases -------------------------------------------------------------------------------


def plain_phrases(docs, least, longest=5):
    n = {}
    for text, lang in docs:
        c = n.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            c[""] += len(w)
            c.update(" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    sums = {(lang, ""): c[""] for lang, c in n.items() if c[""]}
    return sums | {(lang, p): a for lang, c in n.items() for p, a in c.items() if p and a >= least}


def plain_report(counts, report):
    langs = {}
    for (lang, phrase), a in counts.items():
        langs.setdefault(lang, {})[phrase] = a
    out = []
    for lang, f in langs.items():
        many = {p for p in f if " " in p}
        rows = []
        for p in many:
            a, w = f[p], p.split(" ")
            if any(f[q] >= a and f" {p} " in f" {q} " and q != p for q in many):
                continue
            cuts = [(1000 * a * f[""] // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out += [(lang, i, p.decode(), -a, l, r, f[""], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:report], 1)]
    return sorted(out)


def documents(seed, n=60):
    rng = np.random.default_rng(seed)
    vocab = ["alpha", "Beta", "gamma", "delta", "é", "x1", " ", "z-z", "ÀB"]
    stop = [" ", " ", " ", " ", ", ", ". ", "\n", "\t", "  ", "\x0b"]
    rows = []
    for k in range(n):
        text = "".join(w + s for w, s in zip(rng.choice(vocab, 40), rng.choice(stop, 40)))
        rows.append((k, text + " in the long run we all agree", [None, "en", "und", ""][k % 4]))
    return rows + [(None, None, None), (1, "", "fr"), (2, " .,\n", "fr"), (3, "a b a b a b", "en"), (3, "a b a b a b", "en")]


def counts_of(df):
    rows = [((r.lang, r.phrase), r.n) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("least", [2, 9, 60, 1000])
def test_counts_are_exact(spark, least):
    rows = documents(least)
    df = rows_of(spark, rows, "doc_id bigint, text string, lang string, phrase string, k int").repartition(3)
    want = plain_phrases([r[1:] for r in rows], least)
    assert counts_of(phrases.mined(df, least)) == want
    assert counts_of(phrases.frequent(df, least, sample=2)) == want


def test_border_failures_are_mended(spark):
    """Proposals that miss everything, or name phrases that don't occur, change nothing."""
    rows = documents(7)
    df = rows_of(spark, rows, "doc_id bigint, text string, lang string")
    want = plain_phrases([r[1:] for r in rows], 5)
    for guess in ([], [("en", "alpha"), ("en", "never seen before")], [(l, p) for l, p in want if p and hash(p) % 2]):
        proposals = spark.createDataFrame(guess, "lang string, phrase string")
        assert counts_of(phrases.mined(df, 5, proposals=proposals)) == want


def test_full_bit_table_counts_all(spark, monkeypatch):
    rows = documents(8, 20)
    df = rows_of(spark, rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(phrases, "FILTER_BITS", 6)
    assert counts_of(phrases.mined(df, 4)) == plain_phrases([r[1:] for r in rows], 4)


@pytest.mark.parametrize("limit", [16, 64, 300])
def test_long_texts_in_slices(spark, limit):
    """Pieces run across slices, and words longer than a slice stay whole."""
    rng = np.random.default_rng(limit)
    words = ["a", "bb", "ccc", "d" * 40, "é" * 30]
    rows = [(k, "".join(w + s for w, s in zip(rng.choice(words, 200), rng.choice([" ", " ", " ", ". ", "   "], 200))), "en") for k in range(5)]
    df = rows_of(spark, rows, "doc_id bigint, text string, lang string")
    assert counts_of(phrases.mined(df, 3, limit=limit)) == plain_phrases([r[1:] for r in rows], 3)


def test_hashes_agree():
    """The table is made from strings and read by arrays."""
    texts = pa.array(["a bb é d", "bb", None, "bb é"])
    words = phrases.Words(*phrases._ended(texts), pa.array(["en", "fr", None, "en"]))
    h = words.hashes[words.ids]
    pairs = list(zip(words.langs.to_pylist(), words.words.to_pylist()))
    assert [pairs[i] for i in words.ids] == [(b"en", b"a"), (b"en", b"bb"), (b"en", "é".encode()), (b"en", b"d"), (b"fr", b"bb"), (b"en", b"bb"), (b"en", "é".encode())]
    whole = h[:1]
    for k in range(1, 4):
        whole = phrases._longer(whole, h[k:k + 1])
    for phrase, lang, want in (("a bb é d", "en", whole[0]), ("bb", "fr", h[4]), ("bb", "en", h[1])):
        batch = pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([phrase])], names=["lang", "phrase"])
        row = next(phrases._bit_rows(iter([batch]))).to_pylist()[0]
        place = int(want) >> (64 - phrases.FILTER_BITS)
        assert (row["slot"], row["mask"] & (2**64 - 1)) == (place >> 6, 1 << (place & 63))


@pytest.mark.parametrize("report", [3, 2000])
def test_report(spark, report):
    rows = documents(11)
    df = rows_of(spark, rows, "doc_id bigint, text string, lang string")
    got = phrases.collocations(phrases.mined(df, 4), report)
    want = plain_report(plain_phrases([r[1:] for r in rows], 4), report)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == want
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", "", 0, 9 * big), ("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, phrase string, k int, n bigint")).collect()
    assert [(r.score, r.a, r.l, r.r) for r in got] == [(1000 * (big - 1) * 9 * big // (big * big), big - 1, big, big)]


def test_no_documents(spark):
    empty = rows_of(spark, [], "doc_id bigint, text string, lang string")
    assert phrases.collocations(phrases.frequent(empty)).count() == 0
