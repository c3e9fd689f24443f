"""The operators on small documents, against plain versions of what they promise."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from codeatlas.llm import bpe, decontaminate, hilbert, langid, pii, quality, repeats, simhash, suffix_tree, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to river stone light carries under morning paper window green slowly letter table garden music winter market".split()


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + f" end{seed}."


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows: nulls everywhere, empty, white space, repeats, ties, one long text, copies."""
    base = prose(1)
    rows = [
        (1, base, "en", "a", None), (2, base, "en", "a", 3), (3, base + " more", None, None, None), (4, "", "en", "b", 0),
        (5, None, "fr", None, None), (6, " \t\n", None, "b", 1), (7, "one two", "en", "b", 2), (8, prose(8), "en", "b", 9),
        (8, prose(8), "en", "b", 9), (None, prose(9), None, None, None), (10, " ".join(prose(1000 + k, 500) for k in range(40)), "en", "c", 1),
        (11, "é" * 50 + " ½ \U0001f600 x" * 9, "fr", "c", 1), (12, prose(12) + " " + base, "en", "c", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# ---- 1: decontamination ------------------------------------------------------------------


def edits(pattern, text):
    """Least edits of a pattern against any substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != t))
    return min(row)


def fold(s):
    return re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalnum() else " ", s)


def test_decontamination_against_plain_edit_distance(spark):
    items = [(1, prose(100, 30)), (2, prose(101, 12)), (3, None), (4, "short"), (5, prose(102, 40))]
    rng = np.random.default_rng(3)

    def noisy(s, n):
        s = list(s)
        for at in rng.integers(0, len(s), n):
            s[at] = "qx"[int(rng.integers(2))] if rng.random() < 0.6 else ""
        return "".join(s)

    rows = [(k, prose(k)) for k in range(6)]
    rows += [(10 + k, prose(k, 20) + " ... " + noisy(items[[0, 1, 4][k % 3]][1], k)) for k in range(16)]
    rows += [(40, items[0][1].upper().replace(" ", " -- ")), (41, items[0][1][60:]), (50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontaminate.matches(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    index = decontaminate.block(items)
    want = set()
    for d, t in rows:
        flat = re.sub(" +", " ", fold(t or "")).strip()
        for w, pattern in enumerate(index.texts):
            if edits(pattern.decode(), flat) <= index.edits[w]:
                want.add((d, index.ids[index.item[w]]))
    assert {(r.doc_id, r.item_id) for r in got} == want and (40, 1) in want
    exact = next(r for r in got if (r.doc_id, r.item_id) == (10, 1))
    assert exact.edits == 0 and dict(rows)[10][exact.start:exact.end].strip().startswith(items[0][1][:-1])


def test_decontamination_odd_inputs(spark, docs, nothing):
    items = spark.createDataFrame([(1, prose(1))], "item_id bigint, text string")
    empty = items.limit(0)
    assert {r.doc_id for r in decontaminate.matches(docs, items).collect()} == {1, 2, 3, 12}
    assert decontaminate.matches(docs, empty).count() == decontaminate.matches(nothing, items).count() == 0
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    blocks = list(decontaminate.blocks(spark.createDataFrame([(k, "x" * 10) for k in range(7)], "item_id bigint, text string"), 25))
    assert sorted(r[0] for b in blocks for r in b) == list(range(7)) and max(map(len, blocks)) == 2


def found(items, texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    index = decontaminate.block(items)
    return {(d, index.ids[i]): (s, e, c) for d, i, s, e, c, _ in decontaminate.regions(np.frombuffer(b"".join(data), np.uint8), offsets, index)}


@pytest.mark.parametrize("size", [50, 61, 95, 110])
def test_copied_passages_at_every_offset(size):
    item = prose(700, 40).rstrip(".")
    places = range(len(item) - size + 1)
    texts = [prose(k, 12) + " Qq; " + item[at:at + size] + " (zz) " + prose(k + 1, 12) for k, at in enumerate(places)]
    got = found([("x", item), ("y", prose(701, 40))], texts)
    assert set(got) == {(d, "x") for d in places}
    for d, t in enumerate(texts):
        s, e, c = got[d, "x"]
        at = t.index(" Qq; ") + 5
        assert c == 0 and at - 24 <= s <= at + 5 and at + size - 5 <= e <= at + size + 24  # windows over its ends have edits


def test_copied_passages_with_a_replaced_word_or_edits():
    item = prose(702, 40)
    for at in range(0, len(item) - 115):
        part = item[at:at + 115]
        assert (0, "x") in found([("x", item)], ["Aa " + part[:54] + "wonderfully" + part[61:] + " zz"]), at
        assert (0, "x") in found([("x", item)], ["Aa " + part[:15] + part[16:30] + "q" + part[31:50] + " zz"]), at
        assert not found([("x", item)], ["Aa " + part[:44] + " zz"]), at


def test_short_items_stand_exactly():
    items = [(1, "Yes, we can"), (2, "short"), (3, "你好吗"), (4, "a.b c d e f g h i j k l"), (5, "..."), (6, None), (7, "SHORT!")]
    texts = ["Then: YES -- we can!", "yes we cannot", "shorts", "too short", "他说你好吗。", "", "short", "a b c d e f g h i j k l m", "ashort", "yes we", "can"]
    got = found(items, texts)
    assert set(got) == {(0, 1), (3, 2), (3, 7), (4, 3), (6, 2), (6, 7), (7, 4)}
    assert texts[0][slice(*got[0, 1][:2])] == "YES -- we can" and texts[4][slice(*got[4, 3][:2])] == "你好吗"


# ---- 2: near-duplicates ------------------------------------------------------------------


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps):
    """Least id reachable over links of at most two bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if d is not None or find(i) in least else None
    return sorted(((d, f, least[find(i)]) for i, (d, f) in enumerate(fps)), key=str)


def test_simhash_classes(docs, nothing):
    want = plain_classes([(d, plain_fingerprint(t)) for d, t in texts_of(docs)])
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.classes(docs).collect()]
    assert sorted(got, key=str) == want
    assert simhash.classes(nothing).count() == 0
    kept = simhash.keep_first(docs)
    firsts = {c for _, _, c in want if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(firsts) and kept.columns == docs.columns


def test_keep_first_goes_by_the_text_not_by_the_id_alone(spark):
    a, b, c, d = (prose(800 + k, 80) for k in range(4))
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (3, a, "x"), (None, a, "n"), (None, c, "n"), (None, c, "m"), (5, d, "n"), (5, d, "m"), (None, "", "n"), (None, None, "n")]
    out = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, fp string"))
    assert out.columns == ["doc_id", "text", "fp"]
    got = Counter((r.doc_id, r.text or "") for r in out.collect())
    assert got == {(1, a): 1, (1, b): 1, (None, c): 1, (5, d): 1, (None, ""): 1}


def test_simhash_links_chains(spark):
    rng = np.random.default_rng(0)
    fps = {int(rng.integers(0, 1 << 62))}
    for _ in range(120):  # chains and balls of fingerprints one to three bits apart
        f = list(fps)[int(rng.integers(len(fps)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 4))):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    label = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect()}
    groups = Counter(label.get(s, s) for (s,) in signed)
    want = Counter(c for _, _, c in plain_classes(list(enumerate(fps))))
    assert sorted(groups.values()) == sorted(want.values())
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame(signed, "fp bigint"), 3)


# ---- 3 and 5: classifiers ----------------------------------------------------------------


def languages(n):
    rng = np.random.default_rng(4)
    words = {"xx": "bala kora tumi salo rema".split(), "yy": "strk wint hjolk grut flisk".split(), "zz": "ñandú él qué más según".split()}
    for i in range(n):
        lang = ("xx", "yy", "zz")[i % 3]
        yield i, " ".join(rng.choice(words[lang], 40)), lang


def test_language(spark, docs):
    rows = list(languages(300))
    df = spark.createDataFrame([*rows, (900, "123 ...", None), (901, None, "xx"), (902, "", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df.drop("lang"), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[d].lang_pred == lang and 0 <= got[d].score <= 1 for d, _, lang in held)
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3 and got[901].score == 0
    assert langid.predict(docs, model).count() == docs.count()
    untaught = langid.predict(docs, langid.fit(docs.where("false")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_toxicity(spark, docs):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = list(rng.choice(WORDS, 50)) + ["nasty,"] * (toxic and i % 8 == 0) + ["Vileness"] * (toxic and i % 8 != 0)
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en" if i % 2 else None))
        labels += [(i, int(toxic))] if i % 3 else []
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 0), (4, None)], "doc_id bigint, toxic int")
    model, base = toxicity.fit(df, marks)
    got = {r.doc_id: r for r in toxicity.flagged(toxicity.score(df, model, base), model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].score >= 0.3) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(docs, model, base).where("score is null").count() == 0
    model, base = toxicity.fit(df, marks.where("toxic = 0"))
    assert model is None and {r.score for r in toxicity.score(docs, model, base).collect()} == {0.0}
    assert not any(r.flagged for r in toxicity.flagged(toxicity.score(docs, None, base), None).collect())


def test_toxicity_meets_its_labels_alike_at_any_size(spark, monkeypatch, tmp_path):
    plans, write = {}, toxicity.stage

    def seen(df, label, **metrics):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, **metrics)

    monkeypatch.setattr(toxicity, "stage", seen)
    spark.createDataFrame([(i, f"word{i}", "en") for i in range(40)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels")
    toxicity.fit(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/labels"))  # files have a size, by which a join is planned
    assert "SortMergeJoin" in plans["toxicity-rows"] and "Broadcast" not in plans["toxicity-rows"]


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Neither long texts nor many rows are left out, and the rows of several tasks make one model."""
    monkeypatch.setattr(toxicity, "OWN_ROWS", 40, raising=False)
    toxic = lambda i: i % 3 == 0
    rows = [(i, (prose(i, 40) + " Vileness. " + prose(i + 1, 6000)) if toxic(i) else prose(i, 40)) for i in range(240)]
    assert all(len(t) > 32_000 for i, t in rows if toxic(i))
    rows += [(1000, prose(7) + " vileness " + prose(8)), (1001, prose(7) + " " + prose(8))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' as lang").repartition(4)
    marks = spark.createDataFrame([(i, int(toxic(i))) for i in range(240)], "doc_id bigint, toxic int")
    model, base = toxicity.fit(df, marks)
    got = {r.doc_id: r.score for r in toxicity.score(df, model, base).collect()}
    assert model is not None and got[1000] > 0.3 > got[1001]


# ---- 4: quality rules --------------------------------------------------------------------


def plain_measures(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality(spark, docs, nothing):
    more = [(20, "a b c d e f g h " * 3), (21, "x\nx\n \n\nx y"), (22, "the " * 40), (23, "# $ the of and " * 10), (24, prose(3) + "\n" + prose(3))]
    df = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in more], SCHEMA))
    got = quality.judged(df).collect()
    for r in got:
        want = plain_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert {1, 2, 3} <= kept and not kept & {4, 5, 6, 7, 20, 21, 22, 24}
    out = quality.keep_good(df.withColumn("n_words", df.doc_id))
    assert out.columns == [*df.columns, "n_words"] and {r.doc_id for r in out.collect()} == kept
    assert quality.keep_good(nothing).count() == 0


def test_quality_has_no_upper_bound_of_words(spark):
    text = " ".join(f"the w{i}" for i in range(500_000)) + " end"
    df = spark.createDataFrame([(1, text), (2, "the w " * 500_001)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.judged(df).drop("text").collect()}
    assert got[1].n_words == 1_000_001 and got[1].kept and not got[1].base_failed
    assert got[2].n_words == 1_000_002 and got[2].base_failed and not got[2].kept
    assert [r.doc_id for r in quality.keep_good(df).select("doc_id").collect()] == [1]


# ---- 6: repeated passages ----------------------------------------------------------------


def plain_kept(docs):
    seen, out = set(), []
    for d, t in sorted(docs):
        x = t.encode()
        gone = bytearray(len(x))
        for i in range(len(x) - 99):
            if x[i:i + 100] in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(x[i:i + 100])
        left = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), len(re.findall(b"\1+", bytes(gone))), left))
    return out


@pytest.mark.parametrize("hot", [1, 2048])
def test_repeats(spark, docs, nothing, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    passage = prose(50, 40)
    rows = [(d, t) for d, t in texts_of(docs) if d not in (None, 8)]
    rows += [(100 + k, prose(200 + k, 15) + passage[: 180 + k] + prose(300 + k, 10)) for k in range(8)]
    rows += [(120, "ab" * 400), (121, "ab" * 90 + passage), (122, passage + passage), (123, passage[:99]), (124, "z" * 101), (125, "z" * 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(df).collect())
    assert got == plain_kept(rows)
    if hot == 1:
        odd = {(r.doc_id, r.n_bytes): bytes(r.kept) for r in repeats.without_repeats(docs).collect()}
        assert odd[8, len(prose(8))] == prose(8).encode() and odd[None, len(prose(9))] == prose(9).encode() and odd[5, 0] == b""
        assert repeats.without_repeats(nothing).count() == 0


def test_maximal_repeats_against_all_substrings():
    rng = np.random.default_rng(6)
    for _ in range(40):
        texts = ["".join(rng.choice(list("ab"), int(rng.integers(0, 12)))) for _ in range(3)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        got = {(n, tuple(sorted(p.tolist()))) for n, p in repeats.maximal_repeats(data, ends, 2)}
        places, starts = {}, np.cumsum([0, *[len(t) for t in texts]])
        for t, at in zip(texts, starts):
            for i in range(len(t)):
                for j in range(i + 2, len(t) + 1):
                    places.setdefault(t[i:j], []).append((int(at) + i, t[i - 1] if i else object(), t[j] if j < len(t) else object()))
        want = {
            (len(s), tuple(sorted(p for p, _, _ in o))) for s, o in places.items()
            if len(o) > 1 and len({x for _, x, _ in o}) > 1 and len({x for _, _, x in o}) > 1
        }
        assert got == want


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    text = prose(1, 400).encode()
    monkeypatch.setattr(repeats, "STEP", 500)
    cut = {(int(base[0]), bytes(data)) for data, _, _, base in repeats.pieces([1], [text])}
    assert all(any(text[i:i + 100] in d for _, d in cut) for i in range(len(text) - 99)) and len(cut) > 3


# ---- 7: personal data --------------------------------------------------------------------

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def test_pii(spark, docs, nothing):
    texts = [
        "mail a.b@c.example.com, x@y.z_w@q.rs and a@b and -@-.- é", "ip 1.2.3.4 1.2.3.4.5 300.1.1.1 007.08.9.0001 1.2.3", "@" * 50 + "a" * 3000,
        "card 4539 1488 0343 6467, 4539148803436467x 4539148803436468 " + "1 " * 9000, "call +1 (377) 555-0271 or +49-30-1234567, +12 +1234567890123456",
        "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 GB83WEST12345698765432", "tel 377-555-0271 but a long way on, far from any such word, stands 377-555-0272",
        "+4539148803436467 a@1.2.3.4", "",
    ]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).unionByName(docs)
    for r in pii.spans(df).collect():
        text, found = r.text or "", [(s.kind, s.start, s.stop) for s in r.pii]
        for rank, (kind, (pattern, valid)) in enumerate(BASE.items()):
            want = [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if valid(m[0])]
            assert [f for f in found if f[0] == kind] == want
        assert found == sorted(found, key=lambda f: (f[1], [k.name for k in pii.KINDS].index(f[0])))
    got = {r.doc_id: [(s.kind, r.text[s.start:s.stop]) for s in r.pii] for r in pii.spans(df.limit(len(texts))).collect()}
    assert [m for k, m in got[5] if k == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [m for k, m in got[6] if k == "local_phone"] == ["377-555-0271"]
    clean = {r.doc_id: r.text for r in pii.redact(df.limit(len(texts)).withColumn("pii", df.doc_id)).collect()}
    assert clean[7] == "+[CARD] [EMAIL]" and clean[0].startswith("mail [EMAIL], ")
    assert clean[2] == texts[2] and "4539148803436467" not in clean[3] and pii.redact(nothing).count() == 0


# ---- 8: shards ---------------------------------------------------------------------------


def test_hilbert_curve_is_a_path():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
        order = np.argsort(hilbert.index(points, bits))
        assert sorted(hilbert.index(points, bits).tolist()) == list(range(side ** dims))
        assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, docs, nothing, tmp_path):
    got = hilbert.shards(docs, 4).collect()
    assert len(got) == docs.count()
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(4)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    text = dict(texts_of(docs))
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    in_order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(in_order)
    assert hilbert.shards(nothing).count() == 0
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    hilbert.write(one, str(tmp_path / "shards"), 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == one.count()


# ---- 9: language model -------------------------------------------------------------------


def test_suffix_tree_scores(spark, docs, nothing, monkeypatch):
    rows = [(i, prose(i, 30) + ("" if i % 7 else " Ünusual \x00 Word")) for i in range(120)] + [(500, ""), (501, None), (8, prose(8, 30))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(suffix_tree, "FREQUENT", 30)
    words = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split() + [None]
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    got = suffix_tree.learned_scores(df).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    by_id = {r.doc_id: r for r in got}
    for d, t in rows:
        w, r = words(t), by_id[d]
        assert (r.n_tokens, r.n_known) == (len(w), sum(counts[x] > 0 for x in w))
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    assert by_id[500].score == by_id[501].score < 0 and by_id[0].score < by_id[500].score
    assert suffix_tree.learned_scores(nothing).count() == 0


def test_suffix_tree_is_a_distribution(spark):
    df = spark.createDataFrame([(prose(i),) for i in range(50)], "text string")
    tree = suffix_tree.fit(df)
    assert np.allclose((10.0 ** tree.logs.astype(float)).sum(axis=1), 1, atol=1e-4) and len(tree.logs) > 10
    states = tree.states()
    for text in (b"the river", b""):  # by walking the longest suffix by hand
        sym = [suffix_tree.END] * suffix_tree.DEPTH + [int(tree.table[b]) for b in text] + [suffix_tree.END]
        total = 0.0
        for i in range(suffix_tree.DEPTH, len(sym)):
            state, number = 0, 1
            for length, kept in enumerate(tree.contexts, 1):
                code = 0
                for s in sym[i - length:i]:
                    code = code << suffix_tree.SIX | s
                at = np.searchsorted(kept, code)
                if at < len(kept) and kept[at] == code:
                    state = number + int(at)
                number += len(kept)
            total += float(tree.logs[state, sym[i]])
        assert math.isclose(suffix_tree.text_scores([text], tree, states)[0], total, abs_tol=1e-3)


def test_suffix_tree_tells_all_bytes_apart(spark):
    table = suffix_tree.symbols(np.arange(256)[::-1])
    assert len(set(table.tolist())) == 256
    for text in (bytes(range(256)), b"", b"\xff\x00\xfe", b"ab"):
        sym, starts = suffix_tree._laid_out([text, text], table)
        half = sym[suffix_tree.DEPTH:starts[1]].tolist()
        back, symbols = [], iter(half[:-1])
        for s in symbols:
            back.append(table.tolist().index(s if s < suffix_tree.PLAIN else s << suffix_tree.SIX | next(symbols)))
        assert bytes(back) == text and half[-1] == suffix_tree.END and sym[starts[1] + suffix_tree.DEPTH:].tolist() == half
    # Two letters that were one symbol: one follows the other always, which the tree learns.
    common = "".join(map(chr, range(0x21, 0x7F)))
    rows = [(i, common + " " + common + " \u0416\u0424") for i in range(60)]
    learned = [(1000, "\u0416\u0424"), (1001, "\u0424\u0416")]
    df = spark.createDataFrame(rows + learned, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in suffix_tree.learned_scores(df).collect()}
    assert got[1000] > got[1001] + 0.5


def test_suffix_tree_keeps_contexts_beyond_its_states(spark, monkeypatch):
    rows = [(i, prose(i, 40) + " \u0416\u0424"[: 3 * (i % 2)]) for i in range(100)] + [(500, ""), (501, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = {r.doc_id: r.score for r in suffix_tree.learned_scores(df).collect()}
    whole = suffix_tree.fit(suffix_tree.training(df))
    for states in (0, 40, 400):
        monkeypatch.setattr(suffix_tree, "STATES", states)
        assert sum(map(len, suffix_tree.fit(suffix_tree.training(df)).contexts)) < sum(map(len, whole.contexts))
        got = {r.doc_id: r.score for r in suffix_tree.learned_scores(df).collect()}
        assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k], rel_tol=1e-5) for k in got)


# ---- 10: byte BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(docs, nothing, reference):
    got = bpe.encoded(docs.withColumn("ids", docs.doc_id)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encoded(nothing).count() == 0


def test_bpe_odd_texts(reference):
    encoder = bpe.Encoder(bpe.ranks(public_tokenizers.path(bpe.VOCABULARY)))
    rng = np.random.default_rng(7)
    marks = [chr(c) for c in (9, 10, 13, 32, 32, 32, 0x85, 0xA0, 0x1C, 0x2028, 0xB2, 0x4E00, 0x1F600, 0xE9, 0x301, 39, 115, 116, 65, 48, 46, 0)]
    texts = ["".join(rng.choice(marks, int(rng.integers(0, 14)))) for _ in range(3000)]
    texts += ["ab" * 5000, "aaaaaaab" * 900, "don't we'll  I'd", "a  b", " \n a", "<|endoftext|>", "\U0001f468‍\U0001f469" * 50]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == reference.encode_ordinary(t), repr(t)


# ---- pipeline ----------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    item = prose(900, 40)
    good = [(k, prose(k, 80), "en", "s", 1) for k in range(12)]
    rows = [
        *good, (50, good[3][1], "en", "s", 1), (51, good[4][1] + " x", "en", "s", 1), (52, "too short", "en", "s", 1),
        (53, prose(53, 60) + " " + item, "en", "s", 1), (54, prose(54, 80) + " me@mail.example.com", None, None, None), (55, None, None, None, None),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    fps = plain_classes([(d, plain_fingerprint(t)) for d, t, *_ in rows if d not in (52, 55)])
    want = {c for _, _, c in fps} - {53}
    assert {r.doc_id for r in out} == want and {0, 3, 54} <= want and not want & {50, 52, 55}
    text = {r.doc_id: r.text for r in out}
    assert text[54].endswith(" [EMAIL]") and all(text[d] == t for d, t, *_ in good if d in text)
    assert all(r.n_tokens == len(r.ids) // 4 > 0 for r in out) and len(corpus_pipeline.STAGES) == 5
