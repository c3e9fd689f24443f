"""Frequent phrases and their collocation scores, mined after Toivonen.

A sample of the documents proposes phrases, at a lowered threshold. Passes over all documents then count the proposals and their
negative border exactly: the border is every phrase that wasn't proposed although the phrases without its first and without its last
word were. Single words, the border of the empty phrase, are counted first, so that the border of longer phrases is built
on words that are frequent. A frequent phrase outside the proposals is a border failure. It joins the proposals, and an expansion pass
counts all that may follow from it, to the full length: phrases whose two shorter ones are frequent or weren't counted yet. After that
every frequent phrase has been counted over all documents, whatever the sample missed.

The border is large and nearly all of it rare. It is counted by 64-bit hashes of its phrases first; those whose hash reaches the threshold are
counted again by their words. A hash counts at least what each of its phrases does, so none is lost, and what is returned is counted by words.

Proposals travel as a bit table of fixed size (``FILTER_BITS``, a documented parameter): a bit set by chance only makes a
pass count a phrase more, so results are exact at any fill. Tasks add up per step of ``STEP_BYTES`` bytes before the shuffle; a longer text goes
through in slices that carry the last words over.

Nulls: a null text is empty, a null language ``und``. Repeated rows count as often as they occur. Ties in the ranking can't remain, as a
phrase is once in a language. Columns other than text, lang and doc_id aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..storage import stage
from .common import small_batches, steps

#: Words of the longest phrase, least count, and rows of a language's report.
LONGEST, LEAST, REPORT = 5, 100, 2000
#: A document in so many is in the sample. Its threshold is a quarter of LEAST's share there.
SAMPLE = 8
#: Bits of the table of proposals (8 MiB).
FILTER_BITS = 26
#: Bytes of text that are counted before their counts go to the shuffle; a longer text goes through in slices.
STEP_BYTES = 3 << 20

UNKNOWN = "und"
COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
HASHED = pa.schema([("h", pa.int64()), ("n", pa.int64())])

# What a byte is: part of a word, between words, or the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mixed(h):
    """Spread over all 64 bits; for numbers and for arrays."""
    if isinstance(h, int):
        h = ((h ^ (h >> 29)) * _TURN) & _MASK
        return h ^ (h >> 32)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_TURN)
    return h ^ (h >> np.uint64(32))


def _hash(lang: int, word: bytes) -> int:
    """Hash of one word; ``lang`` is its language's."""
    return _mixed(sum((b + 1) * pow(_TURN, i, 1 << 64) for i, b in enumerate(word)) + lang & _MASK)


def _hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """The same of many words (none is empty), before the language is added."""
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]].astype(np.uint64) + np.uint64(1)
    size = np.diff(at)
    power = np.ones(int(size.max()), np.uint64)
    power[1:] = np.uint64(_TURN)
    inside = np.arange(len(data)) - np.repeat(at[:-1] - at[0], size)
    return np.add.reduceat(data * np.multiply.accumulate(power)[inside], at[:-1] - at[0])


def _longer(h, word):
    """Hash of a phrase with one more word."""
    if isinstance(h, int):
        return (_mixed(h) * 31 + word) & _MASK
    return _mixed(h) * np.uint64(31) + word


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - FILTER_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


class Words:
    """The words of some texts: distinct (language, word) pairs, and for every place its pair and whether the next word goes on.

    ``data`` are the bytes of all texts, each with a line end behind it, ``ends`` where each text ends.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, langs: pa.Array):
        kind = _KIND[data]
        inside = np.empty(len(data) + 1, np.int8)
        inside[0], inside[1:] = 0, kind == 0
        turn = np.diff(inside)
        self.starts = np.flatnonzero(turn == 1)
        stop = np.flatnonzero(turn == -1)
        stops = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        self.goes_on = np.zeros(len(self.starts), bool)
        self.goes_on[:-1] = stops[1:] == stops[:-1]
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(stop - self.starts, out=at[1:])
        letters = _LOWER[data[inside[1:].view(bool)]]
        text = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        langs = pc.fill_null(langs, UNKNOWN).cast(pa.binary()).dictionary_encode()
        n = max(1, len(text.dictionary))
        of_row = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words_of_row = np.diff(np.searchsorted(self.starts, ends), prepend=0)
        key = np.repeat(of_row * n, words_of_row) + text.indices.to_numpy(zero_copy_only=False)
        if n * max(1, len(langs.dictionary)) <= 1 << 24:
            present = np.zeros(n * max(1, len(langs.dictionary)), np.int32)
            present[key] = 1
            pair = np.flatnonzero(present)
            self.ids = (np.cumsum(present, dtype=np.int32) - 1)[key]
        else:
            dense = pa.array(key).dictionary_encode()
            self.ids, pair = dense.indices.to_numpy(zero_copy_only=False), dense.dictionary.to_numpy(zero_copy_only=False)
        self.langs, self.words = langs.dictionary.take(pa.array(pair // n)), text.dictionary.take(pa.array(pair % n))
        of_lang = np.array([xxhash.xxh32_intdigest(x) for x in langs.dictionary.to_pylist()], np.uint64)
        self.hashes = _mixed(_hashes(text.dictionary)[pair % n] + of_lang[pair // n]) if len(pair) else np.empty(0, np.uint64)


def _tally(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct id, one of its places and how many it has."""
    n = np.bincount(ids)
    place = np.zeros(len(n), np.int64)
    place[ids] = np.arange(len(at))
    return place[n > 0], n[n > 0].astype(np.int64)


def _spelled(words: Words, at: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
    parts = [words.words.take(pa.array(words.ids[at + j])) for j in range(k)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]
    lang = words.langs.take(pa.array(words.ids[at]))
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(n)], schema=COUNTED)


def singles(words: Words, fresh: int) -> Iterator[pa.RecordBatch]:
    """Counts of the words from ``fresh`` on, and their sum per language as a phrase of no words."""
    at = np.arange(fresh, len(words.ids))
    if len(at):
        first, n = _tally(at, words.ids[at])
        counts = _spelled(words, at[first], n, 1)
        yield counts
        total = pa.table([counts.column("lang"), counts.column("n")], names=["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
        blank = pa.array([""] * total.num_rows, pa.string())
        yield pa.RecordBatch.from_arrays([total["lang"].combine_chunks(), blank, total["n_sum"].combine_chunks()], schema=COUNTED)


@dataclass(frozen=True)
class Pass:
    """What a pass counts: the proposals ``now`` with their border, less what a pass with ``old`` counted; of that only what ``likely`` holds."""

    now: np.ndarray
    old: np.ndarray | None = None
    likely: np.ndarray | None = None


def longer(words: Words, fresh: int, p: Pass, longest: int, hashed: bool) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of two words and more that end at word ``fresh`` or later, by their words or by their hashes."""
    ids, n, own = words.ids, len(words.ids), words.hashes
    if not n:
        return
    at, phrase, h = np.arange(n), ids, own[ids]
    # Where a phrase of the length before begins that is or may be frequent, and one that the earlier pass took for proposed.
    maybe = _has(p.now, own)[ids]
    had = _has(p.old, own)[ids] if p.old is not None else np.zeros(n, bool)
    for k in range(2, longest + 1):
        asked, before = np.zeros(n, bool), np.zeros(n, bool)
        asked[:-1] = maybe[:-1] & maybe[1:] & words.goes_on[:-1]
        before[:-1] = had[:-1] & had[1:] & words.goes_on[:-1]
        keep = asked[at]
        at, phrase, h = at[keep], phrase[keep], h[keep]
        if not len(at):
            return
        following = at + k - 1
        dense = pa.array(phrase.astype(np.int64) * len(own) + ids[following]).dictionary_encode()
        phrase = dense.indices.to_numpy(zero_copy_only=False)
        h = _longer(h, own[ids[following]])
        known = before[at]
        new = ~known & (following >= fresh)
        if p.likely is not None:
            new &= _has(p.likely, h)
        if new.any():
            first, count = _tally(at[new], phrase[new])
            if hashed:
                yield pa.RecordBatch.from_arrays([pa.array(h[new][first].view(np.int64)), pa.array(count)], schema=HASHED)
            else:
                yield _spelled(words, at[new][first], count, k)
        if k == longest:
            return
        maybe, had = np.zeros(n, bool), np.zeros(n, bool)
        maybe[at] = _has(p.now, h) | (~known if p.old is not None else False)
        if p.old is not None:
            had[at] = known & _has(p.old, h)


def _ended(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with a line end behind it, and where each ends."""
    texts = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_binary()), *[pa.scalar(x, pa.large_binary()) for x in (b"", b"\n")])
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]], at[1:] - at[0]


def _slices(batch: pa.RecordBatch, longest: int, limit: int) -> Iterator[tuple[Words, int]]:
    """Words of runs of rows, or of slices of a long row with the last words of the slice before."""
    for step in steps(batch, limit=limit):
        data, ends = _ended(step.column("text"))
        langs = step.column("lang")
        if len(data) <= limit or step.num_rows > 1:
            yield Words(data, ends, langs), 0
            continue
        breaks = np.flatnonzero(_KIND[data] != 0)  # the last byte is one
        start = begin = fresh = 0
        while begin < len(data):
            stop = int(breaks[min(np.searchsorted(breaks, begin + limit), len(breaks) - 1)]) + 1
            words = Words(data[start:stop], np.array([stop - start]), langs)
            yield words, fresh
            fresh = min(longest - 1, len(words.starts))
            begin, start = stop, start + int(words.starts[-fresh]) if fresh else stop


def _bit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = np.empty(batch.num_rows, np.uint64)
        for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())):
            of_lang = xxhash.xxh32_intdigest(lang.encode())
            first, *more = (_hash(of_lang, word) for word in phrase.encode().split(b" "))
            places[i] = reduce(_longer, more, first) >> (64 - FILTER_BITS)
        slot, back = np.unique(places >> np.uint64(6), return_inverse=True)
        mask = np.zeros(len(slot), np.uint64)
        np.bitwise_or.at(mask, back, np.uint64(1) << (places & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(mask.view(np.int64))], names=["slot", "mask"])


def _bits(rows: DataFrame, bits: np.ndarray) -> np.ndarray:
    """``bits`` with those of ``rows(slot, mask)`` set; at most 2**FILTER_BITS / 64 rows reach the driver."""
    found = rows.groupBy("slot").agg(F.expr("bit_or(mask) as mask")).toArrow()
    out = bits.copy()
    out[found["slot"].to_numpy()] |= found["mask"].to_numpy().view(np.uint64)
    return out


def bit_table(phrases: DataFrame, bits: np.ndarray) -> np.ndarray:
    """``bits`` with those of ``phrases(lang, phrase)`` set."""
    return _bits(phrases.select("lang", "phrase").mapInArrow(_bit_rows, "slot bigint, mask bigint"), bits)


def _hash_table(hashes: DataFrame) -> np.ndarray:
    """The table of ``hashes(h)``."""
    place = f"shiftrightunsigned(h, {64 - FILTER_BITS})"
    return _bits(hashes.selectExpr(f"{place} div 64 as slot", f"shiftleft(1L, cast({place} % 64 as int)) as mask"), _empty())


def _empty() -> np.ndarray:
    return np.zeros(1 << (FILTER_BITS - 6), np.uint64)


def mined(docs: DataFrame, least: int, longest: int = LONGEST, proposals: DataFrame | None = None, limit: int = STEP_BYTES) -> DataFrame:
    """(lang, phrase, k, n) of all phrases of ``docs(lang, text)`` with up to ``longest`` words and ``n >= least``; ``k`` is 0 for a language's sum.

    Right whatever ``proposals(lang, phrase)`` says; good ones save counting.
    """
    spark = docs.sparkSession

    def counted(p: Pass | None, hashed: bool = False) -> DataFrame:
        sent = spark.sparkContext.broadcast(None if p is None else vars(p))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            p = None if sent.value is None else Pass(**sent.value)
            for batch in batches:
                for words, fresh in _slices(batch, longest, limit):
                    yield from singles(words, fresh) if p is None else longer(words, fresh, p, longest, hashed)

        keys = ["h"] if hashed else ["lang", "phrase"]
        rows = docs.select("text", "lang").mapInArrow(run, "h bigint, n bigint" if hashed else "lang string, phrase string, n bigint")
        enough = F.col("n") >= least if hashed else (F.col("n") >= least) | (F.col("phrase") == "")
        with small_batches(spark, limit):
            return stage(rows.groupBy(*keys).agg(F.sum("n").alias("n")).where(enough), "phrases")[0]

    words = counted(None)
    now = bit_table(words.where("phrase <> ''"), _empty())
    if proposals is not None:
        now = bit_table(proposals.where("contains(phrase, ' ')"), now)
    found = counted(Pass(now, None, _hash_table(counted(Pass(now), hashed=True))))
    grown = bit_table(found, now)
    every = words.unionByName(found)
    if longest > 2 and (grown != now).any():  # border failures: what may follow from them hasn't been counted
        every = every.unionByName(counted(Pass(grown, now)))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return every.select("lang", "phrase", size.alias("k"), "n")


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE) -> DataFrame:
    """``mined`` over all of ``docs(doc_id, text, lang)``, with the proposals of one document in ``sample``."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(sample)) == 0).select("text", "lang")
    part, _ = stage(part, "sample")
    low = max(2, least // (4 * sample))
    return mined(docs, least, longest, mined(part, low, longest).where((F.col("k") > 1) & (F.col("k") < longest)))


def collocations(counts: DataFrame, report: int = REPORT) -> DataFrame:
    """The report of each language from ``counts(lang, phrase, k, n)``, closed under shorter phrases: (lang, rank, phrase, a, l, r, n, score)."""
    totals = counts.where("k = 0").select("lang", F.col("n").alias("total"))
    known = counts.where("k > 0").select("lang", "phrase", F.col("n").alias("f"))
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    within = candidates.where("k > 2").select(
        "lang", "a", F.explode(F.expr(
            "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))"
        )).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(within, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = left.select("lang", "phrase", "a", "words", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("head"),
        F.expr("array_join(slice(words, cut + 1, k - cut), ' ')").alias("tail"),
    )
    heads, tails = known.withColumnsRenamed({"phrase": "head", "f": "l"}), known.withColumnsRenamed({"phrase": "tail", "f": "r"})
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang").withColumn(
        "score", F.expr("(cast(a as decimal(18,0)) * 1000 * cast(total as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    )
    best = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    rows = best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("total").alias("n"), F.col("b.score").alias("score"))
    return number_rows(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]).where(F.col("rank") <= report)
