"""A probabilistic suffix tree over bytes, and token counts of the training corpus.

A text is its words, lowered (A-Z), with one space between and one end. Its bytes are written in ``SYMBOLS`` symbols: one for each of
the most frequent bytes of the corpus, two for any other byte (an escape comes first), and one for the end; so no two texts are written alike. Every run of ``DEPTH`` symbols and the next one is counted over
all training documents; shorter contexts are sums of those. A context is kept if its next-symbol distribution diverges from
that of the context one symbol shorter by more than its parameters cost (gain in nats over half the log of the corpus length
for each symbol seen), with all its suffixes. Distributions are smoothed by the shorter context's. A text is scored
by the longest kept suffix at each place.

Every context that passes is a state. At most ``STATES`` of them, those of the highest gains, are broadcast; of the others only a bit each
is (``SYMBOLS`` ** ``DEPTH`` bits at most), and places of a text that end in one get their probabilities by joins with the counts. Token counts
hold every word of the corpus. The most frequent ones, at most ``FREQUENT``, are broadcast; counts of all other
words reach the documents by a join. So nothing is left out.

Defined cases: null and empty texts consist of the end alone; repeated rows are learned from and scored each for itself;
with no training documents every symbol is as likely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import as_bytes, remainder, steps

DEPTH = 4
SIX = 6  # bits of a symbol
SYMBOLS = 1 << SIX
END = SYMBOLS - 1
ESCAPES = 4  # the symbols before the end: with any symbol but the end after them they stand for all bytes that have none of their own
PLAIN = END - ESCAPES
STATES = 1 << 17
FREQUENT = 1 << 20
WEIGHT = 8.0
GRAM = SIX * (DEPTH + 1)  # bits of a context with the next symbol
#: Distinct words a task counts before it hands them on.
HELD = 1 << 19
_END_WORD = b" end"  # no word holds a space


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def training(docs: DataFrame) -> DataFrame:
    """Documents to learn from: crc32 of the id mod 5 isn't 1."""
    return docs.select("doc_id", "text").where(remainder(F.col("doc_id"), 5) != 1).select("text")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): 64-bit hash and count of every token, the ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(_hash(list(counts))), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in steps(batch):
                for t in as_bytes(part.column("text")):
                    counts.update(t.lower().split())
                counts[_END_WORD] += part.num_rows
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def byte_counts(texts: DataFrame) -> np.ndarray:
    """How often each byte stands in the training texts; 256 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for part in steps(batch):
                for t in as_bytes(part.column("text")):
                    total += np.bincount(np.frombuffer(b" ".join(t.lower().split()), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in texts.mapInArrow(run, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def symbols(counts: np.ndarray) -> np.ndarray:
    """The symbol of each byte; for a rare one both symbols, as a number over all single ones."""
    rank = np.arange(256)
    rare = rank - PLAIN
    table = np.zeros(256, np.uint16)
    table[np.argsort(-counts, kind="stable")] = np.where(rare < 0, rank, PLAIN + rare // END << SIX | rare % END)
    return table


def _laid_out(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``DEPTH`` ends and before one; where a text starts."""
    lead = bytes(DEPTH)
    joined = np.frombuffer(b"".join(lead + t + b"\0" for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + DEPTH + 1
    starts = np.cumsum(sizes) - sizes
    sym = table[joined]
    for k in range(DEPTH):
        sym[starts + k] = END
    sym[starts + sizes - 1] = END
    rare = np.flatnonzero(sym >= SYMBOLS)
    if len(rare):
        second = sym[rare] & np.uint16(SYMBOLS - 1)
        sym[rare] >>= SIX
        sym = np.insert(sym, rare + 1, second)
        starts = starts + np.searchsorted(rare, starts)
    return sym.astype(np.uint8), starts


def _contexts(sym: np.ndarray) -> np.ndarray:
    """The ``DEPTH`` symbols before each place from ``DEPTH`` on, as a number, the latest lowest."""
    n = len(sym) - DEPTH
    code = np.zeros(max(n, 0), np.uint32)
    for k in range(DEPTH):
        code = code << np.uint32(SIX) | sym[k:k + n]
    return code


def _real(starts: np.ndarray, n: int) -> np.ndarray:
    """Places of a text's own symbols and its end, not of the ends put before it."""
    real = np.ones(n, bool)
    for k in range(DEPTH):
        real[starts + k] = False
    return real


def gram_counts(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """(gram, n): every context of ``DEPTH`` symbols with the next one lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts = [], []
            for part in steps(batch):
                words = [b" ".join(t.lower().split()) for t in as_bytes(part.column("text"))]
                sym, starts = _laid_out(words, table)
                gram = np.sort((_contexts(sym) << np.uint32(SIX) | sym[DEPTH:])[_real(starts, len(sym))[DEPTH:]])
                first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))[: len(gram)]
                grams.append(gram[first])
                counts.append(np.diff(np.append(first, len(gram))))
            if grams:
                keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
                total = np.bincount(inverse, np.concatenate(counts), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(total)], ["gram", "n"])

    return texts.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """``contexts`` held here by length, and log10 probabilities of the symbols by state; ``beyond`` has a bit for each further context."""

    table: np.ndarray
    contexts: list[np.ndarray]
    logs: np.ndarray
    beyond: list[np.ndarray] | None = None

    def states(self) -> np.ndarray:
        """The state of each context of full depth: its longest kept suffix, -1 if that isn't held here."""
        out = np.zeros(SYMBOLS ** DEPTH, np.int32)
        number = 1
        for length, kept in enumerate(self.contexts, 1):
            view = out.reshape(-1, SYMBOLS ** length)
            view[:, kept] = np.arange(number, number + len(kept), dtype=np.int32)
            if self.beyond:
                view[:, np.flatnonzero(np.unpackbits(self.beyond[length - 1], bitorder="little"))] = -1
            number += len(kept)
        return out


def _levels(grams: DataFrame) -> list[DataFrame]:
    """(context, symbol, n) for contexts of length 0 to ``DEPTH``."""
    out = []
    for length in range(DEPTH + 1):
        low = (1 << SIX * (length + 1)) - 1
        key = F.col("gram").bitwiseAND(low)
        out.append(
            grams.groupBy(F.shiftright(key, SIX).alias("context"), key.bitwiseAND(SYMBOLS - 1).alias("symbol")).agg(F.sum("n").alias("n"))
        )
    return out


def fit(texts: DataFrame, states: int | None = None) -> Tree:
    """The tree of :func:`grown`, without what it doesn't hold."""
    return grown(texts, states)[0]


def grown(texts: DataFrame, states: int | None = None) -> tuple[Tree, Callable[[DataFrame], DataFrame] | None]:
    """Counts the corpus, and grows the tree; and, if it doesn't hold all contexts, what makes (gram, log) of any ``(gram)``."""
    states = STATES if states is None else states
    table = symbols(byte_counts(texts))
    grams, seen = stage(gram_counts(texts, table), "grams", all=F.sum("n"))
    cost = 0.5 * np.log(max(seen["all"] or 0, 2))
    levels = _levels(grams)
    gains = None
    for length in range(1, DEPTH + 1):
        up = levels[length - 1].select(F.col("context").alias("parent"), "symbol", F.col("n").alias("m"))
        own = levels[length].withColumn("parent", F.col("context").bitwiseAND((1 << SIX * (length - 1)) - 1)).join(up, ["parent", "symbol"])
        above = up.groupBy("parent").agg(F.sum("m").alias("all"))
        gain = own.groupBy("parent", "context").agg(
            F.sum(F.col("n") * F.log(F.col("n") / F.col("m"))).alias("part"), F.sum("n").alias("own"), F.count(F.lit(1)).alias("k")
        ).join(above, "parent")
        gain = gain.select(
            F.lit(length).alias("length"), "context",
            ((F.col("part") - F.col("own") * F.log(F.col("own") / F.col("all"))) / (F.col("k") * cost)).alias("gain"),
        ).where("gain >= 1")
        gains = gain if gains is None else gains.unionByName(gain)
    gains, _ = stage(gains, "gains")
    binned = gains.groupBy(F.floor(F.log2("gain") * 4).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("bin").desc()).collect()
    least, held = 0, 0
    for r in binned:
        held += r["n"]
        if held * DEPTH > states:  # suffixes come on top
            least = r["bin"] + 1
            break
    passed = gains.where(F.floor(F.log2("gain") * 4) >= least).toArrow()
    length, context = passed.column("length").to_numpy(), passed.column("context").to_numpy()
    kept = [
        np.unique(np.concatenate([context[length == k] & (1 << SIX * d) - 1 for k in range(d, DEPTH + 1)])).astype(np.int64)
        for d in range(1, DEPTH + 1)
    ]
    logs = [_root(levels[0])]
    for d in range(1, DEPTH + 1):
        ids = texts.sparkSession.createDataFrame(pa.table({"context": pa.array(kept[d - 1], pa.int64())}))
        counts = levels[d].join(ids, "context").toArrow()
        n = np.zeros((len(kept[d - 1]), SYMBOLS))
        n[np.searchsorted(kept[d - 1], counts.column("context").to_numpy()), counts.column("symbol").to_numpy()] = counts.column("n").to_numpy()
        parent = np.zeros(len(kept[d - 1]), np.int64) if d == 1 else np.searchsorted(kept[d - 2], kept[d - 1] & (1 << SIX * (d - 1)) - 1)
        logs.append((n + WEIGHT * logs[-1][parent]) / (n.sum(axis=1, keepdims=True) + WEIGHT))
    tree = Tree(table, kept, np.log10(np.concatenate(logs)).astype(np.float32))
    if not least:
        return tree, None
    suffix = F.expr(f"inline(transform(sequence(1, length), d -> struct(d as length, context & (shiftleft(1L, {SIX} * d) - 1) as context)))")
    every, _ = stage(gains.select(suffix).distinct(), "contexts")
    tree.beyond = _bits(every)
    for bits, held_here in zip(tree.beyond, kept):
        np.bitwise_and.at(bits, held_here >> 3, ~(1 << (held_here & 7)).astype(np.uint8))
    root = logs[0][0].tolist()
    return tree, lambda grams: _joined_logs(grams, levels, every, root)


#: Bits of one row of a bit table.
ROW_BITS = 1 << 15


def _bits(contexts: DataFrame) -> list[np.ndarray]:
    """A bit for each of ``contexts(length, context)``, lowest first, by length."""
    out = [np.zeros(max(SYMBOLS ** d, ROW_BITS) // 8, np.uint8) for d in range(1, DEPTH + 1)]
    rows = contexts.groupBy("length", F.expr(f"context div {ROW_BITS}").alias("row")).agg(F.expr(f"bitmap_construct_agg(context % {ROW_BITS})").alias("bits"))
    for r in rows.toLocalIterator():
        bits = np.frombuffer(r["bits"], np.uint8)
        out[r["length"] - 1][r["row"] * len(bits):(r["row"] + 1) * len(bits)] = bits
    return [bits[:SYMBOLS ** d // 8] for d, bits in enumerate(out, 1)]


def _joined_logs(grams: DataFrame, levels: list[DataFrame], contexts: DataFrame, root: list[float]) -> DataFrame:
    """(gram, log): log10 probability of the last symbol of each ``grams(gram)`` after its longest suffix in ``contexts``."""
    symbol = F.col("gram").bitwiseAND(SYMBOLS - 1)
    out = grams.select("gram", symbol.alias("symbol"), F.get(F.lit(root), symbol.cast("int")).alias("p"))
    for d in range(1, DEPTH + 1):
        all_of = levels[d].groupBy("context").agg(F.sum("n").alias("all"))
        all_of = all_of.join(contexts.where(F.col("length") == d).select("context"), "context", "left_semi")
        out = out.withColumn("context", F.shiftright("gram", SIX).bitwiseAND((1 << SIX * d) - 1))
        out = out.join(all_of, "context", "left").join(levels[d], ["context", "symbol"], "left")
        p = F.when(F.col("all").isNull(), F.col("p")).otherwise((F.coalesce("n", F.lit(0)) + WEIGHT * F.col("p")) / (F.col("all") + WEIGHT))
        out = out.select("gram", "symbol", p.alias("p"))
    return out.select("gram", F.log10("p").alias("log"))


def _root(level: DataFrame) -> np.ndarray:
    n = np.zeros(SYMBOLS)
    for r in level.collect():
        n[r["symbol"]] = r["n"]
    return ((n + 0.5) / (n.sum() + 0.5 * SYMBOLS))[None, :]


def text_scores(texts: list[bytes], tree: Tree, states: np.ndarray) -> np.ndarray:
    """log10 probability of each text (words already joined), end included, without places that end in a context ``beyond``."""
    return _scored(texts, tree, states)[0]


def _scored(texts: list[bytes], tree: Tree, states: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same, with each text's grams at the other places: ``GRAM`` low bits, and above how often."""
    sym, starts = _laid_out(texts, tree.table)
    context = _contexts(sym)
    at = states[context].astype(np.int64)
    real = _real(starts, len(sym))
    value = np.zeros(len(sym))
    value[DEPTH:] = np.where(at < 0, 0, tree.logs.ravel()[at * SYMBOLS + sym[DEPTH:]])
    value[~real] = 0
    far = [np.empty(0, np.int64)] * len(texts)
    if tree.beyond:
        place = np.flatnonzero((at < 0) & real[DEPTH:])
        gram = context[place].astype(np.int64) << SIX | sym[DEPTH:][place]
        for i, own in enumerate(np.split(gram, np.searchsorted(place + DEPTH, starts[1:]))):
            keys, n = np.unique(own, return_counts=True)
            far[i] = n << GRAM | keys
    return np.add.reduceat(value, starts) if len(starts) else np.empty(0), far


def scores(
    docs: DataFrame, words: DataFrame, n_all: int, n_words: int, tree: Tree, joined_logs: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of ``docs(doc_id, text)``; ``joined_logs`` as from :func:`grown`."""
    spark = docs.sparkSession
    level = F.floor(F.log2(F.col("n")) * 8)
    binned = words.groupBy(level.alias("bin")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("bin").desc()).collect()
    least, held = -1, 0
    for r in binned:
        held += r["k"]
        if held > FREQUENT:
            least = r["bin"] + 1
            break
    top = words.where(level >= least).orderBy("word").toArrow()
    frequent = top.column("word").to_numpy(), top.column("n").to_numpy()
    shared = spark.sparkContext.broadcast({"tree": vars(tree), "words": frequent})
    norm = n_all + 0.5 * (n_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # a worker keeps it, and with it the table of states
        tree = Tree(**held["tree"])
        if "states" not in held:
            held["states"] = tree.states()
        states, (keys, counts) = held["states"], held["words"]
        known: dict[bytes, int] = {}  # count of a frequent word, else -1

        def learn(new: list[bytes]) -> None:
            if len(known) > HELD:
                known.clear()
            h = _hash(new)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            n = np.where(keys[at] == h, counts[at], -1) if len(keys) else np.full(len(new), -1)
            known.update(zip(new, n.tolist()))

        for batch in batches:
            for part in steps(batch, limit=1 << 20):
                split = [[*t.lower().split(), _END_WORD] for t in as_bytes(part.column("text"))]
                learn(list(set().union(*split)))
                sizes = np.array([len(w) for w in split])
                count = np.fromiter((known[w] for ws in split for w in ws), np.int64, sizes.sum())
                at = np.cumsum(sizes) - sizes
                base = np.add.reduceat(np.where(count >= 0, np.log10((np.maximum(count, 0) + 0.5) / norm), 0.0), at)
                seen = np.add.reduceat((count > 0).astype(np.int64), at)
                rest = [_hash([w for w in ws if known[w] < 0]) for ws in split]
                offsets = np.cumsum([0, *map(len, rest)])
                score, far = _scored([b" ".join(ws[:-1]) for ws in split], tree, states)
                ends = np.cumsum([0, *map(len, far)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(seen), pa.array(base),
                        pa.array(score), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rest))),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(far))),
                    ],
                    ["doc_id", "n_tokens", "seen", "base", "score", "rest", "far"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, seen bigint, base double, score double, rest array<bigint>, far array<bigint>"
    rows, _ = stage(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rest").alias("word")).join(words, "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.log10((n + 0.5) / norm)).alias("more"), F.sum((n > 0).cast("long")).alias("also"))
    if joined_logs:
        far = rows.select("row", F.explode("far").alias("v")).select(
            "row", F.col("v").bitwiseAND((1 << GRAM) - 1).alias("gram"), F.shiftright("v", GRAM).alias("times"))
        more = far.join(joined_logs(far.select("gram").distinct()), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("_far"))
        rows = rows.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("_far", F.lit(0.0)))
    return rows.drop("rest", "far").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("seen") + F.coalesce("also", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def learned_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by what the training documents teach, with ``train_tokens``."""
    texts = training(docs)
    words, seen = stage(word_counts(texts), "words", all=F.sum("n"))
    n_all = int(seen["all"] or 0)
    return scores(docs, words, n_all, seen["rows"], *grown(texts)).withColumn("train_tokens", F.lit(n_all).cast("long"))
