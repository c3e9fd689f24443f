"""Toxicity: a convolutional text classifier trained in numpy.

A word (lowered, outer punctuation stripped) has two hashed embeddings, of itself and of its first ``STEM`` characters. Filters of
several widths run over them, the maximum over the text goes into a logistic unit. One dimension of an embedding starts as
the log-odds of its bucket in toxic texts; words never seen stay zero, so they don't matter. A filter is linear before its maximum,
so a trained model is a table of what a bucket adds to each filter at each of its places: scoring gathers rows of
two tables and takes maxima, in one scan without a shuffle.

All labelled rows take part, and training is spread over the tasks that read them. Log-odds are counted over three
quarters of them; in every epoch each task steps through its own of these rows, and what it changed is averaged with the others' changes, by
rows. The score is calibrated on the last quarter to the share of toxic rows among all labels; on the same rows a
threshold is found for every language, and one over all for others: there scores are counted in bins of 1 / ``FINE``. What reaches the driver is as
large as the model, whatever the data. Language is never an input of a score.

Defined cases: null and empty texts are scored like a text without words, and nothing is learned from null; without labels of both kinds every
score is the share of toxic labels (0 with none); repeated rows are scored each for itself; of several labels of an id all count.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import as_bytes, remainder, steps

BITS = 18, 16
STEM = 5
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
RATE = 0.05
#: Rows that a task of an epoch has at least: fewer rows are learned from by fewer tasks.
OWN_ROWS = 2000
#: How much more than an average row one of the rarer label may count in a step.
HEAVIEST = 10.0
#: Bins of a score to one unit of log-odds.
FINE = 64
PREDICT = 0.3
#: Words whose buckets a task remembers.
REMEMBERED = 1 << 19

_OUTER = string.punctuation.encode()


@dataclass
class Model:
    """``rows`` are the embeddings of the buckets ``at``, of both tables one after the other; ``dense`` holds the layers."""

    at: np.ndarray
    rows: np.ndarray
    dense: np.ndarray
    scale: tuple[float, float]
    thresholds: dict
    overall: float

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a bucket adds to each filter at each of its places."""
        filters = np.concatenate([filt[k] for filt in _layers(self.dense)[0] for k in range(len(filt))], axis=1)
        every = np.zeros((sum(1 << b for b in BITS), filters.shape[1]), np.float32)
        every[self.at] = self.rows @ filters
        return every[:1 << BITS[0]], every[1 << BITS[0]:]


class Words(dict):
    """Both buckets of a word, as one number."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_OUTER) or word
        value = (zlib.crc32(bare) >> 32 - BITS[0]) << BITS[1] | zlib.crc32(bare[:STEM], 1) >> 32 - BITS[1]
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _split(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids >> BITS[1], ids & (1 << BITS[1]) - 1


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _pooled(ids: np.ndarray, e: tuple, w: list, bias: np.ndarray):
    """Maxima of all filters over one text, and where they are. Missing words at the end count as zero."""
    a, b = _split(ids)
    x = np.concatenate((e[0][a] + e[1][b], np.zeros((max(WIDTHS) - 1 + (not len(ids)), DIM), np.float32)))
    top, at = [], []
    for width, filt in zip(WIDTHS, w):
        n = len(x) - width + 1
        z = sum(x[k:k + n] @ filt[k] for k in range(width))
        at.append(z.argmax(axis=0))
        top.append(z[at[-1], np.arange(FILTERS)])
    return np.concatenate(top) + bias, np.concatenate(at), x


def _texts(rows: DataFrame, each, schema: str) -> DataFrame:
    """What ``each(parts)`` makes of a task's rows, handed over as (word buckets of some texts, labels, languages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        yield from each(
            ([words.of(t) for t in as_bytes(part.column("text"))], part.column("toxic").to_numpy(zero_copy_only=False), part.column("lang"))
            for batch in batches for part in steps(batch, limit=1 << 20))

    return rows.select("text", "toxic", "lang").mapInArrow(run, schema)


def _log_odds(rows: DataFrame, n: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket, both tables one after the other: its log-odds in toxic texts (0 if in one text only), and whether it occurs."""
    size = sum(1 << b for b in BITS)

    def count(parts):
        found = np.zeros((2, size), np.int64)
        for ids, toxic, _ in parts:
            for x, label in zip(ids, toxic):
                a, b = _split(x)
                found[label, np.unique(a)] += 1
                found[label, np.unique(b) + (1 << BITS[0])] += 1
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[0, at]), pa.array(found[1, at])], ["bucket", "other", "toxic"])

    sums = _texts(rows, count, "bucket bigint, other bigint, toxic bigint").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    other, toxic = np.zeros(size), np.zeros(size)
    at = sums.column("bucket").to_numpy()
    other[at], toxic[at] = sums.column("other").to_numpy(), sums.column("toxic").to_numpy()
    odds = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((other + 0.5) / (n[0] + 1))
    return np.where(toxic + other > 1, odds, 0), toxic + other > 0


def _layers(dense: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Views of the filters, their biases and the logistic unit in one vector."""
    w, at = [], 0
    for width in WIDTHS:
        w.append(dense[at:at + width * DIM * FILTERS].reshape(width, DIM, FILTERS))
        at += width * DIM * FILTERS
    n = FILTERS * len(WIDTHS)
    return w, dense[at:at + n], dense[at + n:at + 2 * n + 1]


_DENSE = -(-(sum(WIDTHS) * DIM * FILTERS + 2 * FILTERS * len(WIDTHS) + 1) // DIM) * DIM


def _tables(buckets: np.ndarray) -> tuple[list, list]:
    """Views of both embeddings, and of the sums of their squared slopes, in one table."""
    cut = 1 << BITS[0]
    return [buckets[:cut, :DIM], buckets[cut:, :DIM]], [buckets[:cut, DIM], buckets[cut:, DIM]]


def _step(ids: np.ndarray, label: int, weight: float, rate: float, buckets: np.ndarray, dense: np.ndarray) -> None:
    """One step down the slope of one text, in place."""
    (e, grow), (w, bias, out) = _tables(buckets), _layers(dense)
    z, at, x = _pooled(ids, e, w, bias)
    h = np.maximum(z, 0)
    error = weight * float(_sigmoid(h @ out[:-1] + out[-1]) - label)
    back = np.where(z > 0, error * out[:-1], 0)
    out[:-1] -= rate * error * h
    out[-1] -= rate * error
    bias -= rate * back
    for i, (width, filt) in enumerate(zip(WIDTHS, w)):
        mine, place = back[i * FILTERS:(i + 1) * FILTERS], at[i * FILTERS:(i + 1) * FILTERS]
        for t in range(width):
            on = np.flatnonzero((mine != 0) & (place + t < len(ids)))
            if not len(on):
                continue
            slope = mine[on, None] * filt[t][:, on].T
            filt[t][:, on] -= rate * (mine[on, None] * x[place[on] + t]).T
            for table, g, at_ in zip(e, grow, _split(ids[place[on] + t])):
                np.add.at(g, at_, (slope * slope).sum(axis=1))
                np.subtract.at(table, at_, rate * slope / np.sqrt(g[at_])[:, None])


def _epoch(rows: DataFrame, buckets: np.ndarray, dense: np.ndarray, weights: tuple[float, float], rate: float, seed: int) -> None:
    """Every task steps through its rows from the same model; their changes, averaged by rows over the tasks that made them, are added to it."""
    seen = np.flatnonzero(buckets.any(axis=1))  # others can't change
    shared = rows.sparkSession.sparkContext.broadcast((seen, buckets[seen], dense))
    size, names = buckets.shape, [f"v{k}" for k in range(DIM + 1)]

    def learn(parts):
        seen, known, before = shared.value
        own, layers = np.zeros(size, np.float32), before.copy()
        own[seen] = known
        rng, n = np.random.default_rng(seed), 0
        for ids, toxic, _ in parts:
            for i in rng.permutation(len(ids)):
                _step(ids[i], toxic[i], weights[toxic[i]], rate, own, layers)
            n += len(ids)
        if n:
            own[seen] -= known
            at = np.flatnonzero(own.any(axis=1))
            more = np.zeros((_DENSE // DIM, DIM + 1))
            more[:, :DIM] = (layers - before).reshape(-1, DIM)
            change = n * np.concatenate((own[at].astype(float), more))
            at = np.concatenate((at, len(own) + np.arange(len(more))))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), n)), *[pa.array(c) for c in change.T.copy()]], ["at", "n", *names])

    changed = _texts(rows, learn, "at bigint, n bigint, " + ", ".join(f"{c} double" for c in names))
    sums = changed.groupBy("at").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).toArrow()
    shared.destroy()
    at = sums.column("at").to_numpy()
    mean = np.stack([sums.column(c).to_numpy() for c in names], axis=1) / sums.column("n").to_numpy()[:, None]
    inner = at < len(buckets)
    buckets[at[inner]] += mean[inner].astype(np.float32)
    dense.reshape(-1, DIM)[at[~inner] - len(buckets)] += mean[~inner, :DIM].astype(np.float32)


def train(rows: DataFrame, counts: dict, seed: int = 11) -> Model | None:
    """The model of all ``rows(doc_id, text, lang, toxic)``, which are read several times; ``counts`` of both labels, texts or not."""
    rows = rows.withColumn("apart", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    n = {(r["apart"], r["toxic"]): r["n"] for r in rows.groupBy("apart", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda label: n.get((True, label), 0) + n.get((False, label), 0)
    if not of(0) or not of(1):
        return None
    learn = held = rows
    m = of(0), of(1)
    if len(n) == 4:
        learn, held, m = rows.where("not apart"), rows.where("apart"), (n[False, 0], n[False, 1])
    rng = np.random.default_rng(seed)
    odds, seen = _log_odds(learn, m)
    buckets = np.zeros((len(odds), DIM + 1), np.float32)
    buckets[seen, :DIM] = rng.normal(0, 0.02, (int(seen.sum()), DIM))
    buckets[seen, 0], buckets[seen, DIM] = odds[seen], 1e-3
    dense = np.zeros(_DENSE, np.float32)
    w, bias, out = _layers(dense)
    for filt in w:
        filt[:] = rng.normal(0, 0.1, filt.shape)
        filt[:, 0, :] += 0.5 / len(filt)
    bias[:], out[:] = -1.0, 0.1
    weights = tuple(min(HEAVIEST, sum(m) / (2 * k)) for k in m)
    own = learn.coalesce(max(1, sum(m) // OWN_ROWS))
    for epoch in range(EPOCHS):
        _epoch(own, buckets, dense, weights, RATE * (1 - epoch / EPOCHS), seed + epoch)
    at = np.flatnonzero(seen)
    return _calibrated(Model(at, buckets[at, :DIM], dense, (1.0, 0.0), {}, PREDICT), held, counts)


def _calibrated(model: Model, held: DataFrame, counts: dict) -> Model:
    """The model with its scale and thresholds, from counts of all ``held`` rows by language and fine bins of their scores."""
    shared = held.sparkSession.sparkContext.broadcast(vars(model))

    def raw(parts):
        m = Model(**shared.value)
        for ids, toxic, lang in parts:
            yield pa.RecordBatch.from_arrays([lang, pa.array(toxic), pa.array(raw_scores(m, ids).astype(float))], ["lang", "toxic", "raw"])

    bins = _texts(held, raw, "lang string, toxic int, raw double").groupBy("lang", F.floor(F.col("raw") * FINE).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"), F.sum("raw").alias("raw"), F.min("raw").alias("least"))
    bins, _ = stage(bins, "toxicity-bins")
    shared.destroy()

    def columns(df: DataFrame) -> list[np.ndarray]:
        t = df.orderBy("least").toArrow()
        return [t.column(c).to_numpy().astype(float) for c in ("n", "toxic", "raw", "least")]

    every = bins.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "raw")], F.min("least").alias("least"))
    n, toxic, total, least = columns(every)
    share = counts.get(0, 0) / max((n - toxic).sum(), 1), counts.get(1, 0) / max(toxic.sum(), 1)
    weight = lambda n, toxic: (share[0] * (n - toxic), share[1] * toxic)
    other, hits = weight(n, toxic)
    whole = (other + hits).sum()
    mean, a, b = total / n, 1.0, 0.0
    for _ in range(500):
        slope = (_sigmoid(a * mean + b) * (other + hits) - hits) / whole
        a, b = a - 0.5 * (float(slope @ mean) + 1e-4 * a), b - 2.0 * float(slope.sum())
    model.scale = max(a, 1e-3), b
    score = lambda raw: _sigmoid(model.scale[0] * raw + model.scale[1])
    model.overall = _threshold(score(least), other, hits)
    langs = bins.where("lang <> ''").groupBy("lang").agg(F.sum("toxic").alias("toxic")).where("toxic >= 10")
    found = bins.join(langs.select("lang"), "lang").select("lang", "n", "toxic", "least").toPandas()
    for lang, rows in found.groupby("lang"):
        model.thresholds[lang] = _threshold(score(rows["least"].to_numpy()), *weight(rows["n"].to_numpy(), rows["toxic"].to_numpy()))
    return model


def _threshold(p: np.ndarray, other: np.ndarray, toxic: np.ndarray) -> float:
    """The score with the best F1 of toxic rows."""
    order = np.argsort(-p)
    hits, taken = np.cumsum(toxic[order]), np.cumsum((toxic + other)[order])
    f1 = 2 * hits / (taken + toxic.sum())
    return float(p[order][int(f1.argmax())])


def raw_scores(m: Model, ids: list[np.ndarray]) -> np.ndarray:
    """Uncalibrated log-odds of some texts."""
    _, bias, out = _layers(m.dense)
    pad = max(WIDTHS)
    size = np.array([len(x) for x in ids])
    starts = np.concatenate(([0], np.cumsum(size + pad)))
    used = np.zeros(starts[-1], bool)
    row = np.repeat(np.arange(len(ids)), size)
    place = np.arange(size.sum()) - (np.cumsum(size) - size)[row] + starts[row]
    a, b = _split(np.concatenate(ids) if ids else np.empty(0, np.int64))
    x = np.zeros((starts[-1], m.tables[0].shape[1]), np.float32)
    x[place] = m.tables[0][a] + m.tables[1][b]
    tops, column = [], 0
    for width in WIDTHS:
        z = np.zeros((starts[-1], FILTERS), np.float32)
        for k in range(width):
            z[:len(z) - k] += x[k:, column:column + FILTERS]
            column += FILTERS
        tops.append(np.maximum.reduceat(z, starts[:-1], axis=0))
    h = np.maximum(np.concatenate(tops, axis=1) + bias, 0)
    return h @ out[:-1] + out[-1]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    """The model and the share of toxic labels, from all rows that aren't held out (crc32 of the id mod 4 is 2).

    Texts and labels meet once; what they make together is written for the passes of the training.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(remainder(F.col("doc_id"), 4) != 2)
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return None, base
    texts = docs.select("doc_id", "text", "lang").where("text is not null").where(remainder(F.col("doc_id"), 4) != 2)
    # Labels grow with the documents, so they aren't broadcast while they are few either: disk is in proportion to the input at any size.
    # A shuffled task's rows are put in order of id again, as tables have them: training depends on the order of rows.
    rows, _ = stage(texts.hint("merge").join(marked, "doc_id").sortWithinPartitions("doc_id"), "toxicity-rows")
    return train(rows, counts), base


def score(docs: DataFrame, model: Model | None, base: float) -> DataFrame:
    """(doc_id, lang, score) of ``docs(doc_id, text, lang)``; the language is only passed on."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", "lang", F.lit(float(base)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = Model(**shared.value), Words()
        for batch in batches:
            for part in steps(batch, limit=1 << 20):
                raw = raw_scores(m, [words.of(t) for t in as_bytes(part.column("text"))])
                p = _sigmoid(m.scale[0] * raw.astype(float) + m.scale[1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(p)], ["doc_id", "lang", "score"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {id_type}, lang string, score double")


def flagged(scores: DataFrame, model: Model | None) -> DataFrame:
    """``scores`` with ``threshold`` (of the row's language) and ``flagged``."""
    known = (model.thresholds if model else {}) or {"": 2.0}
    by = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
    limit = F.coalesce(F.try_element_at(by, F.col("lang")), F.lit(model.overall if model else 2.0))
    return scores.withColumn("threshold", limit).withColumn("flagged", F.col("score") >= F.col("threshold"))
