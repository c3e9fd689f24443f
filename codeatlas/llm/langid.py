"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy.

Subwords are the 2- to 4-byte strings of the folded text (A-Z lowered, other ASCII characters than letters as
space), hashed to ``1 << BITS`` buckets. A text's vector is the mean of its subwords' embeddings, and the softmax is
linear, so a trained model is one row of logits per bucket: scoring adds up rows, a scan without a shuffle. The temperature
is fitted on rows kept apart, and so is the score below which a prediction is to be rejected.

The model learns from a bounded sample (``sample.SAMPLE`` rows over all languages, spread evenly), from segments of
``SEGMENT`` bytes drawn from all of a text.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is everything when nothing could be
learned; repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, remainder, steps
from .sample import chosen, short_texts

BITS = 16
WIDTH = 16
SEGMENT = 200
SEGMENTS = 3
EPOCHS = 4
RATE = 0.5
#: Share of accepted predictions that must be right.
RIGHT = 0.995

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalpha():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray
    temperature: float
    least: float


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every subword; none reaches over the end of its row."""
    text = np.concatenate((_FOLD[data], np.zeros(4, np.uint8)))
    word = np.ndarray((len(data),), "<u4", text, strides=(1,))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = offsets[1:][row] - np.arange(len(data)) if len(data) else np.empty(0, np.int64)
    found, rows = [], []
    for n in (2, 3, 4):
        code = word & np.uint32((1 << 8 * n) - 1) if n < 4 else word
        good = (left >= n) & (code != np.uint32(0x20202020 & (1 << 8 * n) - 1))
        mixed = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
        mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA77)
        found.append((mixed >> np.uint32(32 - BITS))[good])
        rows.append(row[good])
    return np.concatenate(found), np.concatenate(rows)


def sums(values: np.ndarray, bucket: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of ``values[bucket]`` per row, and how many there are."""
    count = np.bincount(row, minlength=n)
    total = np.stack([np.bincount(row, values[:, k][bucket], n) for k in range(values.shape[1])], axis=1)
    return total / np.maximum(count, 1)[:, None], count


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _segments(texts: list[bytes], rng: np.random.Generator) -> tuple[list[bytes], list[int]]:
    out, of = [], []
    for i, t in enumerate(texts):
        starts = range(0, max(len(t) - SEGMENT // 2, 1), SEGMENT)
        for k in rng.permutation(len(starts))[:SEGMENTS]:
            out.append(t[starts[k]:starts[k] + SEGMENT])
            of.append(i)
    return out, of


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Model | None:
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    apart = rng.random(len(y)) < 0.2
    if apart.all() or not apart.any() or len(y) < 20:
        apart[:] = False
    pieces, of = _segments([t for t, a in zip(texts, apart) if not a], rng)
    target = y[~apart][of]
    bucket, row = buckets(*_pack(pieces))
    order = np.argsort(row, kind="stable")
    bucket, bounds = bucket[order], np.searchsorted(row[order], np.arange(len(pieces) + 1))
    size, k = 1 << BITS, len(langs)
    e = rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32)
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(len(pieces))
        for at in range(0, len(shuffled), 64):
            some = shuffled[at:at + 64]
            ids = [bucket[bounds[i]:bounds[i + 1]] for i in some]
            n = np.maximum([len(x) for x in ids], 1)
            h = np.stack([e[x].sum(axis=0) for x in ids]) / n[:, None]
            p = softmax(h @ w)
            p[np.arange(len(some)), target[some]] -= 1
            rate = RATE * (1 - epoch / EPOCHS)
            back = (p @ w.T) / n[:, None] * rate * 10
            w -= rate * (h.T @ p) / len(some)
            flat = np.concatenate(ids)
            of_row = np.repeat(np.arange(len(some)), [len(x) for x in ids])
            keys, inverse = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(inverse, back[:, j][of_row], len(keys)) for j in range(WIDTH)], axis=1)
            e[keys] -= step.astype(np.float32)
    logits = e @ w
    held = [t for t, a in zip(texts, apart) if a] or texts
    truth = y[apart] if apart.any() else y
    mean, _ = sums(logits, *buckets(*_pack(held)), len(held))
    loss = lambda t: -np.log(softmax(mean * t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min((float(t) for t in np.geomspace(0.25, 64, 33)), key=loss)
    p = softmax(mean * temperature)
    order = np.argsort(-p.max(axis=1))
    right = np.cumsum(p.argmax(axis=1)[order] == truth[order]) / np.arange(1, len(truth) + 1)
    good = np.flatnonzero(right >= RIGHT)
    return Model(langs, logits.astype(np.float32), temperature, float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0)


def fit(docs: DataFrame) -> Model | None:
    """Learns from the documents with a language that aren't held out (crc32 of the id mod 4 is 2)."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = short_texts(chosen(rows.where(remainder(F.col("doc_id"), 4) != 2), "lang")[0])
    return train([t.encode() for t in found.column("text").to_pylist()], found.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of ``docs(doc_id, text)``; reads nothing else."""
    texts = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return texts.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for part in steps(batch, limit=1 << 20):
                data, offsets = packed(part.column("text"))
                mean, count = sums(m.logits, *buckets(data, offsets), part.num_rows)
                p = softmax(mean * m.temperature)
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                best = np.where(letters, p.argmax(axis=1), len(m.langs))
                score = np.where(letters, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(letters & (score >= m.least))],
                    ["doc_id", "lang_pred", "score", "accepted"],
                )

    return texts.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, accepted boolean")
