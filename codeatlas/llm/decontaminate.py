"""Benchmark decontamination by the q-gram lemma.

Texts are compared lower-cased (A-Z), with every run of other ASCII characters than letters and digits as one space. The windows
of an item are all its substrings of ``WINDOW`` and of ``PASSAGE`` bytes, at every offset, and the whole item where it is shorter
than ``WINDOW``. A document is contaminated by a window if some substring is within ``k = ERROR * length`` edits of it.
So every copied passage of ``PASSAGE`` bytes or more is found wherever it lies in the item, with up to 2 edits in
``PASSAGE`` bytes or 5 in ``WINDOW``; a longer passage is found by any such part of it. An item under
``MIN_CHARS`` is found where it stands exactly, as whole words.

The index holds every q-gram of the items once. An occurrence with k edits keeps at least ``length - q + 1 - k * q`` of the
window's q-grams, and its diagonals lie within a range of 2k + 1, so in one of the overlapping bands of twice that
width. In each band the q-grams are sorted by their offset in the item; windows that hold fewer of them are dropped, the others are
verified by alignment within the band. The filter is exact for windows at every offset. Overlapping verified windows are one region.

The items are read in blocks of bounded size; each block's index is broadcast and all documents are scanned for it. A scan is
row-local: no shuffle, and a document's size bounds what a task holds.

Defined cases: null or empty texts, and items without letters or digits, have no matches; repeated documents or items
come back repeated; with no items the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, steps

Q = 12
WINDOW = 100
PASSAGE = 50
ERROR = 0.05
MIN_CHARS = 24
#: Bytes of item text in one block; the index of a block takes about 20 times as much.
BLOCK_BYTES = 1 << 20
#: Bytes of documents looked at in one step, and windows aligned in one.
STEP = 1 << 20
ALIGNED = 1 << 18

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128 or _c >= 128:
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_SPREAD = 22
_COST = 1 << 40


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all rows, where each came from, and where each row starts in them (one more for the end)."""
    folded = _FOLD[data]
    space = folded == 32
    before = np.empty_like(space)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    origin = np.flatnonzero(~(space & before))
    return folded[origin], origin, np.searchsorted(origin, offsets)


def codes(text: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit code of the q-gram (8 <= q <= 16) at each place; different q-grams may share one."""
    n = len(text) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), strides=(1,))
    mixed = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[q - 8:q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)


def tiers(length: int, q: int = Q, window: int = WINDOW, error: float = ERROR) -> list[tuple[int, int]]:
    """(size, edits) of the windows of an item."""
    sizes = sorted({min(window, length), min(PASSAGE, window, length)})
    return [(size, min(int(error * size), (size - q) // q)) for size in sizes]


@dataclass
class Block:
    """Folded items one after the other, their q-grams by code, and the short items by length."""

    ids: list
    number: np.ndarray  # index of each long item in ids
    text: np.ndarray
    starts: np.ndarray
    tier: dict[tuple[int, int], np.ndarray]  # which long items have windows of (size, edits)
    code: np.ndarray
    at: np.ndarray  # place of the q-gram in text
    seen: np.ndarray
    short: dict[int, dict[bytes, list[int]]]  # length: text, indexes in ids

    def windows(self) -> list[tuple[int, bytes, int]]:
        """(index in ids, text, edits) of everything that is looked for."""
        long = [
            (int(self.number[i]), self.text[at:at + size].tobytes(), k)
            for (size, k), has in self.tier.items() for i in np.flatnonzero(has)
            for at in range(self.starts[i], self.starts[i + 1] - size + 1)
        ]
        return long + [(i, t, 0) for known in self.short.values() for t, items in known.items() for i in items]

    @property
    def item(self) -> list[int]:
        return [w[0] for w in self.windows()]

    @property
    def texts(self) -> list[bytes]:
        return [w[1] for w in self.windows()]

    @property
    def edits(self) -> list[int]:
        return [w[2] for w in self.windows()]


def block(rows: list[tuple], q: int = Q, window: int = WINDOW, error: float = ERROR, least: int = MIN_CHARS) -> Block | None:
    number, texts, short = [], [], {}
    for i, (_, text) in enumerate(rows):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        folded = normal(raw, np.array([0, len(raw)]))[0].tobytes().rstrip(b" ")
        if len(folded) >= max(least, q):
            number.append(i)
            texts.append(folded)
        elif folded:
            short.setdefault(len(folded), {}).setdefault(folded, []).append(i)
    if not texts and not short:
        return None
    tier: dict[tuple[int, int], np.ndarray] = {}
    for i, t in enumerate(texts):
        for kind in tiers(len(t), q, window, error):
            tier.setdefault(kind, np.zeros(len(texts), bool))[i] = True
    parts = [codes(np.frombuffer(t, np.uint8), q) for t in texts]
    starts = np.cumsum([0, *map(len, texts)])
    code = np.concatenate([np.empty(0, np.uint64), *parts])
    at = np.concatenate([np.empty(0, np.int64), *[s + np.arange(len(p)) for s, p in zip(starts[:-1], parts, strict=True)]])
    order = np.argsort(code, kind="stable")
    seen = np.zeros(1 << _SPREAD, bool)
    seen[code >> np.uint64(64 - _SPREAD)] = True
    text = np.frombuffer(b"".join(texts), np.uint8)
    return Block([r[0] for r in rows], np.array(number, np.int64), text, starts, tier, code[order], at[order], seen, short)


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in runs of at most ``size`` bytes, or one item."""
    rows, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=False):
        more = len((r.text or "").encode())
        if rows and held + more > size:
            yield rows
            rows, held = [], 0
        rows.append((r.item_id, r.text))
        held += more
    if rows:
        yield rows


def shared(text: np.ndarray, starts: np.ndarray, b: Block, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, long item, place in the document, place in the item) of every q-gram that both have."""
    code = codes(text, q)
    at = np.flatnonzero(b.seen[code >> np.uint64(64 - _SPREAD)]) if len(code) else np.empty(0, np.int64)
    low, high = np.searchsorted(b.code, code[at], "left"), np.searchsorted(b.code, code[at], "right")
    times = high - low
    at, low, times = at[times > 0], low[times > 0], times[times > 0]
    entry = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    at = np.repeat(at, times)
    doc = np.searchsorted(starts, at, "right") - 1
    inside = at + q <= starts[doc + 1]
    at, doc, place = at[inside], doc[inside], b.at[entry[inside]]
    item = np.searchsorted(b.starts, place, "right") - 1
    return doc, item, at - starts[doc], place - b.starts[item]


def _first(keys: np.ndarray) -> np.ndarray:
    """Where a column of sorted keys differs from the one before."""
    return np.concatenate((np.ones(min(1, keys.shape[1]), bool), (keys[:, 1:] != keys[:, :-1]).any(axis=0)))


def candidates(hits: tuple, size: int, k: int, b: Block, q: int = Q) -> Iterator[np.ndarray]:
    """(document, item, band, offset) of windows with enough shared q-grams, by the lemma; some at a time."""
    has = b.tier[size, k][hits[1]]
    doc, item, at, offset = (x[has] for x in hits)
    band = np.floor_divide(at - offset + 2 * k, 2 * k + 1)  # an occurrence may begin before its first q-gram's diagonal
    keys = np.stack([np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(offset, 2)])
    keys = keys[:, np.lexsort(keys[::-1])]
    keys = keys[:, _first(keys)]
    need = size - q + 1 - k * q
    i = np.arange(keys.shape[1] - need + 1)
    last = i + need - 1
    i = i[(keys[:3, i] == keys[:3, last]).all(axis=0) & (keys[3, last] - keys[3, i] <= size - q)]
    # Windows whose first q-gram is i and that reach the one at i + need - 1.
    before = np.where(_first(keys[:3])[i], -1, keys[3, i - 1])
    low = np.maximum(np.maximum(before + 1, keys[3, i + need - 1] - (size - q)), 0)
    high = np.minimum(keys[3, i], b.starts[keys[1, i] + 1] - b.starts[keys[1, i]] - size)
    i, low, times = i[high >= low], low[high >= low], (high - low + 1)[high >= low]
    ends = np.cumsum(times)
    start = 0
    while start < len(i):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ALIGNED, "right")))
        some = times[start:stop]
        out = np.repeat(keys[:, i[start:stop]], some, axis=1)
        out[3] = np.repeat(low[start:stop] - np.cumsum(some) + some, some) + np.arange(some.sum())
        yield out
        start = stop


def align(text: np.ndarray, starts: np.ndarray, found: np.ndarray, size: int, k: int, b: Block):
    """Least edits of each candidate window inside its band, and where that substring starts and ends."""
    doc, item, band, offset = found
    cost, begin, end = (np.empty(len(doc), np.int64) for _ in range(3))
    step = 2 * k + 1
    diagonals = np.arange(2 * step)
    slope = diagonals * _COST
    for at in range(0, len(doc), 4096):
        some = slice(at, at + 4096)
        pattern = b.text[(b.starts[item[some]] + offset[some])[:, None] + np.arange(size)]
        lo = band[some] * step - 2 * k + offset[some]
        first = starts[doc[some]][:, None]
        length = starts[doc[some] + 1] - starts[doc[some]]
        place = lo[:, None] + diagonals
        state = np.where((place >= 0) & (place <= length[:, None]), np.clip(place, 0, None), _COST * size * 4)
        for i in range(size):
            spot = place + i
            good = (spot >= 0) & (spot < length[:, None])
            letters = np.where(good, text[np.clip(first + spot, 0, len(text) - 1)], 0)
            same = state + _COST * (letters != pattern[:, i:i + 1])
            same[:, :-1] = np.minimum(same[:, :-1], state[:, 1:] + _COST)
            state = np.minimum.accumulate(same - slope, axis=1) + slope
        best = state.argmin(axis=1)
        value = state[np.arange(len(best)), best]
        cost[some], begin[some] = value // _COST, value % _COST
        end[some] = np.minimum(lo + best + size, length)
    return cost, begin, end


def verified(text: np.ndarray, starts: np.ndarray, hits: tuple, size: int, k: int, b: Block, q: int = Q) -> np.ndarray:
    """(document, index in ids, begin, end, edits) of every window within its edits, once for each place."""
    parts = [np.empty((6, 0), np.int64)]
    for found in candidates(hits, size, k, b, q):
        cost, begin, end = align(text, starts, found, size, k, b)
        parts.append(np.stack([found[0], found[1], found[3], begin, cost, end])[:, cost <= k])
    out = np.concatenate(parts, axis=1)
    out = out[:, np.lexsort(out[::-1])]
    out = out[:, _first(out[:4])]
    # Next to the true diagonal, the neighbouring band sees the same occurrence with more edits.
    near = ~_first(out[:3])[1:] & (np.diff(out[3]) <= 2 * k)
    worse = np.zeros(out.shape[1], bool)
    worse[1:] |= near & (out[4, 1:] > out[4, :-1])
    worse[:-1] |= near & (out[4, :-1] > out[4, 1:])
    doc, item, _, begin, cost, end = out[:, ~worse]
    return np.stack([doc, b.number[item], begin, end, cost])


def exact(text: np.ndarray, starts: np.ndarray, b: Block) -> np.ndarray:
    """The same of short items: where one stands as whole words. Between characters beyond ASCII words have no known edge."""
    letter = (text != 32) & (text < 128)
    edges = np.ones(len(text) + 1, bool)  # not between two ASCII letters or digits of one document
    edges[1:-1] = ~(letter[1:] & letter[:-1])
    edges[starts] = True
    out = []
    for size, known in b.short.items():
        at = np.flatnonzero(edges[:-size] & edges[size:])
        doc = np.searchsorted(starts, at, "right") - 1
        inside = at + size <= starts[doc + 1]
        at, doc = at[inside], doc[inside]
        for head in {t[0] for t in known}:
            some = text[at] == head
            spelled = text[at[some][:, None] + np.arange(size)]
            for s, d, t in zip(at[some].tolist(), doc[some].tolist(), map(bytes, spelled), strict=True):
                s -= int(starts[d])
                out += [(d, i, s, s + size, 0) for i in known.get(t, ())]
    return np.array(out, np.int64).reshape(-1, 5).T


def regions(data: np.ndarray, offsets: np.ndarray, b: Block, q: int = Q) -> list[tuple]:
    """(row, item index, start, end, edits, windows): verified windows of an item, overlapping ones joined; in code points."""
    text, origin, starts = normal(data, offsets)
    hits = shared(text, starts, b, q)
    found = [verified(text, starts, hits, size, k, b, q) for size, k in b.tier] if len(hits[0]) else []
    found = np.concatenate([*found, exact(text, starts, b)] if b.short else found or [np.empty((5, 0), np.int64)], axis=1)
    if not found.shape[1]:
        return []
    found = found[:, np.lexsort(found[::-1])]
    doc, item, begin, end, edits = found
    group = np.cumsum(_first(found[:2]))
    far = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(far + end) - far
    first = np.flatnonzero(_first(found[:2]) | np.concatenate(([True], begin[1:] > reach[:-1])))
    last = np.append(first[1:], len(doc)) - 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    upto = lambda d, x: points[origin[starts[d] + x] + 1] - points[offsets[d]]  # noqa: E731 - code points up to this byte's
    d, e = doc[first], reach[last]
    columns = d, item[first], upto(d, begin[first]) - 1, upto(d, e - 1), np.minimum.reduceat(edits, first), np.diff(np.append(first, len(doc)))
    return list(zip(*(c.tolist() for c in columns), strict=True))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits, windows): every region of a document that an item's windows cover."""
    ids = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {ids[0].simpleString()}, item_id {ids[1].simpleString()}, start int, end int, edits int, windows int"
    texts, spark = docs.select("doc_id", "text"), docs.sparkSession
    out = None
    for rows in blocks(benchmark):
        index = block(rows)
        if index is None:
            continue
        sent = spark.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = Block(**sent.value)
            for batch in batches:
                for part in steps(batch, limit=STEP):
                    data, offsets = packed(part.column("text"))
                    found = regions(data, offsets, b)
                    if found:
                        d, i, *rest = zip(*found, strict=True)
                        items = pa.array([b.ids[x] for x in i])
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(d)), items, *[pa.array(x, pa.int32()) for x in rest]],
                            ["doc_id", "item_id", "start", "end", "edits", "windows"],
                        )

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones. Each row is judged by its own text alone, whatever its id, and where it is: nothing is shuffled."""
    out = docs
    for rows in blocks(benchmark):
        index = block(rows)
        if index is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = Block(**sent.value)
            for batch in batches:
                for part in steps(batch, limit=STEP):
                    bad = {found[0] for found in regions(*packed(part.column("text")), b)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_())) if bad else part

        out = out.mapInArrow(run, docs.schema)
    return out
