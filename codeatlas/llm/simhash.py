"""SimHash near-duplicates by meeting in the middle.

A fingerprint is the majority of the bits of its shingles' XXH64. Every distinct fingerprint emits all variants
within half the radius; two fingerprints within the radius share a variant, so a shuffle on variants finds every
link. A variant is met by at most as many fingerprints as lie in its ball (65 for radius 2), so no bucket grows with
the data, and copies of a text are one fingerprint before anything is emitted. In a bucket every member links to its
least fingerprint; by the triangle inequality they are all within the radius, which is verified all the same. Classes
are the connected components.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero; repeated rows come back repeated;
a null id never is the least id of a class unless all its ids are null; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import stage
from .common import as_bytes, steps
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Shingles whose bits are counted in one step.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles of a lower-cased (A-Z) text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
    spans = zip(starts, ends[shingle - 1:].tolist(), strict=True)
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at:at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``also``: one row per row of ``docs``; ``fp`` holds the 64 bits as a signed long."""
    names = ["doc_id", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                fps = np.array([fingerprint(t, shingle) for t in as_bytes(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(fps.view(np.int64))], [*names, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, fp bigint")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a > b: from each distinct fingerprint to the least one of every ball around a shared variant.

    Their components are those of all pairs within ``radius``, an even number.
    """
    if radius % 2:
        raise ValueError("the radius is split in two halves, so it must be even")
    bits = [sum(1 << b for b in c) for k in range(radius // 2 + 1) for c in combinations(range(64), k)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in bits])
    variants = fps.select("fp").distinct().select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    least = F.min("fp").over(W.partitionBy("variant"))
    return (
        variants.select(F.col("fp").alias("a"), least.alias("b"))
        .where("a <> b").distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )


def _nodes(fps: DataFrame, radius: int, least: Column) -> DataFrame:
    """(fp, least, root): every distinct fingerprint with the ``least`` of its rows and the root of its class."""
    label = components(links(fps, radius))
    root = F.coalesce(F.col("root"), F.col("fp"))
    nodes = fps.groupBy("fp").agg(F.min(least).alias("least")).join(label.withColumnRenamed("node", "fp"), "fp", "left")
    return nodes.select("fp", "least", root.alias("root"))


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the class of every row, named by its least ``doc_id``."""
    fps, _ = stage(fingerprints(docs, shingle), "simhash")
    nodes = _nodes(fps, radius, F.col("doc_id"))
    named = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each class: of the least id, then of the least fingerprint, then of the least other columns.

    An id may have rows of different texts: each counts in the class of its own text. Rows without an id come last in
    their class, so one stays where no row of the class has an id. Of rows that are equal in all columns one stays. Columns may have any names.
    """
    own = {c: f"_s_in_{i}" for i, c in enumerate(docs.columns)}
    texts = {"_s_a": F.xxhash64("text"), "_s_b": F.hash("text")}  # 96 bits tell the texts of an id apart
    plain = lambda c: F.to_json(F.struct(own[c])) if "map<" in docs.schema[c].dataType.simpleString() else F.col(own[c])  # noqa: E731 - maps have no hash
    others = [plain(c) for c in docs.columns if c not in ("doc_id", "text")]
    marked = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], "doc_id", "text").withColumns(
        texts | {"_s_row": F.xxhash64(*others, F.lit(0))})
    keys = ["doc_id", *texts, "_s_row"]
    fps, _ = stage(fingerprints(marked, shingle, (*texts, "_s_row")), "simhash")
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", *keys[1:])
    first = _nodes(fps, radius, least).groupBy("root").agg(F.min("least").alias("first"))
    first, _ = stage(first.select(*[f"first.{c}" for c in keys]), "firsts")
    kept = marked.where("doc_id is not null").join(first.where("doc_id is not null"), keys, "left_semi").dropDuplicates(keys)
    alone = first.where("doc_id is null").drop("doc_id")
    more = marked.where("doc_id is null").dropDuplicates(keys[1:]).join(alone, keys[1:], "left_semi")
    return kept.unionByName(more).select(*[F.col(n).alias(c) for c, n in own.items()])
