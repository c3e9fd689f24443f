"""Shards along a Hilbert curve, so that every shard is a small box in several metadata dimensions.

Every dimension is quantised to ``2 ** BITS`` levels of about equal row counts that keep the order of the values, so minima and
maxima per file prune: numbers by approximate quantiles, strings by the share of rows with lesser values. The levels'
index on the curve orders the rows; equal texts come together by their hash, ties by id. Ranks are counted over range-sorted
tasks, and the ranking is cut into runs: row counts of shards differ by one at most (law ``rows``).

Only ids, sizes and levels are shuffled, never texts. Defined cases: a null value is the least of its dimension; a null
text has no bytes; repeated rows get places of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import number_rows, running_total
from ..storage import stage

BITS = 6
SHARDS = 40
OVERHEAD = 16


def index(levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points (rows of ``levels``, one column a dimension, each below ``2 ** bits``).

    From the most significant bit on, each bit of a dimension tells whether the lower bits of the first dimension
    are inverted or exchanged with its own; the bits that result, in Gray code, are the digits of the place.
    """
    x = levels.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for d in range(n):
            set_ = (x[d] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, swap)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            place = place << 1 | x[d] >> b & 1
    return place


def _string_levels(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """(value, level) of a string column: the share of rows with a lesser value, in ``2 ** bits`` steps."""
    counts = rows.groupBy(F.coalesce(F.col(name), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = running_total(counts, [], [F.col("value")], "n", "upto")
    all_rows = rows.agg(F.count(F.lit(1)).alias("all"))
    # One row is joined to all: the total.
    return total.join(F.broadcast(all_rows)).select(
        "value", F.floor((F.col("upto") - F.col("n")) * (1 << bits) / F.col("all")).cast("int").alias("level")
    )


def placed(docs: DataFrame, dimensions: tuple[str, ...] = ("source", "lang", "size"), bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash, curve); ``size`` is the bytes of the text and ``OVERHEAD``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = [d for d in dimensions if d != "size"]
    rows = docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), *[F.col(f"`{d}`").alias(f"_d_{d}") for d in own],
    )
    rows, _ = stage(rows, "sizes")
    names, numbers, level = [], {}, []
    for d in dimensions:
        column = d if d == "size" else f"_d_{d}"
        level.append(f"_l_{d}")
        if isinstance(rows.schema[column].dataType, T.StringType):
            names.append((column, f"_l_{d}"))
        else:
            numbers[f"_l_{d}"] = column
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = {}
    if numbers:
        found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, 10_000).alias(k) for k, c in numbers.items()]).first()
        cuts = {k: np.array(found[k] or [0.0]) for k in numbers}
    for column, target in names:
        levels = _string_levels(rows, column, bits).withColumnRenamed("level", target)
        rows = rows.join(levels, F.coalesce(F.col(column), F.lit("")) == F.col("value")).drop("value")
    keep = ["doc_id", "size", "text_crc32", "text_hash"]
    given = [c if (c := numbers.get(k)) else k for k in level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for k, c in zip(level, given):
                values = batch.column(names_at[c])
                if k in cuts:
                    columns.append(np.searchsorted(cuts[k], values.cast(pa.float64()).fill_null(-np.inf).to_numpy(), side="left"))
                else:
                    columns.append(values.to_numpy())
            curve = index(np.stack(columns, axis=1), bits) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(curve)], [*keep, "curve"])

    picked = rows.select(*keep, *[F.col(c).alias(f"_v_{i}") for i, c in enumerate(dict.fromkeys(given))])
    names_at = {c: len(keep) + i for i, c in enumerate(dict.fromkeys(given))}
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("curve", T.LongType())])
    return picked.mapInArrow(run, schema)


def shards(docs: DataFrame, n: int = SHARDS, dimensions: tuple[str, ...] = ("source", "lang", "size"), bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot): runs of the curve whose row counts differ by one at most."""
    ranked = number_rows(placed(docs, dimensions, bits), [], [F.col(c) for c in ("curve", "text_hash", "doc_id")], "rank")
    total = F.broadcast(ranked.agg(F.count(F.lit(1)).alias("_all")))  # one row
    out = ranked.join(total).withColumn("shard", F.expr(f"cast((rank - 1) * {n} div _all as int)"))
    first = F.expr(f"(shard * _all + {n - 1}) div {n}")
    return out.withColumn("slot", (F.col("rank") - 1 - first).cast("long")).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def write(docs: DataFrame, path: str, n: int = SHARDS, **how) -> None:
    """One sorted Parquet file set per shard below ``path``; ids must tell the rows apart."""
    place = shards(docs, n, **how).select("doc_id", F.col("shard").alias("shard"), F.col("slot").alias("slot"))
    rows = docs.drop("shard", "slot").join(place, "doc_id")
    rows.repartition(n, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
