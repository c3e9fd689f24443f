"""Bounded training samples for the models of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a training sample over all classes, as expected value, and the longest text taken into one, in bytes.
SAMPLE = 8000
LONGEST = 32_000


def chosen(rows: DataFrame, label: str, most: int = SAMPLE) -> tuple[DataFrame, dict]:
    """About ``most`` of ``rows(doc_id, label, ...)``, equally many of each label, and the count of each label.

    Rows are chosen by a hash of the id, so a sample is the same in every run.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.limit(0), counts
    each = most / len(counts)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col(label)) * 1_000_000), counts


def short_texts(rows: DataFrame) -> pa.Table:
    """The rows of a sample whose text is one and not too long, on the driver."""
    return rows.where(F.octet_length("text") <= LONGEST).toArrow()
