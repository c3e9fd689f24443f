"""Cutting lineage in the cluster's shared checkpoint folder, so steps survive lost executors.

``stage`` writes a table that is read more than once: Parquet keeps column pruning and a real
size. ``checkpoint`` cuts the lineage of one loop step and reports its rows and bytes, which
``small`` turns into a broadcast only when the measured size allows it.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}
_staged: dict[str, list[str]] = {}
_steps = itertools.count()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written steps: the session's, or the one set on the context; a temporary one only in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="codeatlas-")
    return _local_roots[sc.applicationId]


# Texts are read by tasks that work on each of them: a file of more rows than this could only be read by one task.
TEXTS_PER_FILE = 10_000


def stage(df: DataFrame, label: str, rows_per_file: int | None = None, **metrics) -> tuple[DataFrame, dict]:
    """Write ``df`` and read it back. Returns it with observed metrics: ``rows`` and any given.

    A reader's task takes whole files (or row groups) by their bytes; ``rows_per_file`` bounds the rows of one, where rows are dear to work on.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/codeatlas/{label}-{next(_steps)}-{uuid.uuid4().hex[:8]}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]).write
    if rows_per_file is not None:  # else the session's own bound holds
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def clear(spark: SparkSession) -> int:
    """Delete the tables this application has staged so far; to be called once no result that reads them is needed."""
    jvm, paths = spark.sparkContext._jvm, _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


# A side is broadcast by hand only below this measured size; beyond it Spark shuffles.
BROADCAST_BYTES = 32 << 20


def checkpoint(df: DataFrame, width: str) -> tuple[DataFrame, dict]:
    """Reliable checkpoint of a loop step, with its ``rows`` and ``bytes`` (``width`` per row)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_root(df.sparkSession))
    seen = Observation()
    out = df.observe(seen, F.expr("count(1) as rows"), F.expr(f"coalesce(sum({width}), 0) as bytes")).checkpoint()
    return out, seen.get


def small(df: DataFrame, size: int) -> DataFrame:
    """Mark ``df`` for broadcast if its measured ``size`` in bytes is within the bound."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
