"""Churn over a stream of commit touches, in event-time windows with bounded lateness.

State is bounded by the watermark: repeats of a (commit, path) are remembered that long, and a
window's count is dropped once it is final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_touches(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet") -> DataFrame:
    """A stream of touch files as they appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def once_per_commit(touches: DataFrame, late: str = "7 days") -> DataFrame:
    """Touches without repeats of a commit and path; later than ``late`` they are dropped."""
    return touches.withWatermark("ts", late).dropDuplicatesWithinWatermark(["repo", "commit_id", "path"])


def windowed_churn(touches: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """(repo, path, start, end, commits): commits per path in tumbling, or with ``slide`` sliding, windows."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = once_per_commit(touches, late).groupBy("repo", "path", at.alias("w")).agg(F.count(F.lit(1)).alias("commits"))
    return counts.select("repo", "path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "commits")


def bursts(touches: DataFrame, gap: str = "1 hour", late: str = "7 days") -> DataFrame:
    """(repo, path, start, end, commits): runs of commits to a path no further apart than ``gap``."""
    counts = once_per_commit(touches, late).groupBy("repo", "path", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("commits")
    )
    return counts.select("repo", "path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "commits")


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over everything available into Parquet files at ``out``, and read them."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
