"""Execution samples cut into snapshots while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_samples_stream(exec_sample: DataFrame, slice: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Last sample per thread in every slice; a slice closes when the watermark passes it."""
    return exec_sample.withWatermark("ts", delay).groupBy(
        F.window("ts", slice), "series_id", "thread_id", "thread_name").agg(
        F.max_by(F.struct("os_tid", "frames"), "ts").alias("s"), F.max("ts").alias("last_ts")) \
        .select("series_id", F.col("window.start").alias("slice_ts"), "thread_id", "thread_name",
                "s.os_tid", "s.frames", F.lit("RUNNABLE").alias("state"), "last_ts")
