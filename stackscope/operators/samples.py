"""Contention and pinning events of a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contention_summary(wait_event: DataFrame, n: int = 30) -> DataFrame:
    """(series, kind, cls): count, total and longest wait; the n with the largest total."""
    g = wait_event.filter("cls IS NOT NULL AND duration_ms IS NOT NULL").groupBy("series_id", "kind", "cls").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("_total"), F.max("duration_ms").alias("_max"))
    w = Window.partitionBy("series_id").orderBy(F.desc("_total"), "kind", "cls")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "series_id", "rank", "kind", "cls", "n", F.round("_total", 2).alias("total_ms"),
        F.round("_max", 2).alias("max_ms"))


def pinned_events(pinned: DataFrame, n: int = 100) -> DataFrame:
    """The first n pinning events of a series."""
    w = Window.partitionBy("series_id").orderBy("ts", "thread", "duration_ms")
    return pinned.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pinned_summary(pinned: DataFrame, frames: int = 12) -> DataFrame:
    """Number and longest of all pinning events of a series, and the first frames of its earliest event."""
    earliest = pinned_events(pinned, 1).select("series_id", F.slice("frames", 1, frames).alias("frames"))
    return pinned.groupBy("series_id").agg(
        F.count("*").alias("n"), F.max("duration_ms").alias("max_ms")).join(earliest, "series_id")
