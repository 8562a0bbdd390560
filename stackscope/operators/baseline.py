"""Baselines: what a healthy series looks like, and drift against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackscope.knowledge import THREAD_STATES
from stackscope.operators import series as S
from stackscope.operators.single import recurring_stacks

TYPE_TAG = "stackscope-baseline"
PARTS = ("header", "state", "pool", "stack")


@dataclass
class Baseline:
    header: DataFrame
    state: DataFrame
    pool: DataFrame
    stack: DataFrame


def build(t: DataFrame, dump: DataFrame) -> Baseline:
    return Baseline(S.baseline_header(t, dump), S.baseline_state(t), S.baseline_pool(t, dump),
                    S.baseline_stack(t))


def save(b: Baseline, path: str) -> None:
    for part in PARTS:
        df = getattr(b, part)
        if part == "header":
            df = df.withColumn("type", F.lit(TYPE_TAG)).withColumn("version", F.lit(1))
        df.write.mode("overwrite").parquet(f"{path}/{part}")


def load(spark: SparkSession, path: str) -> Baseline:
    b = Baseline(*[spark.read.parquet(f"{path}/{p}") for p in PARTS])
    if "type" not in b.header.columns or b.header.filter(F.col("type") != TYPE_TAG).take(1):
        raise ValueError(f"{path} is no baseline")
    return b


def state_shifts(incident: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per state: percent before, now, and the difference in points."""
    order = F.array_position(F.array(*[F.lit(s) for s in THREAD_STATES]), F.col("state"))
    zero = F.lit(0.0)
    return baseline.select("series_id", "state", F.col("percent").alias("_b")).join(
        incident.select("series_id", "state", F.col("percent").alias("_i")),
        ["series_id", "state"], "full_outer").select(
        "series_id", "state", order.alias("state_ord"),
        F.round(F.coalesce("_b", zero), 2).alias("baseline_percent"),
        F.round(F.coalesce("_i", zero), 2).alias("incident_percent"),
        F.round(F.coalesce("_i", zero) - F.coalesce("_b", zero), 2).alias("delta_points")) \
        .filter("baseline_percent <> 0 OR incident_percent <> 0")


def pool_deltas(incident: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per pool: average size before and now, largest change first (``rank``)."""
    zero = F.lit(0.0)
    j = baseline.select("series_id", "pool", F.col("avg").alias("_b")).join(
        incident.select("series_id", "pool", F.col("avg").alias("_i")),
        ["series_id", "pool"], "full_outer").select(
        "series_id", "pool", F.round(F.coalesce("_b", zero), 2).alias("baseline_avg"),
        F.round(F.coalesce("_i", zero), 2).alias("incident_avg"),
        F.round(F.coalesce("_i", zero) - F.coalesce("_b", zero), 2).alias("delta"))
    w = Window.partitionBy("series_id").orderBy(F.desc(F.abs("delta")), "pool")
    return j.withColumn("rank", F.row_number().over(w))


def new_recurring_stacks(t: DataFrame, baseline_stack: DataFrame) -> DataFrame:
    """All recurring stacks the baseline never showed; twelve frames of each are shown."""
    g = recurring_stacks(t, 12)
    return g.join(baseline_stack.select("series_id", "stack_hash").distinct(),
                  ["series_id", "stack_hash"], "left_anti") \
        .groupBy("series_id", "stack_hash").agg(
            F.max("n").alias("max_count"), F.count("*").alias("dumps"),
            F.min("dump_idx").alias("first_dump"), F.min_by("stack", "dump_idx").alias("stack"))
