"""Columns every operator needs, computed once per thread row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscope.functions.frames import label_of, stack_hash
from stackscope.functions.names import assign_pool, is_housekeeping, normalized_name, thread_key
from stackscope.knowledge import (
    FRAME_MEANINGS, IDLE_PATTERNS, IDLE_TOP_FRAMES, MEANING_TOP_FRAMES, WAIT_KINDS,
)
from stackscope.options import Options


def is_vm_thread() -> Column:
    return F.col("java_id").isNull() & (F.size("frames") == 0)


def idle_label(frames: Column, entries=IDLE_PATTERNS) -> Column:
    return label_of(frames, entries, IDLE_TOP_FRAMES, lambda e: F.lit(e.label))


def frame_meaning(frames: Column, entries=FRAME_MEANINGS) -> Column:
    """Struct (activity, category) of the first known frame; null when none is known."""
    return label_of(frames, entries, MEANING_TOP_FRAMES, lambda e: F.struct(
        F.lit(e.label).alias("activity"), F.lit(e.category).alias("category")))


def derive(thread: DataFrame, options: Options = Options(), idle=IDLE_PATTERNS,
           meanings=FRAME_MEANINGS) -> DataFrame:
    """Adds is_vm, key, norm_name, pool, cls_kind, cls_label, activity, category,
    stack_hash, fp and wait_lock."""
    house = is_housekeeping(F.col("name"))
    label = idle_label(F.col("frames"), idle)
    wait = F.try_element_at(F.filter("locks", lambda l: l["kind"].isin(*WAIT_KINDS)
                                     & l["address"].isNotNull()), F.lit(1))
    return (thread
            .withColumn("is_vm", is_vm_thread())
            .withColumn("norm_name", normalized_name(F.col("name")))
            .withColumn("key", thread_key(F.col("tid_hex"), F.col("name")))
            .withColumn("pool", assign_pool(F.col("name"), options.pool_patterns))
            .withColumn("_idle", label)
            .withColumn("cls_kind", F.when(house, "HOUSEKEEPING").when(
                F.col("_idle").isNotNull(), "IDLE").otherwise("APPLICATION"))
            .withColumn("cls_label", F.when(house, "housekeeping").otherwise(F.col("_idle")))
            .withColumn("_m", frame_meaning(F.col("frames"), meanings))
            .withColumn("activity", F.col("_m.activity"))
            .withColumn("category", F.col("_m.category"))
            .withColumn("stack_hash", stack_hash(F.col("frames")))
            .withColumn("fp", stack_hash(F.col("frames"), options.fingerprint_depth))
            .withColumn("wait_lock", wait)
            .drop("_idle", "_m"))


def java_threads(derived: DataFrame) -> DataFrame:
    return derived.filter(~F.col("is_vm"))
