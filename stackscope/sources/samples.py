"""Execution samples cut into synthetic snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackscope import schema
from stackscope.functions.frames import parse_frame
from stackscope.functions.scan import running
from stackscope.sources.series import order_series
from stackscope.sources.tables import Tables, conform

MIN_SLICE_MS = 100
MAX_SLICES = 300
#: finest buckets per chunk of a running value
CHUNK = 1 << 20


def slice_width(exec_sample: DataFrame, slice_ms: int, max_slices: int = MAX_SLICES) -> DataFrame:
    """Bucketed samples with the per-series width that leaves at most max_slices buckets.

    The width doubles while a series has more buckets than allowed. All widths are
    judged at once over the distinct finest buckets, never over the samples again.
    """
    base = max(MIN_SLICE_MS, slice_ms)
    ms = F.unix_millis("ts")
    fine = exec_sample.withColumn("_b", F.floor(ms / base).cast("long"))
    buckets = fine.select("series_id", "_b").distinct().withColumn("_chunk", F.floor(F.col("_b") / CHUNK))
    # doubled d times, a bucket is new unless it equals the one before it there, that is
    # unless the two differ only in their d lowest bits; so the highest differing bit decides (64: always new)
    step = running(buckets, ["series_id"], "_chunk", ["_b"], prev={"_p": F.col("_b")})
    bits = F.when(F.col("_p").isNull(), 64).otherwise(F.length(F.bin(F.col("_b").bitwiseXOR(F.col("_p")))))
    counted = step.groupBy("series_id", bits.alias("_bits")).agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy("series_id").orderBy(F.desc("_bits"))
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.col("_bits") < 64
    return counted.withColumn("_above", above).groupBy("series_id").agg(
        F.when(F.sum("_n") <= max_slices, 0).otherwise(F.coalesce(
            F.min(F.when(below & (F.col("_above") <= max_slices), F.col("_bits"))),
            F.max(F.when(below, F.col("_bits"))), F.lit(0))).alias("_d")).select(
        "series_id", F.expr(f"shiftleft({base}L, _d)").alias("slice_ms"))


def slice_samples(exec_sample: DataFrame, slice_ms: int = 1000,
                  max_slices: int = MAX_SLICES) -> Tables:
    """Last sample per thread and slice, each slice a snapshot of RUNNABLE threads.

    Input: series_id, ts, thread_id, thread_name, os_tid, frames ARRAY<STRING>.
    """
    width = slice_width(exec_sample, slice_ms, max_slices)
    df = exec_sample.join(width, "series_id").withColumn(
        "bucket", F.floor(F.unix_millis("ts") / F.col("slice_ms")).cast("long") * F.col("slice_ms"))
    latest = df.groupBy("series_id", "bucket", "slice_ms", "thread_id", "thread_name").agg(
        F.max_by(F.struct("os_tid", "frames"), F.struct("ts", "frames")).alias("s"))
    dump = order_series(
        latest.select("series_id", "bucket", "slice_ms").distinct().select(
            "series_id", F.timestamp_millis("bucket").alias("ts"), "bucket", "slice_ms"),
        ["bucket"])
    frames = F.filter(F.transform(
        F.coalesce("s.frames", F.array().cast("array<string>")),
        lambda f: parse_frame(F.concat(F.lit("\tat "), f))), lambda f: f.isNotNull())
    os_tid = F.col("s.os_tid")
    thread = latest.join(dump.select("series_id", "bucket", "dump_idx"), ["series_id", "bucket"]).select(
        "series_id", "dump_idx", F.col("thread_id").cast("long").alias("thread_ord"),
        F.col("thread_name").alias("name"),
        F.when(F.col("thread_id") > 0, F.col("thread_id")).alias("java_id"),
        F.lit(False).alias("daemon"),
        F.when(os_tid > 0, F.concat(F.lit("0x"), F.lower(F.hex(os_tid.cast("long"))))).alias("nid_hex"),
        F.when(os_tid > 0, os_tid).otherwise(F.lit(-1)).cast("long").alias("nid_dec"),
        F.lit("RUNNABLE").alias("state"), F.lit("RUNNABLE (sampled)").alias("state_detail"),
        F.lit("").alias("header_cond"), F.lit(False).alias("is_virtual"), frames.alias("frames"),
        F.array().cast(T.ArrayType(schema.LOCK)).alias("locks"))
    dump = dump.withColumn("source_name", F.concat(F.lit("slice-"), F.col("dump_idx").cast("string"))) \
        .withColumn("banner", F.concat(F.lit("execution samples ("), F.col("slice_ms").cast("string"),
                                       F.lit(" ms slices)"))) \
        .withColumn("saw_sync", F.lit(True))
    spark = exec_sample.sparkSession
    return Tables(conform(dump, schema.DUMP), conform(thread, schema.THREAD),
                  spark.createDataFrame([], schema.JVM_CYCLE), spark.createDataFrame([], schema.PARSE_ISSUE))
