"""Canonical table schemas. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

FRAME = T.StructType([
    T.StructField("raw", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("loc", T.StringType()),
    T.StructField("sig", T.StringType()),
    T.StructField("native", T.BooleanType()),
])

LOCK = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("frame_idx", T.IntegerType()),
])

DUMP = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("dump_idx", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("banner", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("saw_sync", T.BooleanType()),
    T.StructField("dump_reason", T.StringType()),
    T.StructField("reordered", T.BooleanType()),
])

THREAD = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("dump_idx", T.IntegerType()),
    T.StructField("thread_ord", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("java_id", T.LongType()),
    T.StructField("daemon", T.BooleanType()),
    T.StructField("prio", T.IntegerType()),
    T.StructField("os_prio", T.IntegerType()),
    T.StructField("cpu_ms", T.DoubleType()),
    T.StructField("elapsed_s", T.DoubleType()),
    T.StructField("tid_hex", T.StringType()),
    T.StructField("nid_hex", T.StringType()),
    T.StructField("nid_dec", T.LongType()),
    T.StructField("state", T.StringType()),
    T.StructField("state_detail", T.StringType()),
    T.StructField("header_cond", T.StringType()),
    T.StructField("is_virtual", T.BooleanType()),
    T.StructField("carrier_tid", T.StringType()),
    T.StructField("frames", T.ArrayType(FRAME)),
    T.StructField("locks", T.ArrayType(LOCK)),
])

JVM_CYCLE = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("dump_idx", T.IntegerType()),
    T.StructField("cycle_no", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("thread_name", T.StringType()),
])

PARSE_ISSUE = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("dump_idx", T.IntegerType()),
    T.StructField("where", T.StringType()),
    T.StructField("message", T.StringType()),
])

OS_SAMPLE = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("sample_ord", T.LongType()),
    T.StructField("pid", T.LongType()),
    T.StructField("cpu_pct", T.DoubleType()),
    T.StructField("mem_pct", T.DoubleType()),
    T.StructField("command", T.StringType()),
])

PAUSE_WINDOW = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("cause", T.StringType()),
    T.StructField("kind", T.StringType()),
])

PINNED_EVENT = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("thread", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("frames", T.ArrayType(T.StringType())),
])

RULE = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("warn_threads", T.IntegerType()),
    T.StructField("critical_threads", T.IntegerType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("frames", T.ArrayType(T.StringType())),
    T.StructField("name_regex", T.StringType()),
    T.StructField("states", T.ArrayType(T.StringType())),
    T.StructField("min_threads", T.IntegerType()),
    T.StructField("persist_dumps", T.IntegerType()),
    T.StructField("cpu_delta", T.StringType()),
])

FINDING_COLUMNS = [
    "series_id", "id", "severity", "sev_ord", "title", "detail",
    "recommendation", "confidence", "why", "evidence",
]
