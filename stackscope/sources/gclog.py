"""GC and safepoint logs: one projection per line, no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIFIED = r"^\[(\d{4}-\d{2}-\d{2}T[\d:.+\-]+)\]\[.*?(gc|safepoint).*?\](.*)$"
JDK8 = r"^(\d{4}-\d{2}-\d{2}T[\d:.+\-]+): [\d.]+: (.*)$"
PARENS = r"\(((?:[^()]|\([^()]*\))*)\)"
HEAP_SIZE = r"^\d+[KMGT]?B?$"
PAUSE_MS = r"(\d+(?:\.\d+)?)ms\s*$"
TOTAL_NS = r"Total: (\d+) ns"
AT_NS = r"At safepoint: (\d+) ns"
OPERATION = r'Safepoint "([^"]+)"'
STOPPED = r"Total time for which application threads were stopped: ([\d.]+) seconds"
SECS = r", ([\d.]+) secs\]"


def _get(c: Column, pattern: str, group: int = 1) -> Column:
    v = F.regexp_extract(c, pattern, group)
    return F.when(v != "", v)


def parse_gc_log(lines: DataFrame) -> DataFrame:
    """Pause windows (series_id, start_ts, duration_ms, cause, kind); other lines drop out."""
    line = F.col("line")
    uni = line.rlike(UNIFIED)
    old = ~uni & line.rlike(JDK8)
    df = lines.filter(line.rlike(UNIFIED) | line.rlike(JDK8)).select(
        "series_id", uni.alias("uni"), old.alias("old"),
        F.when(uni, F.regexp_extract(line, UNIFIED, 1)).otherwise(
            F.regexp_extract(line, JDK8, 1)).alias("stamp"),
        F.regexp_extract(line, UNIFIED, 2).alias("tag"),
        F.when(uni, F.regexp_extract(line, UNIFIED, 3)).otherwise(
            F.regexp_extract(line, JDK8, 2)).alias("rest"))
    rest = F.col("rest")
    # zone offsets come with or without a colon; a stamp without any is not accepted
    ts = F.when(F.col("stamp").rlike(r"[+\-]\d{2}:?\d{2}$"),
                F.try_to_timestamp(F.regexp_replace("stamp", r"([+\-]\d{2}):?(\d{2})$", "$1:$2")))
    groups = F.regexp_extract_all(rest, F.lit(PARENS), F.lit(1))
    unified_cause = F.coalesce(F.try_element_at(
        F.filter(groups, lambda g: ~g.rlike(HEAP_SIZE)), F.lit(-1)), F.lit("GC pause"))
    ns = F.coalesce(_get(rest, TOTAL_NS), _get(rest, AT_NS)).try_cast("double") / 1_000_000.0
    ms = _get(rest, PAUSE_MS).try_cast("double")
    stopped = _get(rest, STOPPED).try_cast("double") * 1000.0
    secs = _get(rest, SECS).try_cast("double") * 1000.0
    full = rest.startswith("[Full GC")
    collect = rest.startswith("[GC") | full
    window = (
        F.when(F.col("uni") & (F.col("tag") == "safepoint"), F.struct(
            ns.alias("duration_ms"), F.coalesce(_get(rest, OPERATION), F.lit("safepoint")).alias("cause"),
            F.lit("safepoint").alias("kind")))
        .when(F.col("uni") & rest.contains(" Pause "), F.struct(
            ms.alias("duration_ms"), unified_cause.alias("cause"), F.lit("gc").alias("kind")))
        .when(F.col("old") & stopped.isNotNull(), F.struct(
            stopped.alias("duration_ms"), F.lit("threads stopped").alias("cause"),
            F.lit("safepoint").alias("kind")))
        .when(F.col("old") & collect, F.struct(
            secs.alias("duration_ms"),
            F.coalesce(F.try_element_at(groups, F.lit(1)),
                       F.when(full, "Full GC").otherwise("GC")).alias("cause"),
            F.lit("gc").alias("kind"))))
    return df.select("series_id", ts.alias("start_ts"), window.alias("w")).select(
        "series_id", "start_ts", "w.duration_ms", "w.cause", "w.kind") \
        .filter("start_ts IS NOT NULL AND duration_ms IS NOT NULL")
