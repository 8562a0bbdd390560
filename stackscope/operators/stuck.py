"""Verdicts on frozen threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscope.functions.frames import has_app_frames
from stackscope.functions.names import is_housekeeping, normalized_name

SPIN_RATIO = 0.70
IDLE_RATIO = 0.05
IDLE_CPU_MS = 100.0
GENUINE = ["SPINNING", "FROZEN", "BLOCKED_CHAIN"]


def classify_stuck(candidates: DataFrame, contended: DataFrame, victims: DataFrame,
                   os_sample: DataFrame | None = None, critical_victims: int = 5) -> DataFrame:
    """Adds kind, severity, confidence, why and victims; the first matching rule decides.

    contended: ``contended_locks``; victims: ``transitive_victims``.
    """
    critical_victims = max(1, critical_victims)
    lock = contended.select("series_id", F.col("dump_idx").alias("to_dump"),
                            F.col("address").alias("_addr"), "waiters",
                            normalized_name(F.col("holder")).alias("_holder"))
    held = victims.select("series_id", F.col("dump_idx").alias("to_dump"),
                          F.col("holder").alias("last_name"), F.col("transitive").alias("_held"))
    df = candidates.withColumn("_addr", F.col("wait_lock.address")) \
        .join(lock, ["series_id", "to_dump", "_addr"], "left") \
        .join(held, ["series_id", "to_dump", "last_name"], "left") \
        .withColumn("_w", F.coalesce("waiters", F.lit(0))) \
        .withColumn("_held", F.coalesce("_held", F.lit(0)))
    if os_sample is None:
        df = df.withColumn("_hot", F.lit(None).cast("double")).withColumn("_cold", F.lit(None).cast("double"))
    else:
        # the first sample that decides counts, so the earliest of each sort is kept
        pct = F.col("cpu_pct")
        s = os_sample.groupBy("series_id", F.col("pid").alias("nid_dec")).agg(
            F.min_by(pct, F.when(pct >= 50.0, F.col("sample_ord"))).alias("_hot"),
            F.min(F.when(pct >= 50.0, F.col("sample_ord"))).alias("_hot_at"),
            F.min_by(pct, F.when(pct <= 2.0, F.col("sample_ord"))).alias("_cold"),
            F.min(F.when(pct <= 2.0, F.col("sample_ord"))).alias("_cold_at"))
        df = df.join(s, ["series_id", "nid_dec"], "left")
        first_cold = F.col("_cold_at") < F.col("_hot_at")
        df = df.withColumn("_hot", F.when(
            ~F.coalesce(first_cold & F.col("top_native"), F.lit(False)), F.col("_hot")))
    wall_ms = F.col("wall_s") * 1000.0
    ratio = F.col("cpu_delta_ms") / wall_ms
    cpu_known = F.col("cpu_delta_ms").isNotNull() & F.col("wall_s").isNotNull()
    app = has_app_frames(F.col("frames"))

    def verdict(kind, severity, confidence, why, victims):
        def text(x):
            return x if not isinstance(x, str) else F.lit(x)
        return F.struct(F.lit(kind).alias("kind"),
                        (F.lit(None).cast("string") if severity is None else text(severity)).alias("severity"),
                        text(confidence).alias("confidence"), text(why).alias("why"),
                        (F.lit(0) if victims is None else victims).cast("long").alias("victims"))

    def num(c):
        return F.round(c, 2).cast("string")

    harm = F.when(F.col("_held") > 0, "CRITICAL").otherwise("WARNING")
    house = is_housekeeping(F.col("last_name"))
    known_holder = F.col("_holder").isNotNull()
    chain_why = F.when(known_holder, F.concat(
        F.lit("waited for one monitor through "), F.col("run_length").cast("string"),
        F.lit(" dumps while \""), F.col("_holder"), F.lit("\" kept it; "), F.col("_w").cast("string"),
        F.lit(" thread(s) queue on it"))).otherwise(F.concat(
            F.lit("waited for one monitor through "), F.col("run_length").cast("string"),
            F.lit(" dumps; its owner does not show in the dump")))
    cpu_text = F.concat(num(F.col("cpu_delta_ms")), F.lit(" ms of CPU in "), num(wall_ms), F.lit(" ms"))
    v = (F.when(house & F.col("ever_blocked"), verdict(
            "BLOCKED_CHAIN", "WARNING", "high",
            "a JVM housekeeping thread has no business waiting for a monitor; its duty stalls", F.col("_w")))
         .when(house, verdict("HOUSEKEEPING", None, "high", "JVM housekeeping thread on duty", None))
         .when(F.col("cls_kind") == "IDLE", verdict(
             "IDLE", None, "high", F.concat(F.lit("top frames match the known pattern \""),
                                            F.col("cls_label"), F.lit("\"")), None))
         .when(F.col("ever_blocked"), verdict(
             "BLOCKED_CHAIN", F.when(F.col("_w") >= critical_victims, "CRITICAL").otherwise("WARNING"),
             F.when(known_holder, "high").otherwise("medium"), chain_why, F.col("_w")))
         .when(cpu_known & (ratio <= IDLE_RATIO) & (F.col("cpu_delta_ms") < IDLE_CPU_MS)
               & F.col("top_native"), verdict(
                   "NATIVE_WAIT", "INFO", "high",
                   F.concat(F.lit("only "), cpu_text, F.lit(" inside a native frame")), None))
         .when(cpu_known & (ratio >= SPIN_RATIO), verdict(
             "SPINNING", harm, "high",
             F.concat(cpu_text, F.lit(" on an unchanged stack")), F.col("_held")))
         .when(cpu_known, verdict(
             "FROZEN", "WARNING", "medium",
             F.concat(F.lit("unchanged stack with "), cpu_text), F.col("_held")))
         .when(F.col("_hot").isNotNull(), verdict(
             "SPINNING", harm, "medium",
             F.concat(F.lit("the OS sample shows "), F.col("_hot").cast("string"),
                      F.lit("% CPU on an unchanged stack")), F.col("_held")))
         .when(F.col("_cold").isNotNull() & F.col("top_native"), verdict(
             "NATIVE_WAIT", "INFO", "medium",
             F.concat(F.lit("the OS sample shows "), F.col("_cold").cast("string"),
                      F.lit("% CPU inside a native frame")), None))
         .when(F.col("pool").isNotNull() | app, verdict(
             "FROZEN", "WARNING", "medium",
             F.when(app, "no CPU evidence; the unchanged stack has application frames and no idle pattern")
             .otherwise("no CPU evidence; the unchanged stack belongs to a known worker pool"),
             F.col("_held")))
         .otherwise(verdict("DISCARDED", None, "low", "too little evidence to report", None)))
    return df.withColumn("_v", v).select(*candidates.columns, "_v.*")


def genuine(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("kind").isin(*GENUINE))
