"""Per-dump aggregates. Input is the derived thread table unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.functions.frames import annotated_stack, stack_key
from stackscope.functions.names import is_stuck_marked
from stackscope.knowledge import THREAD_STATES
from stackscope.operators.derive import java_threads

DUMP = ["series_id", "dump_idx"]


def count_if(cond):
    return F.count(F.when(cond, 1))


def state_distribution(t: DataFrame) -> DataFrame:
    """Per dump: java, daemon and VM thread counts."""
    java = ~F.col("is_vm")
    return t.groupBy(*DUMP).agg(
        count_if(java).alias("total"),
        count_if(java & F.col("daemon")).alias("daemon"),
        count_if(F.col("is_vm")).alias("vm_threads"))


def state_counts(t: DataFrame) -> DataFrame:
    """Per dump and state: count and percent of the java threads."""
    counts = java_threads(t).groupBy(*DUMP, "state").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*DUMP))
    return counts.withColumn("percent", 100.0 * F.col("n") / total)


def pool_stats(t: DataFrame) -> DataFrame:
    """Per dump and pool: size, one count per state, stuck-marked, busy, idle."""
    return java_threads(t).filter(F.col("pool").isNotNull()).groupBy(*DUMP, "pool").agg(
        F.count("*").alias("size"),
        *[count_if(F.col("state") == s).alias(s.lower()) for s in THREAD_STATES],
        count_if(is_stuck_marked(F.col("name"))).alias("stuck"),
        count_if(F.col("cls_kind") == "APPLICATION").alias("busy"),
    ).withColumn("idle", F.col("size") - F.col("busy"))


def category_breakdown(t: DataFrame) -> DataFrame:
    return java_threads(t).filter(F.col("category").isNotNull()) \
        .groupBy(*DUMP, "category").agg(F.count("*").alias("n"))


def recurring_stacks(t: DataFrame, max_frames: int = 40) -> DataFrame:
    """All stacks shared by at least two threads of a dump; ``max_frames`` of each are shown.

    Partial counts are built before the shuffle, so one stack shared by most
    threads costs no more than any other.
    """
    first = F.struct("thread_ord", "name")
    return java_threads(t).filter(F.col("stack_hash").isNotNull()).groupBy(*DUMP, "stack_hash").agg(
        F.count("*").alias("n"),
        F.min("thread_ord").alias("first_ord"),
        F.min_by(F.slice(F.transform("frames", lambda f: f["raw"]), 1, max_frames), first).alias("stack"),
        *[count_if(F.col("state") == s).alias(s.lower()) for s in THREAD_STATES],
    ).filter("n >= 2")


def stack_groups(t: DataFrame, top_n: int = 15, max_frames: int = 40) -> DataFrame:
    """The largest stacks shared by at least two threads of a dump, biggest first, for display."""
    w = Window.partitionBy(*DUMP).orderBy(F.desc("n"), "first_ord", "stack_hash")
    return recurring_stacks(t, max_frames).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


def stack_group_members(t: DataFrame, limit: int = 25) -> DataFrame:
    """Names of the first threads in each stack group."""
    w = Window.partitionBy(*DUMP, "stack_hash").orderBy("thread_ord")
    return java_threads(t).filter(F.col("stack_hash").isNotNull()).select(
        *DUMP, "stack_hash", "thread_ord", "name", F.row_number().over(w).alias("rank")) \
        .filter(F.col("rank") <= limit)


def method_stats(t: DataFrame, n: int = 15) -> DataFrame:
    """Most frequent top frames (last_executed) and frames anywhere (most_used) per dump."""
    java = java_threads(t).filter(F.size("frames") > 0)
    top = java.select(*DUMP, F.lit("last_executed").alias("kind"),
                      F.get("frames", F.lit(0))["sig"].alias("method"), "thread_ord",
                      F.lit(0).alias("pos"))
    used = java.select(*DUMP, "thread_ord", F.posexplode(F.transform("frames", lambda f: f["sig"]))) \
        .select(*DUMP, F.lit("most_used").alias("kind"), F.col("col").alias("method"), "thread_ord", "pos")
    counts = top.unionByName(used).groupBy(*DUMP, "kind", "method").agg(
        F.count("*").alias("n"), F.min(F.struct("thread_ord", "pos")).alias("_first"))
    w = Window.partitionBy(*DUMP, "kind").orderBy(F.desc("n"), "_first", "method")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_first")


def gc_jit_sanity(t: DataFrame) -> DataFrame:
    name = F.col("name")
    gc = (name.startswith("GC ") | name.startswith("G1 ") | name.startswith("ZGC")
          | name.startswith("Shenandoah") | name.contains("(ParallelGC)")
          | name.startswith("Gang worker") | name.startswith("Concurrent Mark-Sweep"))
    jit = ~gc & (name.contains("CompilerThread") | name.startswith("Sweeper thread"))
    out = t.groupBy(*DUMP).agg(count_if(gc).alias("gc_threads"), count_if(jit).alias("jit_threads"))
    return out.withColumn("outsized", (F.col("gc_threads") >= 24) | (F.col("jit_threads") >= 8))


def virtual_counts(t: DataFrame) -> DataFrame:
    """Dumps with virtual threads: virtual and platform counts."""
    return t.groupBy(*DUMP).agg(
        count_if(F.col("is_virtual")).alias("virtual"),
        count_if(~F.col("is_vm")).alias("_java")) \
        .filter("virtual > 0") \
        .select(*DUMP, "virtual", (F.col("_java") - F.col("virtual")).alias("platform"))


def carrier_map(t: DataFrame, names: int = 10) -> DataFrame:
    """Virtual threads per carrier: carrier name, count and the first few names."""
    virt = t.filter(F.col("is_virtual") & F.col("carrier_tid").isNotNull())
    w = Window.partitionBy(*DUMP, "carrier_tid").orderBy("thread_ord")
    shown = virt.select(*DUMP, "carrier_tid", "thread_ord", "name", F.row_number().over(w).alias("rn")) \
        .filter(F.col("rn") <= names).groupBy(*DUMP, "carrier_tid") \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("thread_ord", "name"))),
                         lambda s: s["name"]).alias("virtual_names"))
    counts = virt.groupBy(*DUMP, "carrier_tid").agg(F.count("*").alias("n"))
    carriers = t.filter(~F.col("is_virtual") & F.col("java_id").isNotNull()).groupBy(
        *DUMP, F.col("java_id").cast("string").alias("carrier_tid")) \
        .agg(F.min_by("name", "thread_ord").alias("_name"))
    return counts.join(shown, [*DUMP, "carrier_tid"]).join(carriers, [*DUMP, "carrier_tid"], "left").select(
        *DUMP, F.coalesce("_name", F.concat(F.lit("tid "), F.col("carrier_tid"))).alias("carrier"),
        "carrier_tid", "n", "virtual_names")


def cpu_attribution(t: DataFrame, os_sample: DataFrame | None = None, n: int = 40) -> DataFrame:
    """CPU per thread, from the OS sample of its native id or from the header field.

    The sample table is reduced to one row per pid, the last one winning; Spark
    broadcasts it by its own size check or shuffles both sides.
    """
    if os_sample is None:
        joined = t.withColumn("cpu_pct", F.lit(None).cast("double")) \
                  .withColumn("mem_pct", F.lit(None).cast("double"))
    else:
        last = os_sample.groupBy("series_id", F.col("pid").alias("nid_dec")).agg(
            F.max_by("cpu_pct", "sample_ord").alias("cpu_pct"),
            F.max_by("mem_pct", "sample_ord").alias("mem_pct")).filter("nid_dec >= 0")
        joined = t.join(last, ["series_id", "nid_dec"], "left")
    score = F.when(F.col("cpu_pct").isNotNull(), 1_000_000 + F.col("cpu_pct")).otherwise(
        F.coalesce("cpu_ms", F.lit(0.0)))
    w = Window.partitionBy(*DUMP).orderBy(F.desc(score), "thread_ord")
    return joined.filter(F.col("cpu_ms").isNotNull() | F.col("cpu_pct").isNotNull()).select(
        *DUMP, "thread_ord", "name", "nid_hex", "nid_dec", "state", "cpu_ms", "elapsed_s",
        F.col("cpu_pct").alias("top_percent"),
        F.when(F.col("mem_pct") > 0, F.col("mem_pct")).alias("top_mem_percent"),
        F.row_number().over(w).alias("rank")).filter(F.col("rank") <= n)


def pool_utilization(t: DataFrame) -> DataFrame:
    """Per series and pool: average busy percent, biggest size, blocked threads seen."""
    return pool_stats(t).groupBy("series_id", "pool").agg(
        (100.0 * F.sum("busy") / F.sum("size")).alias("avg_busy_pct"),
        F.max("size").alias("max_size"),
        F.sum("blocked").alias("blocked_seen"))


def thread_detail(t: DataFrame, max_frames: int = 40) -> DataFrame:
    """One row per thread with its labels and the key of its shown stack."""
    return t.select(
        *DUMP, "thread_ord", "name", "java_id", "tid_hex", "nid_hex", "nid_dec", "daemon", "prio",
        "state", F.when(F.col("state_detail") == "", F.col("header_cond"))
        .otherwise(F.col("state_detail")).alias("state_detail"),
        "cpu_ms", "elapsed_s", "pool", F.col("cls_label").alias("class"), "activity", "category",
        "is_virtual", "carrier_tid",
        stack_key(F.col("frames"), F.col("locks"), max_frames).alias("stack_key"))


def stack_table(t: DataFrame, max_frames: int = 40) -> DataFrame:
    """Every distinct shown stack once per dump."""
    return t.filter(F.size("frames") > 0).select(
        *DUMP, "thread_ord", stack_key(F.col("frames"), F.col("locks"), max_frames).alias("stack_key"),
        annotated_stack(F.col("frames"), F.col("locks"), max_frames).alias("lines")) \
        .groupBy(*DUMP, "stack_key").agg(F.min_by("lines", "thread_ord").alias("lines"))
