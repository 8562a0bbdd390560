"""Operators across the dumps of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.functions.names import is_stuck_marked
from stackscope.operators.derive import java_threads
from stackscope.operators.locks import held_by, lock_holders, lock_wait
from stackscope.operators.single import pool_stats, recurring_stacks

DUMP = ["series_id", "dump_idx"]
OCC = ["series_id", "key"]
HOLDER = ["series_id", "holder_key", "lock_class"]


def dump_count(dump: DataFrame) -> DataFrame:
    return dump.groupBy("series_id").agg(F.count("*").alias("n_dumps"))


def series_index(t: DataFrame) -> DataFrame:
    """One occurrence per thread key and dump; of duplicate keys the last wins.

    Duplicates are found on the key and the ordinal alone; the other columns come back by a join, so a query
    that uses one number of an occurrence reads no frames.
    """
    last = t.groupBy(*DUMP, "key").agg(F.max("thread_ord").alias("thread_ord"))
    return t.join(last, [*DUMP, "key", "thread_ord"], "left_semi").select(
        *DUMP, "key", *[c for c in t.columns if c not in (*DUMP, "key")])


def key_summary(occ: DataFrame) -> DataFrame:
    """Per key: display name, first and latest dump."""
    return occ.groupBy(*OCC).agg(
        F.min_by("norm_name", "dump_idx").alias("display_name"),
        F.min("dump_idx").alias("first_dump"), F.max("dump_idx").alias("latest_dump"),
        F.count("*").alias("seen"))


def all_timelines(occ: DataFrame) -> DataFrame:
    """State per key and dump; VM threads keep the row with a null state."""
    names = key_summary(occ).select(*OCC, "display_name")
    return occ.select(*DUMP, "key", F.when(~F.col("is_vm"), F.col("state")).alias("state")) \
        .join(names, OCC)


#: what a run of equal fingerprints carries; runs that touch merge by these columns alone
RUN = """series_id string, key string, fp string, display_name string, from_dump int, to_dump int, runnable_at int, blocked_at int,
    cpu_first double, cpu_last double, from_ts timestamp, to_ts timestamp"""


def stack_runs(occ: DataFrame, dump: DataFrame) -> DataFrame:
    """Runs (of one dump or more) of consecutive dumps in which a RUNNABLE or BLOCKED thread kept its fingerprint.

    The window sees one narrow row per dump of a key.
    """
    whole = Window.partitionBy(*OCC).orderBy("dump_idx")
    narrow = occ.select(*DUMP, "key", "fp", "state", "cpu_ms",
                        F.first("norm_name").over(whole).alias("display_name"))
    ok = narrow.filter(F.col("fp").isNotNull() & F.col("state").isin("RUNNABLE", "BLOCKED"))
    ok = ok.join(dump.select(*DUMP, "ts"), DUMP)
    at = F.col("dump_idx")
    one = ok.select(
        "series_id", "key", "fp", "display_name", at.alias("from_dump"), at.alias("to_dump"),
        F.when(F.col("state") == "RUNNABLE", at).alias("runnable_at"), F.when(F.col("state") == "BLOCKED", at).alias("blocked_at"),
        F.col("cpu_ms").alias("cpu_first"), F.col("cpu_ms").alias("cpu_last"), F.col("ts").alias("from_ts"), F.col("ts").alias("to_ts"))
    return merge_runs(one)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs that touch become one. Merging is associative, so parts of a series can be merged in any order."""
    same = Window.partitionBy(*OCC, "fp").orderBy("from_dump")
    begins = F.col("from_dump") != F.coalesce(F.lag("to_dump").over(same), F.lit(-2)) + 1
    islands = runs.withColumn("_b", begins.cast("int")).withColumn("_island", F.sum("_b").over(same))
    last = F.struct("cpu_last", "to_ts")
    first = F.struct("display_name", "cpu_first", "from_ts")
    return islands.groupBy(*OCC, "fp", "_island").agg(
        F.min_by(first, "from_dump").alias("_f"), F.max_by(last, "to_dump").alias("_l"),
        F.min("from_dump").alias("from_dump"), F.max("to_dump").alias("to_dump"),
        F.min("runnable_at").alias("runnable_at"), F.min("blocked_at").alias("blocked_at")).select(
        "series_id", "key", "fp", "_f.display_name", "from_dump", "to_dump", "runnable_at", "blocked_at",
        "_f.cpu_first", "_l.cpu_last", "_f.from_ts", "_l.to_ts")


def run_candidates(runs: DataFrame, occ: DataFrame, k: int = 3, max_frames: int = 40) -> DataFrame:
    """Runs of at least k dumps with what their thread did in the last of them; ``occ`` must hold that dump."""
    runs = runs.withColumn("run_length", F.col("to_dump") - F.col("from_dump") + 1).filter(F.col("run_length") >= max(2, k))
    states = (F.when(F.col("blocked_at").isNull(), F.array(F.lit("RUNNABLE")))
              .when(F.col("runnable_at").isNull(), F.array(F.lit("BLOCKED")))
              .when(F.col("runnable_at") < F.col("blocked_at"), F.array(F.lit("RUNNABLE"), F.lit("BLOCKED")))
              .otherwise(F.array(F.lit("BLOCKED"), F.lit("RUNNABLE"))))
    runs = runs.withColumn("states", states).withColumn("ever_blocked", F.col("blocked_at").isNotNull())
    ms = F.unix_millis("to_ts") - F.unix_millis("from_ts")
    last = occ.select(
        "series_id", F.col("dump_idx").alias("to_dump"), "key", "tid_hex", "name", "nid_dec", "pool",
        "cls_kind", "cls_label", "frames", "wait_lock",
        F.get("frames", F.lit(0))["native"].alias("top_native"))
    return runs.join(last, ["series_id", "to_dump", "key"]).select(
        "series_id", "key", F.col("display_name").alias("name"), F.col("name").alias("last_name"),
        "tid_hex", "from_dump", "to_dump", "run_length", "states", "ever_blocked", "fp",
        F.slice(F.transform("frames", lambda f: f["raw"]), 1, max_frames).alias("frozen_frames"),
        "cpu_first", "cpu_last", (F.col("cpu_last") - F.col("cpu_first")).alias("cpu_delta_ms"),
        F.when(F.col("to_ts") > F.col("from_ts"), ms / 1000.0).alias("wall_s"),
        F.coalesce("top_native", F.lit(False)).alias("top_native"),
        "nid_dec", "pool", "cls_kind", "cls_label", "frames", "wait_lock")


def stuck_candidates(occ: DataFrame, dump: DataFrame, k: int = 3, max_frames: int = 40) -> DataFrame:
    """Runs of at least k consecutive dumps with the same fingerprint.

    Only RUNNABLE or BLOCKED threads with frames take part. Wide columns come back by a join on the few runs.
    """
    return run_candidates(stack_runs(occ, dump), occ, k, max_frames)


def _starved_pairs(t: DataFrame) -> DataFrame:
    """(dump, address, waiter, holder): one row per wait for a lock that another thread holds."""
    holder_key = t.select(*DUMP, F.col("thread_ord").alias("holder_ord"), F.col("key").alias("holder_key"))
    waits = lock_wait(t).select(*DUMP, "address", "thread_ord", F.col("key").alias("waiter_key"), "name")
    held = lock_holders(t).join(holder_key, [*DUMP, "holder_ord"]).select(
        *DUMP, "address", F.coalesce("hold_cls", F.lit("?")).alias("lock_class"), "holder", "holder_key")
    return held_by(waits, held).filter("waiter_key <> holder_key").drop("thread_ord")


def _lasting(per_dump: DataFrame, min_dumps: int) -> DataFrame:
    """Holders with waiters in that many dumps in a row, and their longest run."""
    w = Window.partitionBy(*HOLDER).orderBy("dump_idx")
    runs = per_dump.withColumn("_island", F.col("dump_idx") - F.row_number().over(w)) \
        .groupBy(*HOLDER, "_island").agg(F.count("*").alias("_len"))
    return runs.groupBy(*HOLDER).agg(F.max("_len").alias("longest_run")).filter(F.col("longest_run") >= min_dumps)


def persistent_lock_holders(t: DataFrame, min_dumps: int = 2, samples: int = 5) -> DataFrame:
    """Holders of a contended lock over consecutive dumps, by lock class.

    starved_total counts the distinct waiters over all dumps of the holder and class; sample_waiters are the first
    ``samples`` of their names, ``lock_holder_waiters`` has all of them.
    """
    pair = _starved_pairs(t)
    per_dump = pair.groupBy(*HOLDER, "dump_idx").agg(F.count("*").alias("waiters"))
    totals = per_dump.groupBy(*HOLDER).agg(
        F.count("*").alias("dumps"), F.max("waiters").alias("max_waiters"))
    # distinct in two steps, so one starving lock does not land in a single task
    waiters = pair.groupBy(*HOLDER, "waiter_key").agg(F.min("name").alias("name"))
    starved = waiters.groupBy(*HOLDER).agg(F.count("*").alias("starved_total"))
    w = Window.partitionBy(*HOLDER).orderBy("name", "waiter_key")
    shown = waiters.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= samples).groupBy(*HOLDER).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "name"))), lambda s: s["name"]).alias("sample_waiters"))
    name = pair.groupBy(*HOLDER).agg(F.min_by("holder", "dump_idx").alias("holder"))
    return _lasting(per_dump, min_dumps).join(totals, HOLDER).join(starved, HOLDER).join(shown, HOLDER).join(name, HOLDER)


def lock_holder_waiters(t: DataFrame, min_dumps: int = 2) -> DataFrame:
    """Every thread that waited for a persistent holder, with the dumps it did so in."""
    pair = _starved_pairs(t)
    kept = _lasting(pair.select(*HOLDER, "dump_idx").distinct(), min_dumps)
    return pair.groupBy(*HOLDER, "waiter_key").agg(
        F.min("name").alias("name"), F.count_distinct("dump_idx").alias("dumps"),
        F.min("dump_idx").alias("from_dump"), F.max("dump_idx").alias("to_dump")).join(kept, HOLDER, "left_semi")


def lock_holder_dumps(t: DataFrame) -> DataFrame:
    """Per holder, class and dump: the waiters, and the addresses (a thread's own locks) they wait for."""
    per = _starved_pairs(t).groupBy(*HOLDER, "dump_idx", "address").agg(F.count("*").alias("_n"))
    return per.groupBy(*HOLDER, "dump_idx").agg(
        F.sum("_n").alias("waiters"), F.count("*").alias("addresses"),
        F.array_sort(F.collect_list("address")).alias("address_list"))


def pool_counts(t: DataFrame) -> DataFrame:
    return java_threads(t).filter(F.col("pool").isNotNull()).groupBy(*DUMP, "pool").agg(
        F.count("*").alias("n"))


def pool_trend(t: DataFrame, dump: DataFrame, leak_min_growth: int = 5) -> DataFrame:
    """Growth and leak verdict per pool, absent dumps counting as zero.

    Zeros are never materialised: a gap between two present dumps, or after the
    last one, is itself the decrease.
    """
    w = Window.partitionBy("series_id", "pool").orderBy("dump_idx")
    step = pool_counts(t).withColumn("_p", F.lag("n").over(w)).withColumn("_pi", F.lag("dump_idx").over(w))
    agg = step.groupBy("series_id", "pool").agg(
        F.min("dump_idx").alias("first_dump"), F.max("dump_idx").alias("last_dump"),
        F.min_by("n", "dump_idx").alias("_n0"), F.max_by("n", "dump_idx").alias("_n1"),
        F.max("n").alias("peak"),
        F.coalesce(F.bool_or((F.col("n") < F.col("_p")) | (F.col("dump_idx") - F.col("_pi") > 1)),
                   F.lit(False)).alias("_fell"),
        F.coalesce(F.bool_or(F.col("n") > F.col("_p")), F.lit(False)).alias("_rose"))
    j = agg.join(dump_count(dump), "series_id")
    ends = F.col("last_dump") == F.col("n_dumps") - 1
    starts = F.col("first_dump") == 0
    growth = F.when(ends, F.col("_n1")).otherwise(0) - F.when(starts, F.col("_n0")).otherwise(0)
    leak = ((F.col("n_dumps") >= 3) & ~F.col("_fell") & ends & (F.col("_rose") | ~starts)
            & (growth >= leak_min_growth))
    return j.select("series_id", "pool", "n_dumps", "peak",
                    F.when(starts, F.col("_n0")).otherwise(0).alias("first_count"),
                    F.when(ends, F.col("_n1")).otherwise(0).alias("last_count"),
                    growth.alias("growth"), leak.alias("leak_suspect"))


def pool_trend_counts(t: DataFrame, dump: DataFrame) -> DataFrame:
    """Count per pool and dump with the zeros written out."""
    counts = pool_counts(t)
    grid = counts.select("series_id", "pool").distinct().join(dump_count(dump), "series_id").select(
        "series_id", "pool", F.explode(F.sequence(F.lit(0), F.col("n_dumps").cast("int") - 1)).alias("dump_idx"))
    return grid.join(counts, ["series_id", "pool", "dump_idx"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))


def pool_trend_top(t: DataFrame, n: int = 8) -> DataFrame:
    """The n pools with the highest peak and the rest summed, per dump."""
    counts = pool_counts(t)
    peaks = counts.groupBy("series_id", "pool").agg(F.max("n").alias("peak"))
    w = Window.partitionBy("series_id").orderBy(F.desc("peak"), "pool")
    ranked = peaks.withColumn("_rank", F.row_number().over(w))
    rest = ranked.filter(F.col("_rank") > n).groupBy("series_id").agg(F.count("*").alias("_rest"))
    label = F.when(F.col("_rank") <= n, F.col("pool")).otherwise(
        F.concat(F.lit("Other ("), F.col("_rest").cast("string"), F.lit(" pools)")))
    named = ranked.join(rest, "series_id", "left").select(
        "series_id", "pool", label.alias("line"))
    return counts.join(named, ["series_id", "pool"]).groupBy(*DUMP, "line").agg(F.sum("n").alias("n"))


def flag_rows(t: DataFrame, stuck: DataFrame, holders: DataFrame, jvm_cycle: DataFrame) -> DataFrame:
    """(series, key, flag, flag_ord) of every flagged thread."""
    def rows(df, flag, order):
        return df.select("series_id", "key", F.lit(flag).alias("flag"), F.lit(order).alias("flag_ord"))
    first = t.groupBy(*DUMP, F.col("name").alias("thread_name")).agg(F.min_by("key", "thread_ord").alias("key"))
    dead = jvm_cycle.select(*DUMP, "thread_name").distinct().join(first, [*DUMP, "thread_name"])
    marked = t.filter(is_stuck_marked(F.col("name")))
    return (rows(stuck, "stuck", 0)
            .unionByName(rows(holders.withColumnRenamed("holder_key", "key"), "persistent-lock-holder", 1))
            .unionByName(rows(dead, "deadlock", 2))
            .unionByName(rows(marked, "weblogic-stuck-marker", 3))).distinct()


def flagged_timelines(occ: DataFrame, flags: DataFrame, limit: int | None = 150) -> DataFrame:
    """Timelines of the first ``limit`` flagged threads of a series (None: of all) with all their flags."""
    by_key = flags.groupBy(*OCC).agg(
        F.min("flag_ord").alias("_o"),
        F.transform(F.array_sort(F.collect_set(F.struct("flag_ord", "flag"))),
                    lambda s: s["flag"]).alias("flags"))
    kept = by_key
    if limit is not None:
        seen = occ.groupBy(*OCC).agg(F.min("dump_idx").alias("_f"))
        w = Window.partitionBy("series_id").orderBy("_o", "_f", "key")
        kept = by_key.join(seen, OCC).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    kept = kept.select(*OCC, "flags")
    names = key_summary(occ).select(*OCC, "display_name")
    return occ.select(*DUMP, "key", "state").join(kept, OCC).join(names, OCC)


def cpu_delta(occ: DataFrame, dump: DataFrame) -> DataFrame:
    """Per key: CPU between its first and last dump with CPU data, and the wall time."""
    ts = dump.select(*DUMP, "ts")
    has = occ.filter(F.col("cpu_ms").isNotNull()).select(*DUMP, "key", "cpu_ms").join(ts, DUMP)
    agg = has.groupBy(*OCC).agg(
        F.min_by(F.struct("cpu_ms", "ts"), "dump_idx").alias("a"),
        F.max_by(F.struct("cpu_ms", "ts"), "dump_idx").alias("b"),
        F.min("dump_idx").alias("_i0"), F.max("dump_idx").alias("_i1"))
    wall = (F.unix_millis("b.ts") - F.unix_millis("a.ts")).cast("double")
    return agg.filter("_i1 > _i0").filter(F.col("b.ts") > F.col("a.ts")).select(
        *OCC, (F.col("b.cpu_ms") - F.col("a.cpu_ms")).alias("delta_ms"), wall.alias("wall_ms"),
        ((F.col("b.cpu_ms") - F.col("a.cpu_ms")) / F.greatest(wall, F.lit(1.0))).alias("ratio"))


def longest_runs(matches: DataFrame, by: list[str]) -> DataFrame:
    """Longest stretch of consecutive dumps per key among (by, key, dump_idx) rows."""
    ident = [*by, "key"]
    w = Window.partitionBy(*ident).orderBy("dump_idx")
    return matches.select(*ident, "dump_idx").distinct() \
        .withColumn("_island", F.col("dump_idx") - F.row_number().over(w)) \
        .groupBy(*ident, "_island").agg(F.count("*").alias("run")) \
        .groupBy(*ident).agg(F.max("run").alias("run"))


def baseline_header(t: DataFrame, dump: DataFrame) -> DataFrame:
    java = java_threads(t).groupBy("series_id").agg(F.count("*").alias("_n"))
    return dump_count(dump).join(java, "series_id", "left").select(
        "series_id", F.col("n_dumps").alias("dumps"),
        F.round(F.coalesce("_n", F.lit(0)) / F.col("n_dumps"), 2).alias("avg_threads"))


def baseline_state(t: DataFrame) -> DataFrame:
    n = java_threads(t).groupBy("series_id", "state").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("series_id"))
    return n.select("series_id", "state", F.round(100.0 * F.col("_n") / total, 2).alias("percent"))


def baseline_pool(t: DataFrame, dump: DataFrame) -> DataFrame:
    n = java_threads(t).filter(F.col("pool").isNotNull()).groupBy("series_id", "pool").agg(
        F.count("*").alias("_n"))
    return n.join(dump_count(dump), "series_id").select(
        "series_id", "pool", F.round(F.col("_n") / F.col("n_dumps"), 2).alias("avg"))


def baseline_stack(t: DataFrame) -> DataFrame:
    """Every recurring stack: one left out would be reported as new later."""
    return recurring_stacks(t, 1).select("series_id", "stack_hash").distinct()


def node_pool_busy(t: DataFrame) -> DataFrame:
    return pool_stats(t).groupBy("series_id", "pool").agg(
        (100.0 * F.sum("busy") / F.sum("size")).alias("busy_pct"))
