"""Data-quality notes on a series of dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.functions.scan import running
from stackscope.operators.rules import union_all
from stackscope.operators.series import dump_count

ISSUES_SHOWN = 5
GAP_SECONDS = 60


def _note(df: DataFrame, level: str, code: str, message) -> DataFrame:
    return df.select("series_id", F.lit(level).alias("level"), F.lit(code).alias("code"),
                     message.alias("message"))


def clock_skew(occ: DataFrame, dump: DataFrame) -> DataFrame:
    """First adjacent pair per series whose thread clocks disagree with the dump times.

    The upper median is found over counted distinct deltas with a running sum, so
    no group of threads has to fit into one task.
    """
    w = Window.partitionBy("series_id", "key").orderBy("dump_idx")
    pairs = occ.filter(F.col("elapsed_s").isNotNull()).select("series_id", "key", "dump_idx", "elapsed_s") \
        .withColumn("_pi", F.lag("dump_idx").over(w)).withColumn("_pe", F.lag("elapsed_s").over(w)) \
        .filter(F.col("dump_idx") == F.col("_pi") + 1)
    counts = pairs.groupBy("series_id", "dump_idx", (F.col("elapsed_s") - F.col("_pe")).alias("delta")) \
        .agg(F.count("*").alias("n")).withColumn("_chunk", F.floor(F.col("delta")))
    run = running(counts, ["series_id", "dump_idx"], "_chunk", ["delta"], total={"upto": F.col("n")})
    total = counts.groupBy("series_id", "dump_idx").agg(F.sum("n").alias("matched")).filter("matched >= 3")
    median = run.join(total, ["series_id", "dump_idx"]).filter(
        F.col("upto") >= F.floor(F.col("matched") / 2) + 1) \
        .groupBy("series_id", "dump_idx").agg(F.min("delta").alias("median"))
    dw = Window.partitionBy("series_id").orderBy("dump_idx")
    wall = dump.select("series_id", "dump_idx", (
        (F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(dw))) / 1000.0).alias("wall"))
    diff = F.abs(F.col("median") - F.col("wall"))
    return median.join(wall, ["series_id", "dump_idx"]).filter(
        (F.col("wall") > 0) & (diff > 5) & (diff > 0.2 * F.col("wall"))) \
        .groupBy("series_id").agg(F.min_by(F.struct("dump_idx", "wall", "median"), "dump_idx").alias("s")) \
        .select("series_id", "s.*")


def gaps(dump: DataFrame) -> DataFrame:
    """Adjacent dumps more than a minute apart, with whole seconds between them."""
    w = Window.partitionBy("series_id").orderBy("dump_idx")
    before = F.lag("ts").over(w)
    return dump.select("series_id", "dump_idx", F.floor(
        (F.unix_micros("ts") - F.unix_micros(before)) / 1_000_000).alias("seconds")) \
        .filter(F.col("seconds") > GAP_SECONDS)


def quality_notes(dump: DataFrame, occ: DataFrame, parse_issue: DataFrame) -> DataFrame:
    n = dump_count(dump)
    single = _note(n.filter("n_dumps = 1"), "WARNING", "single-dump",
                   F.lit("One dump only: stuck threads, trends and persistence cannot be judged."))
    sync = _note(dump.groupBy("series_id").agg(F.bool_or("saw_sync").alias("s")).filter("NOT s"),
                 "WARNING", "no-synchronizers",
                 F.lit("No dump lists ownable synchronizers; owners of java.util.concurrent locks are unknown."))
    w = Window.partitionBy("series_id").orderBy("dump_idx", "where", "message")
    ranked = parse_issue.select("series_id", "dump_idx", "where", "message",
                                F.row_number().over(w).alias("rn"))
    issues = _note(ranked.filter(F.col("rn") <= ISSUES_SHOWN), "INFO", "parse-issue",
                   F.concat_ws(": ", F.lit("Parse"), "where", "message"))
    more = parse_issue.groupBy("series_id").agg(F.count("*").alias("n")).filter(F.col("n") > ISSUES_SHOWN)
    more = _note(more, "INFO", "parse-issues-omitted", F.concat(
        F.lit("Parse: "), (F.col("n") - ISSUES_SHOWN).cast("string"), F.lit(" further note(s) omitted")))
    banners = dump.filter(F.col("banner") != "").groupBy("series_id").agg(
        F.count_distinct("banner").alias("n")).filter("n > 1")
    mixed = _note(banners, "WARNING", "mixed-jvms", F.concat(
        F.lit("Dumps of "), F.col("n").cast("string"), F.lit(" different JVMs are compared as one series.")))
    moved = _note(dump.groupBy("series_id").agg(F.bool_or("reordered").alias("r")).filter("r"),
                  "INFO", "out-of-order", F.lit("Input was not in time order and has been sorted."))
    g = gaps(dump)
    gap = _note(g, "WARNING", "gap", F.concat(
        F.lit("Dumps "), (F.col("dump_idx") - 1).cast("string"), F.lit(" and "),
        F.col("dump_idx").cast("string"), F.lit(" are "), F.col("seconds").cast("string"),
        F.lit(" s apart.")))
    sk = clock_skew(occ, dump)
    skew = _note(sk, "WARNING", "clock-skew", F.concat(
        F.lit("Clocks disagree between dumps "), (F.col("dump_idx") - 1).cast("string"), F.lit(" and "),
        F.col("dump_idx").cast("string"), F.lit(": "), F.format_number("wall", 1), F.lit(" s by timestamp, "),
        F.format_number("median", 1), F.lit(" s by thread clocks.")))
    return union_all([single, sync, issues, more, mixed, moved, gap, skew])
