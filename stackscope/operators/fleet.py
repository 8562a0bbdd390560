"""Comparing nodes. A node is a series, so every operator already runs per node;
only the comparison itself is added here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.knowledge import THREAD_STATES
from stackscope.operators.derive import java_threads
from stackscope.operators.series import dump_count, node_pool_busy
from stackscope.operators.single import count_if, recurring_stacks, stack_groups

STATE_DIVERGENCE_PP = 20.0
POOL_DIVERGENCE_PP = 30.0
UNIQUE_STACK_MIN_COUNT = 5


def node_states(t: DataFrame) -> DataFrame:
    """Share of every state per node, zeros included."""
    counts = java_threads(t).groupBy("series_id").agg(
        F.count("*").alias("_n"), *[count_if(F.col("state") == s).alias(s) for s in THREAD_STATES])
    rows = F.array(*[F.struct(F.lit(s).alias("state"), (
        100.0 * F.col(s) / F.greatest(F.lit(1), F.col("_n"))).alias("percent")) for s in THREAD_STATES])
    return counts.select("series_id", F.explode(rows).alias("r")).select("series_id", "r.*")


def node_stacks(t: DataFrame, top_stacks: int = 15) -> DataFrame:
    """Stacks among the largest of some dump of a node, with their largest count over its dumps."""
    return stack_groups(t, top_stacks).groupBy("series_id", "stack_hash").agg(
        F.max("n").alias("n"), F.min_by("stack", F.struct("dump_idx", "rank")).alias("stack"),
        F.min(F.struct("dump_idx", "rank")).alias("_first"))


def node_top_stacks(t: DataFrame, top_stacks: int = 15, n: int = 5) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy(F.desc("n"), "_first", "stack_hash")
    return node_stacks(t, top_stacks).withColumn("rank", F.row_number().over(w)) \
        .filter(F.col("rank") <= n).drop("_first")


def node_summary(t: DataFrame, dump: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row per node: dumps, threads of its last dump, state and finding counts."""
    last = dump.groupBy("series_id").agg(F.max("dump_idx").alias("dump_idx"))
    in_last = java_threads(t).join(last, ["series_id", "dump_idx"]).groupBy("series_id").agg(
        F.count("*").alias("threads"))
    states = node_states(t).groupBy("series_id").agg(*[
        F.max(F.when(F.col("state") == s, F.round("percent", 1))).alias(s.lower() + "_pct")
        for s in THREAD_STATES])
    out = dump_count(dump).withColumnRenamed("n_dumps", "dumps").join(in_last, "series_id", "left") \
        .join(states, "series_id", "left").withColumn("threads", F.coalesce("threads", F.lit(0)))
    if findings is not None:
        out = out.join(findings.groupBy("series_id").agg(*[
            count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "WARNING", "INFO")]),
            "series_id", "left").fillna(0, ["critical", "warning", "info"])
    return out


def state_outliers(t: DataFrame) -> DataFrame:
    """Nodes whose share of a state is more than 20 points off the fleet median."""
    shares = node_states(t)
    med = shares.groupBy("state").agg(F.percentile("percent", 0.5).alias("median"),
                                      F.count("*").alias("_nodes")).filter("_nodes >= 2")
    return shares.join(med, "state").filter(
        F.abs(F.col("percent") - F.col("median")) > STATE_DIVERGENCE_PP).drop("_nodes")


def unique_stack_outliers(t: DataFrame) -> DataFrame:
    """Stacks shared by at least five threads on one node and recurring on no other, however small there."""
    stacks = recurring_stacks(t).groupBy("series_id", "stack_hash").agg(
        F.max("n").alias("n"), F.min_by("stack", "dump_idx").alias("stack"))
    seen = stacks.groupBy("stack_hash").agg(F.count("*").alias("_nodes"), F.min("series_id").alias("_node"))
    nodes = java_threads(t).agg(F.count_distinct("series_id")).scalar()
    own = stacks.join(seen.filter("_nodes = 1"), "stack_hash").filter(F.col("n") >= UNIQUE_STACK_MIN_COUNT)
    return own.filter(nodes >= 2).select(
        "series_id", "stack_hash", "n",
        F.coalesce(F.regexp_replace(F.try_element_at("stack", F.lit(1)), r"\(.*", ""),
                   F.lit("an unrecognized stack")).alias("where"))


def pool_outliers(t: DataFrame) -> DataFrame:
    """Nodes whose pool load is more than 30 points off the median of nodes having the pool."""
    busy = node_pool_busy(t)
    med = busy.groupBy("pool").agg(F.percentile("busy_pct", 0.5).alias("median"),
                                   F.count("*").alias("_nodes")).filter("_nodes >= 2")
    return busy.join(med, "pool").filter(
        F.abs(F.col("busy_pct") - F.col("median")) > POOL_DIVERGENCE_PP).drop("_nodes")


def outliers(t: DataFrame) -> DataFrame:
    """(node, kind, explanation) of every outlier."""
    def pct(c):
        return F.concat(F.round(c).cast("long").cast("string"), F.lit("%"))
    def row(df, kind, text):
        return df.select(F.col("series_id").alias("node"), F.lit(kind).alias("kind"), text.alias("explanation"))
    head = F.concat(F.lit("node "), F.col("series_id"), F.lit(" diverges: "))
    return row(state_outliers(t), "state-distribution", F.concat(
        head, pct("percent"), F.lit(" of threads "), F.col("state"), F.lit(" (fleet median: "),
        pct("median"), F.lit(")"))).unionByName(
        row(unique_stack_outliers(t), "unique-stack", F.concat(
            head, F.col("n").cast("string"), F.lit(" threads share a stack in "), F.col("where"),
            F.lit(" that no other node shows (fleet median: 0)")))).unionByName(
        row(pool_outliers(t), "pool-utilization", F.concat(
            head, F.lit("pool \""), F.col("pool"), F.lit("\" is "), pct("busy_pct"),
            F.lit(" busy (fleet median: "), pct("median"), F.lit(")"))))


def fleet_detail(result: DataFrame, node: str) -> DataFrame:
    """One node's rows of any result table; partition pruning does the rest."""
    return result.filter(F.col("series_id") == node)
