"""Threshold triggers with a cooldown on a stream of process metrics."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stackscope.functions.scan import running
from stackscope.session import cut

TICKS_PER_SECOND = 100
CHUNK_US = 3_600_000_000
OUTPUT = "pid long, ts timestamp, reason string"
STATE = "prev_ticks long, prev_us long, until_us long"


def breaches(metrics: DataFrame, cpu_pct: float | None, thread_count: int | None, cores: int = 1) -> DataFrame:
    """Samples over a threshold with the reason; the CPU threshold is tried first.

    metrics: pid, ts, ticks, thread_count. The first sample of a process only primes.
    """
    df = metrics.withColumn("_us", F.unix_micros("ts")).withColumn("_chunk", F.floor(F.col("_us") / CHUNK_US))
    df = running(df, ["pid"], "_chunk", ["_us"], prev={
        "_prev": F.when(F.col("ticks").isNotNull(), F.struct("ticks", "_us"))})
    wall = (F.col("_us") - F.col("_prev._us")) / 1e6
    used = (F.col("ticks") - F.col("_prev.ticks")) / float(TICKS_PER_SECOND)
    pct = F.when(wall > 0, 100.0 * used / wall / max(1, cores))
    none = F.lit(None).cast("string")
    cpu = none if cpu_pct is None else F.when(pct >= cpu_pct, F.concat(
        F.lit("cpu "), F.format_number(pct, 1), F.lit(f"% >= threshold {cpu_pct:.1f}%")))
    count = none if thread_count is None else F.when(F.col("thread_count") >= thread_count, F.concat(
        F.lit("thread count "), F.col("thread_count").cast("string"), F.lit(f" >= threshold {thread_count}")))
    return df.select("pid", "ts", "_us", F.coalesce(cpu, count).alias("reason")).filter("reason IS NOT NULL")


def threshold_trigger(metrics: DataFrame, cpu_pct: float | None, thread_count: int | None,
                      cooldown_s: float, cores: int = 1) -> DataFrame:
    """Breaches that fire: the first one, then each first one a cooldown after the last.

    Every breach points at the earliest breach a cooldown later; the fires are what
    the first breach reaches. Doubling the pointers finds them in a logarithmic
    number of joins, whatever share of the samples one process has.
    """
    b = cut(breaches(metrics, cpu_pct, thread_count, cores))
    wait = int(cooldown_s * 1_000_000)
    # reversed time turns "the next one at or after" into "the latest one so far"
    targets = b.groupBy("pid", "_us").agg(F.min("reason").alias("reason"))
    points = targets.select("pid", (-F.col("_us")).alias("at"), F.lit(0).alias("_ord"),
                            F.col("_us").alias("hit"), F.lit(None).cast("long").alias("src"))
    probes = targets.select("pid", (-(F.col("_us") + wait)).alias("at"), F.lit(1).alias("_ord"),
                            F.lit(None).cast("long").alias("hit"), F.col("_us").alias("src"))
    both = points.unionByName(probes).withColumn("_chunk", F.floor(F.col("at") / CHUNK_US))
    nxt = running(both, ["pid"], "_chunk", ["at", "_ord"], last={"to": F.col("hit")}) \
        .filter("src IS NOT NULL AND to IS NOT NULL").select("pid", F.col("src").alias("at"), "to")
    if wait == 0:
        fired = targets.select("pid", F.col("_us").alias("at"))
    else:
        jump = cut(nxt)
        fired = cut(targets.groupBy("pid").agg(F.min("_us").alias("at")))
        while not jump.isEmpty():
            fired = cut(fired.unionByName(fired.join(jump, ["pid", "at"]).select(
                "pid", F.col("to").alias("at"))).distinct())
            hop = jump.select("pid", F.col("at").alias("to"), F.col("to").alias("_to"))
            jump = cut(jump.join(hop, ["pid", "to"]).select("pid", "at", F.col("_to").alias("to")))
    return targets.join(fired.withColumnRenamed("at", "_us"), ["pid", "_us"], "left_semi").select(
        "pid", F.timestamp_micros("_us").alias("ts"), "reason")


def step(state: tuple, us: np.ndarray, ticks: np.ndarray, threads: np.ndarray, cpu_pct: float | None,
         thread_count: int | None, wait: int, cores: int) -> tuple[tuple, np.ndarray, list[str]]:
    """New state, places of the samples that fire, and their reasons, of one process's samples in time order.

    state: ticks and time of the last counted sample, and the time until which the trigger rests. Missing ticks are NaN.
    """
    prev_ticks, prev_us, until = state
    known = np.flatnonzero(~np.isnan(ticks))
    pct = np.full(len(us), np.nan)
    if len(known):
        first = [np.nan, 0] if prev_ticks is None else [prev_ticks, prev_us]
        used = np.diff(np.r_[first[0], ticks[known]]) / TICKS_PER_SECOND
        wall = np.diff(np.r_[first[1], us[known]]) / 1e6
        pct[known] = np.where(wall > 0, 100.0 * used / np.where(wall > 0, wall, 1) / max(1, cores), np.nan)
        prev_ticks, prev_us = int(ticks[known[-1]]), int(us[known[-1]])
    none = np.zeros(len(us), bool)
    cpu = none if cpu_pct is None else pct >= cpu_pct
    many = none if thread_count is None else threads >= thread_count
    over = np.flatnonzero(cpu | many)
    fired, reasons, at = [], [], 0
    while True:                                            # one turn for every fire, not for every sample
        if until is not None:
            at = max(at, int(np.searchsorted(us[over], until)))
        if at >= len(over):
            break
        i = over[at]
        fired.append(i)
        reasons.append(f"cpu {pct[i]:,.1f}% >= threshold {cpu_pct:.1f}%" if cpu[i]
                       else f"thread count {int(threads[i])} >= threshold {thread_count}")
        until, at = int(us[i]) + wait, at + 1
    return (prev_ticks, prev_us, until), np.array(fired, int), reasons


def threshold_trigger_stream(metrics: DataFrame, cpu_pct: float | None, thread_count: int | None,
                             cooldown_s: float, cores: int = 1, expire_s: float = 86_400) -> DataFrame:
    """The same on a streaming DataFrame; the state is three numbers per process.

    A process that sends nothing for ``expire_s`` seconds (of processing time) is forgotten: its next sample primes
    anew. The state store must be the RocksDB one, which is set on the session. Samples of one process and one
    micro-batch are ordered in memory, as three numbers each; ``maxFilesPerTrigger`` of the source bounds them.
    """
    wait, expire = int(cooldown_s * 1_000_000), int(expire_s * 1000)
    spark = metrics.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    class Trigger(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("process", STATE, expire)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            parts = [(r["ts"].to_numpy("datetime64[us]").astype(np.int64), r["ticks"].to_numpy(float, na_value=np.nan),
                      r["thread_count"].to_numpy(float, na_value=np.nan)) for r in rows]
            us, ticks, threads = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(us, kind="stable")
            us, ticks, threads = us[order], ticks[order], threads[order]
            before = tuple(self.state.get()) if self.state.exists() else (None, None, None)
            after, fired, reasons = step(before, us, ticks, threads, cpu_pct, thread_count, wait, cores)
            self.state.update(after)
            yield pd.DataFrame({"pid": np.full(len(fired), key[0]), "ts": us[fired].astype("datetime64[us]"),
                                "reason": pd.Series(reasons, dtype=object)})

        def close(self) -> None:
            pass

    return metrics.select("pid", "ts", "ticks", "thread_count").groupBy("pid").transformWithStateInPandas(
        Trigger(), OUTPUT, "append", "processingTime")
