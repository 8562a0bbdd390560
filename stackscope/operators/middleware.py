"""Which application server a series comes from, and its pool health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.functions.names import (
    connector_of, is_muxer, is_stuck_marked, queue_of, support_connector_of, worker_group,
)
from stackscope.functions.text import full_match
from stackscope.knowledge import MIDDLEWARE_SIGNALS, PLATFORM_MIN_SCORE, PLATFORMS
from stackscope.operators.single import count_if

DUMP = ["series_id", "dump_idx"]


def _any_class_starts(prefix: str):
    return F.exists("frames", lambda f: f["cls"].startswith(prefix))


def middleware_hits(t: DataFrame, dump: DataFrame) -> DataFrame:
    """Hits per series and signal: one aggregation over all threads, one over the dumps."""
    aggs, banner = [], []
    for i, (_, _, _, kind, pattern) in enumerate(MIDDLEWARE_SIGNALS):
        if kind == "name":
            aggs.append(count_if(full_match(F.col("name"), pattern)).alias(f"s{i}"))
        elif kind == "frame":
            aggs.append(count_if(_any_class_starts(pattern)).alias(f"s{i}"))
        else:
            banner.append(count_if(F.col("banner").contains(pattern)).alias(f"s{i}"))
    wide = dump.groupBy("series_id").agg(*banner).join(
        t.groupBy("series_id").agg(*aggs), "series_id", "left")
    rows = F.array(*[F.struct(
        F.lit(i).alias("signal"), F.lit(p).alias("platform"), F.lit(w).alias("weight"),
        F.lit(ev).alias("evidence"), F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("hits"))
        for i, (p, w, ev, _, _) in enumerate(MIDDLEWARE_SIGNALS)])
    return wide.select("series_id", F.explode(rows).alias("r")).select("series_id", "r.*") \
               .filter("hits > 0")


def detect_middleware(t: DataFrame, dump: DataFrame) -> DataFrame:
    """(series, platform, score, evidence); UNKNOWN below the minimum score."""
    order = F.create_map(*[x for i, p in enumerate(PLATFORMS) for x in (F.lit(p), F.lit(i))])
    note = F.concat("evidence", F.lit(" ("), F.col("hits").cast("string"),
                    F.when(F.col("hits") == 1, F.lit(" hit)")).otherwise(F.lit(" hits)")))
    scores = middleware_hits(t, dump).groupBy("series_id", "platform").agg(
        F.sum("weight").alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("signal", note.alias("text")))),
                    lambda s: s["text"]).alias("evidence"))
    # Liberty wins a tie, otherwise the earlier platform
    best = scores.groupBy("series_id").agg(F.max_by(
        F.struct("platform", "score", "evidence"),
        F.struct("score", (F.col("platform") == "LIBERTY").cast("int"), -order[F.col("platform")])).alias("b"))
    known = F.coalesce(F.col("b.score") >= PLATFORM_MIN_SCORE, F.lit(False))
    return dump.select("series_id").distinct().join(best, "series_id", "left").select(
        "series_id", F.when(known, F.col("b.platform")).otherwise("UNKNOWN").alias("platform"),
        F.coalesce("b.score", F.lit(0)).alias("score"),
        F.when(known, F.col("b.evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"))


def pool_health(t: DataFrame, group) -> DataFrame:
    """Per dump and worker group (a column, null = not a worker): load figures."""
    busy = (F.col("cls_kind") == "APPLICATION") & (F.size("frames") > 0)
    return t.withColumn("grp", group).filter(F.col("grp").isNotNull()).groupBy(*DUMP, "grp").agg(
        F.count("*").alias("total"),
        count_if(busy).alias("busy"),
        count_if(F.col("state") == "BLOCKED").alias("blocked"),
        count_if(is_stuck_marked(F.col("name"))).alias("stuck"),
        count_if(F.col("name").contains("[STANDBY]")).alias("standby"),
    ).withColumn("saturated", (F.col("total") > 0) & (F.col("busy") >= F.col("total"))
                 & (F.col("standby") == 0))


def pool_health_summary(health: DataFrame) -> DataFrame:
    """Per series and group: its worst dump, saturation throughout, most blocked."""
    worst = F.max_by(F.struct("dump_idx", "total", "busy", "blocked", "saturated"),
                     F.struct("busy", "blocked", -F.col("dump_idx")))
    return health.groupBy("series_id", "grp").agg(
        worst.alias("w"), F.count("*").alias("snapshots"), F.bool_and("saturated").alias("_all"),
        F.max("blocked").alias("max_blocked")).select(
        "series_id", "grp", F.col("w.dump_idx").alias("worst_dump"), F.col("w.total").alias("total"),
        F.col("w.busy").alias("busy"), F.col("w.saturated").alias("saturated"), "max_blocked", "snapshots",
        (F.col("_all") & (F.col("snapshots") >= 2)).alias("saturated_throughout"))


def busy_threads(t: DataFrame, group, names: int = 10) -> DataFrame:
    """First busy threads of every group and dump."""
    w = Window.partitionBy(*DUMP, "grp").orderBy("thread_ord")
    return t.withColumn("grp", group).filter(
        F.col("grp").isNotNull() & (F.col("cls_kind") == "APPLICATION") & (F.size("frames") > 0)) \
        .select(*DUMP, "grp", "thread_ord", "name", F.row_number().over(w).alias("rank")) \
        .filter(F.col("rank") <= names)


def middleware_panel(t: DataFrame, platform: DataFrame) -> DataFrame:
    """Group x dump cells of the worker groups known for the series' platform."""
    with_platform = t.join(platform.select("series_id", "platform"), "series_id")
    return pool_health(with_platform, worker_group(F.col("name"), F.col("platform")))


def queue_group():
    return queue_of(F.col("name"))


def connector_group():
    return connector_of(F.col("name"))


def support_group():
    return support_connector_of(F.col("name"))


def muxer():
    return is_muxer(F.col("name"), F.col("frames"))
