"""Incident memory: append-only Parquet tables of analyses and their stacks."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackscope.operators.findings import SEVERITIES
from stackscope.operators.single import recurring_stacks
from stackscope.session import store

SIMILARITY = 0.3

ANALYSIS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("label", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("baseline", T.StringType()),
])
STACK = T.StructType([
    T.StructField("analysis_id", T.StringType()),
    T.StructField("hash", T.StringType()),
])


def record(analysis: DataFrame, stacks: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add analyses (id, ts, label, summary, baseline) and their (analysis_id, hash) rows as one run.

    A run has folders of its own, so recording it again replaces it. Its analyses are written last: stacks
    of a run that broke off belong to no analysis, and no operator shows them.
    """
    run = f"run={quote(run_id or uuid.uuid4().hex, safe='')}"
    stacks.select("analysis_id", "hash").distinct().write.mode("overwrite").parquet(f"{path}/stack/{run}")
    analysis.select(*ANALYSIS.names).write.mode("overwrite").parquet(f"{path}/analysis/{run}")


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All recorded analyses and stacks; a history that does not exist yet is empty."""
    def part(name, schema):
        try:
            return spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)
    return part("analysis", ANALYSIS), part("stack", STACK)


def analysis_rows(thread: DataFrame, dump: DataFrame, ranked: DataFrame, run_id: str, label: str | None = None,
                  baseline: DataFrame | None = None, at=None, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """What is remembered of a run: one analysis for each series, and its recurring stacks.

    The summary counts findings by severity and dumps, and names the first findings.
    baseline: (series_id, baseline) documents, if the run has any.
    """
    id_ = F.concat(F.lit(f"{run_id}/"), F.col("series_id"))
    counts = ranked.groupBy("series_id").agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s.lower()) for s in SEVERITIES])
    first = ranked.filter(F.col("rank") <= top).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "rank", F.concat("severity", F.lit(": "), "title").alias("text")))), lambda x: x["text"]).alias("_top"))
    df = dump.groupBy("series_id").agg(F.count("*").alias("_dumps")).join(counts, "series_id", "left").join(first, "series_id", "left")
    df = df.join(baseline, "series_id", "left") if baseline is not None else df.withColumn("baseline", F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    summary = F.to_json(F.struct(
        F.struct(*[F.coalesce(s.lower(), F.lit(0)).alias(s) for s in SEVERITIES]).alias("severities"),
        F.coalesce("_top", none).alias("topFindings"), F.col("_dumps").alias("dumps")))
    ts = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    stacks = recurring_stacks(thread).select(id_.alias("analysis_id"), F.col("stack_hash").alias("hash")).distinct()
    return df.select(id_.alias("id"), ts.alias("ts"), F.lit(label).cast("string").alias("label"), summary.alias("summary"), "baseline"), stacks


def remember(path: str, run_id: str, thread: DataFrame, dump: DataFrame, ranked: DataFrame, label: str | None = None,
             baseline: DataFrame | None = None, at=None) -> DataFrame:
    """Record a run, and return what is similar to it in the history before it.

    Asked before anything is written, and without the run's own earlier rows, so that neither a first
    attempt nor a repeated one meets itself.
    """
    analysis, stacks = analysis_rows(thread, dump, ranked, run_id, label, baseline, at)
    stacks = store(stacks)
    old, old_stacks = read_history(thread.sparkSession, path)
    mine = lambda c: F.startswith(F.col(c), F.lit(f"{run_id}/"))
    similar = store(similar_incidents(old.filter(~mine("id")), old_stacks.filter(~mine("analysis_id")), stacks.select(
        F.col("analysis_id").alias("query_id"), "hash")))
    record(analysis, stacks, path, run_id)
    return similar


def similar_incidents(analysis: DataFrame, stacks: DataFrame, query: DataFrame,
                      threshold: float = SIMILARITY) -> DataFrame:
    """Past analyses whose stack set overlaps a query set by the threshold (above 0) or more.

    query: (query_id, hash). Each set is ordered from its rarest hash to its most common one. Sets at the threshold share
    at least threshold times the size of either, so they meet in the first hashes of both, and their sizes are not far
    apart: only such pairs are formed. A hash that all incidents have comes last and brings no pair by itself.
    """
    past = stacks.select("analysis_id", "hash").distinct()
    q = query.select("query_id", "hash").distinct()
    often = past.groupBy("hash").agg(F.count("*").alias("_f"))

    def first(sets: DataFrame, id_: str, size: str) -> DataFrame:
        n = sets.groupBy(id_).agg(F.count("*").alias(size))
        w = Window.partitionBy(id_).orderBy(F.coalesce("_f", F.lit(0)), "hash")
        least = F.ceil(F.col(size) * threshold - 1e-9)
        return sets.join(often, "hash", "left").withColumn("_rank", F.row_number().over(w)).join(n, id_).filter(
            F.col("_rank") <= F.col(size) - least + 1).select(id_, "hash", size)

    near = (F.col("_a") >= F.col("_b") * threshold - 1e-9) & (F.col("_b") >= F.col("_a") * threshold - 1e-9)
    pairs = first(q, "query_id", "_b").join(first(past, "analysis_id", "_a"), "hash").filter(near).select(
        "query_id", "analysis_id", "_a", "_b").distinct()
    shared = pairs.join(q, "query_id").join(past, ["analysis_id", "hash"], "left_semi").groupBy(
        "query_id", "analysis_id", "_a", "_b").agg(F.count("*").alias("shared"))
    overlap = F.col("shared") / (F.col("_a") + F.col("_b") - F.col("shared"))
    hits = shared.withColumn("_o", overlap).filter(F.col("_o") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("_o"), F.desc("ts"), "analysis_id")
    return hits.join(analysis.select(F.col("id").alias("analysis_id"), "ts", "label"), "analysis_id").select(
        "query_id", "analysis_id", "ts", "label", "shared", F.round("_o", 3).alias("overlap"),
        F.row_number().over(w).alias("rank"))


def shared_hashes(stacks: DataFrame, query: DataFrame, hits: DataFrame, n: int = 10) -> DataFrame:
    """The first shared hashes of every similar pair; only hits are expanded."""
    w = Window.partitionBy("query_id", "analysis_id").orderBy("hash")
    return hits.select("query_id", "analysis_id").distinct().join(query.select("query_id", "hash").distinct(), "query_id") \
        .join(stacks.select("analysis_id", "hash").distinct(), ["analysis_id", "hash"], "left_semi") \
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def history_list(analysis: DataFrame, limit: int = 25) -> DataFrame:
    return analysis.select("id", "ts", "label", "summary").orderBy(F.desc("ts"), "id").limit(limit)


def history_search(analysis: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Newest analyses whose label or summary contains the text, letter case aside."""
    needle = F.lit(text.lower())
    hit = F.coalesce(F.contains(F.lower("label"), needle), F.lit(False)) | F.coalesce(
        F.contains(F.lower("summary"), needle), F.lit(False))
    return history_list(analysis.filter(hit), limit)


def history_show(analysis: DataFrame, stacks: DataFrame, id_: str) -> DataFrame:
    """One analysis with the number of its stacks."""
    n = stacks.filter(F.col("analysis_id") == id_).groupBy("analysis_id").agg(
        F.count_distinct("hash").alias("stacks"))
    return analysis.filter(F.col("id") == id_).join(
        n.withColumnRenamed("analysis_id", "id"), "id", "left").select(
        "id", "ts", "label", "summary", F.coalesce("stacks", F.lit(0)).alias("stacks"))


def stacks_of(stacks: DataFrame, id_: str) -> DataFrame:
    return stacks.filter(F.col("analysis_id") == id_).select("hash").distinct()


def baseline_for_label(analysis: DataFrame, label: str | None = None) -> DataFrame:
    """Newest stored baseline per label."""
    df = analysis.filter(F.col("baseline").isNotNull())
    if label is not None:
        df = df.filter(F.col("label") == label)
    return df.groupBy("label").agg(
        F.max_by("baseline", F.struct("ts", "id")).alias("baseline"), F.max("ts").alias("ts"))
