"""New dump files to canonical tables and findings, batch by batch, as one growing series."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscope.operators.series import RUN
from stackscope.operators.stuck import genuine
from stackscope.options import Options
from stackscope.session import store
from stackscope.sources.load import tables_of
from stackscope.sources.tables import Tables, index_dumps

NAMES = ("dump", "thread", "jvm_cycle", "parse_issue")
#: what is kept of a series between batches
SERIES = "series_id string, dumps long, last_ts timestamp"


def dump_lines_stream(spark: SparkSession, path: str, series_id: str = "series",
                      max_files: int = 1000) -> DataFrame:
    """Streaming line table over a folder of dump files of any format."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    return raw.select(
        F.lit(series_id).alias("series_id"), F.lit(None).cast("string").alias("node"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source_name"),
        F.lit(0).alias("input_ord"), F.col("_metadata.file_block_start").alias("chunk"), "value")


def ingest_dumps_stream(lines: DataFrame, out: str, checkpoint: str,
                        options: Options = Options(),
                        on_batch: Callable[[Tables, int], None] | None = None):
    """Start a query that appends every new file's tables, verdicts and findings under ``out``.

    A series lives across batches: its dumps are numbered on, and the runs that were open at its last
    dump go on. Within a batch dumps are ordered by time; one that arrives after a later one of an earlier batch keeps its place of
    arrival and is marked as reordered. A run is reported in every batch in which it grows, with its full length
    (``stuck``; ``latest_stuck`` gives its last state). Other findings are about the dumps of their batch.

    Every batch goes to its own folder, overwritten on a replay. State is kept in two slots by turns: a
    batch reads what the batch before it wrote and writes the other slot, so a batch that is run twice counts once.
    It holds one row per series and one per thread with an open run.
    """
    from stackscope.plans.analyze import analyze

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession

        def state(name: str, kind: str) -> DataFrame:
            if batch_id == 0:
                return spark.createDataFrame([], kind)
            return spark.read.schema(kind).parquet(f"{out}/_state/slot={(batch_id - 1) % 2}/{name}")

        def keep(name: str, rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(f"{out}/_state/slot={batch_id % 2}/{name}")

        series, runs = state("series", SERIES), state("runs", RUN)
        if df.isEmpty():
            keep("series", series)
            keep("runs", runs)
            return
        numbered = df.withColumn("pos", F.monotonically_increasing_id()) \
                     .withColumn("line", F.make_valid_utf8("value")).drop("value")
        tables = _numbered_on(index_dumps(tables_of(store(numbered))), series)
        for name in NAMES:
            getattr(tables, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        stored = Tables(*[spark.read.schema(getattr(tables, n).schema).parquet(f"{out}/{n}/batch={batch_id}") for n in NAMES])
        # only runs that reach the last dump before this batch can go on
        result = analyze(stored, options=options, runs=runs)
        now = stored.dump.groupBy("series_id").agg(
            (F.max("dump_idx") + 1).cast("long").alias("dumps"), F.max("ts").alias("last_ts"))
        old = series.select("series_id", F.col("dumps").alias("_d"), F.col("last_ts").alias("_t"))
        after = store(old.join(now, "series_id", "full").select(
            "series_id", F.coalesce("dumps", "_d").alias("dumps"), F.greatest("last_ts", "_t").alias("last_ts")))
        found = result.tables["stack_runs"]
        # a series without new dumps keeps its open runs as they are
        idle = runs.join(now, "series_id", "left_anti")
        ends = after.select("series_id", (F.col("dumps") - 1).alias("_end"))
        fresh = found.join(now.select("series_id"), "series_id", "left_semi").join(ends, "series_id").filter(
            F.col("to_dump") == F.col("_end")).drop("_end")
        result.findings.write.mode("overwrite").parquet(f"{out}/finding/batch={batch_id}")
        genuine(result.context.verdicts).drop("frames").write.mode("overwrite").parquet(f"{out}/stuck/batch={batch_id}")
        keep("series", after)
        keep("runs", fresh.unionByName(idle))
        if on_batch is not None:
            on_batch(stored, batch_id)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def _numbered_on(t: Tables, series: DataFrame) -> Tables:
    """The tables of one batch with their dumps numbered after those the series has already."""
    before = series.select("series_id", F.col("dumps").alias("_n"), F.col("last_ts").alias("_t"))

    def moved(df: DataFrame) -> DataFrame:
        shifted = (F.col("dump_idx") + F.coalesce("_n", F.lit(0))).cast("int")
        return df.join(F.broadcast(before), "series_id", "left").withColumn("dump_idx", shifted)

    late = F.col("reordered") | F.coalesce(F.col("ts") < F.col("_t"), F.lit(False))
    dump = moved(t.dump).withColumn("reordered", late).select(*t.dump.columns)
    return Tables(dump, *[moved(getattr(t, n)).select(*getattr(t, n).columns) for n in NAMES[1:]])


def latest_stuck(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every reported run of the series under ``out``."""
    rows = spark.read.parquet(f"{out}/stuck")
    cols = [c for c in rows.columns if c not in ("series_id", "key", "fp", "from_dump", "batch")]
    return rows.groupBy("series_id", "key", "fp", "from_dump").agg(F.max_by(F.struct(*cols), "to_dump").alias("_l")).select(
        "series_id", "key", "fp", "from_dump", "_l.*")
