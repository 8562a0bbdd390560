"""Stop-the-world windows against dumps. Ranges are answered by running values over
one time order, so no row is ever paired with a range of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.functions.scan import running
from stackscope.operators.stuck import GENUINE

CHUNK_S = 3600


def _timeline(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("_chunk", F.floor(F.col("at") / (CHUNK_S * 1_000_000)))


def pause_covers(points: DataFrame, pause: DataFrame, slack_ms: int = 2000, ts: str = "ts",
                 by: list[str] = ["series_id"]) -> DataFrame:
    """Points (any table with ``by`` and a time column) plus ``covered``.

    A point is covered when some window starting before it, widened by the slack,
    also ends after it: that is a running maximum of the ends. Points without a
    time are not covered.
    """
    slack = slack_ms * 1000
    timed = points.filter(F.col(ts).isNotNull())
    start = F.unix_micros("start_ts")
    # windows come first among equal times: both bounds are inclusive
    w = pause.filter("start_ts IS NOT NULL").groupBy(*by, (start - slack).alias("at")).agg(
        F.max(start + F.floor(F.col("duration_ms") * 1000).cast("long") + slack).alias("_end")) \
        .withColumn("_ord", F.lit(0))
    p = timed.select(*by, F.unix_micros(ts).alias("at"), F.struct(*points.columns).alias("_row")) \
        .withColumn("_ord", F.lit(1))
    line = running(_timeline([w, p]), by, "_chunk", ["at", "_ord"], high={"_reach": F.col("_end")})
    hit = line.filter("_ord = 1").select(
        "_row.*", F.coalesce(F.col("_reach") >= F.col("at"), F.lit(False)).alias("covered"))
    return hit.unionByName(points.filter(F.col(ts).isNull()).withColumn("covered", F.lit(False)))


def reattribute_to_pauses(verdicts: DataFrame, dump: DataFrame, pause: DataFrame,
                          slack_ms: int = 2000) -> DataFrame:
    """Verdicts whose every dump fell into a pause become DISCARDED.

    Covered dumps are counted once per series as a prefix sum; a run is covered
    when the sum grows by its full length. ``reattributed`` marks the changed rows.
    """
    cov = pause_covers(dump.select("series_id", "dump_idx", "ts"), pause, slack_ms)
    w = Window.partitionBy("series_id").orderBy("dump_idx")
    prefix = cov.select("series_id", "dump_idx", F.sum(F.col("covered").cast("int")).over(w).alias("_cum"),
                        F.col("covered").cast("int").alias("_c"))
    a = prefix.select("series_id", F.col("dump_idx").alias("from_dump"), (F.col("_cum") - F.col("_c")).alias("_a"))
    b = prefix.select("series_id", F.col("dump_idx").alias("to_dump"), F.col("_cum").alias("_b"))
    df = verdicts.join(a, ["series_id", "from_dump"], "left").join(b, ["series_id", "to_dump"], "left")
    whole = ((F.col("_b") - F.col("_a")) == (F.col("to_dump") - F.col("from_dump") + 1)) \
        & F.col("kind").isin(*GENUINE, "NATIVE_WAIT")
    df = df.withColumn("reattributed", F.coalesce(whole, F.lit(False)))
    hit = F.col("reattributed")
    return df.select(
        *[c for c in verdicts.columns if c not in ("kind", "severity", "confidence", "why")],
        F.when(hit, "DISCARDED").otherwise(F.col("kind")).alias("kind"),
        F.when(~hit, F.col("severity")).alias("severity"),
        F.when(hit, "high").otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, "every dump of the run was taken inside a stop-the-world pause")
        .otherwise(F.col("why")).alias("why"), "reattributed")


def axis_position(instants: DataFrame, dump: DataFrame, ts: str = "ts", margin_ms: int = 60_000) -> DataFrame:
    """Instants plus ``position`` on the dump axis, interpolated between dumps.

    Null when the instant is farther than the margin outside the series or when a
    dump of the series has no time.
    """
    w = Window.partitionBy("series_id").orderBy("dump_idx")
    ms = F.unix_millis("ts")
    d = dump.select("series_id", ms.alias("at"), F.struct(
        F.col("dump_idx").alias("i"), ms.alias("t"), F.lead(ms).over(w).alias("next")).alias("_dump"))
    edge = dump.groupBy("series_id").agg(
        F.min(ms).alias("_t0"), F.max(ms).alias("_t1"), F.max("dump_idx").alias("_n"),
        F.bool_or(F.col("ts").isNull()).alias("_gap"))
    p = instants.select("series_id", F.unix_millis(ts).alias("at"), F.struct(*instants.columns).alias("_row"))
    # dumps follow instants of the same time: an instant on a dump belongs to the step before it
    both = d.filter("at IS NOT NULL").withColumn("_ord", F.lit(1)).unionByName(
        p.withColumn("_ord", F.lit(0)), allowMissingColumns=True) \
        .withColumn("_chunk", F.floor(F.col("at") / (CHUNK_S * 1000)))
    line = running(both, ["series_id"], "_chunk", ["at", "_ord"], last={"_before": F.col("_dump")})
    line = line.filter("_ord = 0").join(edge, "series_id", "left")
    at, before = F.col("at"), F.col("_before")
    pos = (F.when(F.col("_gap") | F.col("_n").isNull(), None)
           .when(at <= F.col("_t0"), F.when(at >= F.col("_t0") - margin_ms, F.lit(-0.4)))
           .when(at > F.col("_t1"), F.when(at <= F.col("_t1") + margin_ms, F.col("_n") + F.lit(0.4)))
           .otherwise(before["i"] + (at - before["t"]) / F.greatest(before["next"] - before["t"], F.lit(1))))
    return line.select("_row.*", pos.cast("double").alias("position"))


def pause_bands(dump: DataFrame, pause: DataFrame, limit: int | None = 80) -> DataFrame:
    """Bands to shade behind the dump axis: (series, start_ts, cause, from_pos, to_pos); the first ``limit`` (None: all)."""
    p = pause.withColumn("_id", F.struct("start_ts", "duration_ms", "cause", "kind"))
    length = F.greatest(F.col("duration_ms"), F.lit(500.0))
    ends = p.withColumn("_end", F.timestamp_micros(
        F.unix_micros("start_ts") + (length * 1000).cast("long")))
    a = axis_position(ends.withColumnRenamed("start_ts", "ts").select(
        "series_id", "ts", "_id", "_end"), dump).withColumnRenamed("position", "from_pos")
    b = axis_position(a, dump, ts="_end").withColumnRenamed("position", "_to")
    rows = b.filter("from_pos IS NOT NULL AND _to IS NOT NULL")
    if limit is not None:
        w = Window.partitionBy("series_id").orderBy("ts", "_id")
        rows = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    return rows.select(
        "series_id", F.col("ts").alias("start_ts"), "_id.duration_ms", "_id.cause", "_id.kind", "from_pos",
        F.greatest(F.col("_to"), F.col("from_pos") + 0.03).alias("to_pos"))
