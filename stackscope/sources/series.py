"""Ordering of dumps within a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: dumps without a time come last, in a chunk of their own
NO_DAY = 1 << 30


def order_series(dump: DataFrame, input_order: list[str]) -> DataFrame:
    """Add dump_idx (timestamp order, nulls last, stable) and reordered per series.

    A series may hold most of all dumps, so it is numbered day by day: ranks inside a day, the number of
    dumps before it, and the last dump of the day before. A series is reordered where its input places do not rise
    along the time order.
    """
    place = F.struct(*input_order)
    df = dump.withColumn("_day", F.coalesce(F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")), F.lit(NO_DAY)))
    at = F.struct(F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"), place.alias("place"))
    days = df.groupBy("series_id", "_day").agg(F.count("*").alias("_n"), F.max(at)["place"].alias("_end"))
    before = Window.partitionBy("series_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select("series_id", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                        F.last("_end").over(before).alias("_prior"))
    inside = Window.partitionBy("series_id", "_day").orderBy(F.col("ts").asc_nulls_last(), *[F.col(c) for c in input_order])
    ranked = (df.withColumn("_rank", F.row_number().over(inside) - 1).withColumn("_last", F.lag(place).over(inside))
              .join(carry, ["series_id", "_day"])
              .withColumn("dump_idx", (F.col("_before") + F.col("_rank")).cast("int"))
              .withColumn("_moved", F.coalesce(F.coalesce("_last", "_prior") > place, F.lit(False))))
    moved = ranked.groupBy("series_id").agg(F.bool_or("_moved").alias("reordered"))
    return ranked.select(*dump.columns, "dump_idx").join(moved, "series_id")
