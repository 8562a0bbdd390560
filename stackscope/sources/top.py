"""``top -H`` listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscope.functions.scan import running
from stackscope.functions.text import strip


def parse_top(lines: DataFrame) -> DataFrame:
    """OS samples; the latest header row above a line tells its column order.

    sample_ord orders the samples of a series, needed where the last one wins.
    """
    df = lines.withColumn("tok", F.split(strip(F.col("line")), r"\s+"))
    is_header = F.array_contains("tok", "PID") & F.array_contains("tok", "%CPU")

    def at(name: str) -> Column:
        return F.array_position("tok", name).cast("int")

    layout = F.when(is_header, F.struct(
        at("PID").alias("pid"), at("%CPU").alias("cpu"), at("%MEM").alias("mem"),
        at("COMMAND").alias("cmd")))
    df = running(df.withColumn("is_header", is_header), ["series_id", "file"], "chunk", ["pos"],
                 last={"layout": layout})

    def field(pos: str) -> Column:
        return F.try_element_at("tok", F.when(F.col(pos) > 0, F.col(pos)))

    def number(c: Column) -> Column:
        return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")

    cmd = F.when(F.col("layout.cmd") > 0, F.concat_ws(" ", F.slice(
        "tok", F.greatest(F.col("layout.cmd"), F.lit(1)), F.greatest(F.size("tok"), F.lit(1)))))
    return df.filter(~F.col("is_header") & F.col("layout").isNotNull()).select(
        "series_id", "file", "chunk", "pos",
        field("layout.pid").try_cast("long").alias("pid"),
        number(field("layout.cpu")).alias("cpu_pct"),
        F.coalesce(number(field("layout.mem")), F.lit(0.0)).alias("mem_pct"),
        F.coalesce(cmd, F.lit("")).alias("command")) \
        .filter("pid IS NOT NULL AND cpu_pct IS NOT NULL") \
        .select("series_id", F.struct("file", "chunk", "pos").alias("sample_ord"),
                "pid", "cpu_pct", "mem_pct", "command")
