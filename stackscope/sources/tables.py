"""The canonical table set produced by every parser."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackscope import schema
from stackscope.session import store
from stackscope.sources.series import order_series


@dataclass
class Tables:
    dump: DataFrame
    thread: DataFrame
    jvm_cycle: DataFrame
    parse_issue: DataFrame

    def union(self, *others: "Tables") -> "Tables":
        """Tables of several sources, before the series is ordered."""
        return Tables(*[
            reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                   [getattr(t, n) for t in (self, *others)])
            for n in ("dump", "thread", "jvm_cycle", "parse_issue")])


def conform(df: DataFrame, target: T.StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project to a schema; absent columns become typed nulls."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in target.fields], *extra)


def index_dumps(t: Tables) -> Tables:
    """Give every dump its position in the series and stamp it on the child tables.

    Parsers key their rows by (series_id, file, dump_no); ``input_ord`` is the place of the argument that named the
    file. The narrow dump table is stored, so no child table goes through its parser again. A file without any
    dump keeps its issues, with a null dump_idx.
    """
    dump = t.dump if "input_ord" in t.dump.columns else t.dump.withColumn("input_ord", F.lit(0))
    key = ["series_id", "file", "dump_no"]
    ordered = store(order_series(dump.withColumn("input_ord", F.coalesce("input_ord", F.lit(0))), ["input_ord", "file", "dump_no"]))
    idx = ordered.select(*key, "dump_idx", F.col("source_name").alias("where"))

    def stamp(df: DataFrame, target: T.StructType) -> DataFrame:
        return conform(df.join(idx, key), target)

    name = F.col("source_name") if "source_name" in t.parse_issue.columns else F.lit(None).cast("string")
    issues = t.parse_issue.select(*key, "message", name.alias("_name")).join(idx, key, "left").withColumn(
        "where", F.coalesce("where", "_name", "file"))
    return Tables(conform(ordered, schema.DUMP), stamp(t.thread, schema.THREAD),
                  stamp(t.jvm_cycle, schema.JVM_CYCLE), conform(issues, schema.PARSE_ISSUE))
