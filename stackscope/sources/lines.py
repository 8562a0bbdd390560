"""Text sources as line tables.

Columns: series_id, node, file, input_ord, chunk, pos, line. ``(chunk, pos)`` orders the
lines of a file: the chunk is the byte offset of the read split, ``pos`` counts
within it, so a huge log is read by many tasks and still has a total order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackscope.functions.text import strip


def read_lines(spark: SparkSession, paths, node: str | None = None, series_id: str = "series") -> DataFrame:
    """Lines of text files; malformed UTF-8 is replaced, any line ending is accepted.

    ``input_ord`` is the place of the first argument that names the file: dumps without a time keep the order in which
    their files were given.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _placed(spark, [(node or series_id, node, i, p) for i, p in enumerate(paths)])


def read_cluster(spark: SparkSession, nodes: dict[str, str]) -> DataFrame:
    """Lines of several nodes, ``{node: glob}``, in one read; the node becomes the series. A file named by two nodes belongs to both."""
    return _placed(spark, [(node, node, i, glob) for i, (node, glob) in enumerate(nodes.items())])


def _placed(spark: SparkSession, named: list[tuple[str, str | None, int, str]]) -> DataFrame:
    """One read of all paths; the distinct files find their arguments, and their lines are joined to these."""
    raw = spark.read.text(sorted({p for *_, p in named})).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source_name"),
        F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("pos"),
        F.make_valid_utf8("value").alias("line"))
    if len(named) == 1:
        series, node, at, _ = named[0]
        return raw.select(F.lit(series).alias("series_id"), F.lit(node).cast("string").alias("node"), "file", "source_name",
                          F.lit(at).alias("input_ord"), "chunk", "pos", "line")
    args = F.array(*[F.struct(F.lit(series).alias("series_id"), F.lit(node).cast("string").alias("node"), F.lit(at).alias("input_ord"),
                              F.lit(_pattern(spark, p)).alias("pattern")) for series, node, at, p in named])
    # every file is held against the arguments once, not every line
    path = F.regexp_replace("file", "^[a-z]+:/+", "/")
    mine = raw.select("file").distinct().select("file", F.explode(F.filter(args, lambda a: F.rlike(path, a["pattern"]))).alias("a")) \
        .groupBy("file", "a.series_id", "a.node").agg(F.min("a.input_ord").alias("input_ord"))
    return raw.join(mine, "file").select("series_id", "node", "file", "source_name", "input_ord", "chunk", "pos", "line")


def _pattern(spark: SparkSession, path: str) -> str:
    """A regular expression for the files that a path, folder or glob names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath()
    out, at, depth = "", 0, 0
    while at < len(full):
        c = full[at]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in full[at:]:
            end = full.index("]", at)
            out += "[" + full[at + 1:end].replace("!", "^", 1) + "]"
            at = end
        else:
            out += re.escape(c)
        at += 1
    return f"^{out}(/.*)?$"


def sniff_format(lines: DataFrame) -> DataFrame:
    """One row per file: json, javacore or hotspot, judged by its first 512 characters.

    JSON is told by an opening brace and a ``"threadDump"`` key there. Only the first read split of a file is looked at, and of
    this its first 512 lines: each adds at least its line ending.
    """
    text = strip(F.col("line"))
    w = Window.partitionBy("series_id", "file").orderBy("pos")
    numbered = lines.filter(F.col("chunk") == 0).select("series_id", "file", "pos", F.substring("line", 1, 512).alias("line")) \
        .withColumn("_rn", F.row_number().over(w)).filter("_rn <= 512")
    before = F.coalesce(F.sum(F.length("line") + 1).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = numbered.withColumn("_before", before).filter("_before < 512") \
        .withColumn("line", F.expr("substring(line, 1, int(512 - _before))"))
    tagged = (F.col("line").contains("0SECTION") | F.col("line").contains("1TISIGINFO")
              | F.col("line").contains("NULL           ---"))
    per_file = head.groupBy("series_id", "file").agg(
        F.bool_or(tagged).alias("_tagged"), F.bool_or(F.col("line").contains('"threadDump"')).alias("_key"),
        F.min_by(F.substring(text, 1, 1), F.when(F.length(text) > 0, F.col("pos"))).alias("_first"))
    return per_file.select(
        "series_id", "file", F.when((F.col("_first") == "{") & F.col("_key"), "json")
        .when(F.col("_tagged"), "javacore").otherwise("hotspot").alias("format"))
