"""Files of any supported format to one ordered table set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscope.session import store
from stackscope.sources.hotspot import hotspot_tables, segment_lines
from stackscope.sources.javacore import javacore_tables, tag_lines
from stackscope.sources.jsondump import json_documents, json_tables
from stackscope.sources.lines import read_cluster, read_lines, sniff_format
from stackscope.sources.tables import Tables, index_dumps


def tables_of(lines: DataFrame) -> Tables:
    """Canonical tables of a line table with files of any format, before the series is ordered.

    Formats are decided once and stored, one row per file.
    """
    kinds = store(sniff_format(lines))
    tagged = lines.join(kinds, ["series_id", "file"], "left")
    hot = hotspot_tables(segment_lines(tagged.filter(F.coalesce("format", F.lit("hotspot")) == "hotspot").drop("format")))
    core = javacore_tables(tag_lines(tagged.filter(F.col("format") == "javacore").drop("format")))
    return hot.union(core, json_tables(json_documents(tagged.filter(F.col("format") == "json"))))


def load_dumps(spark: SparkSession, paths, node: str | None = None, series_id: str = "series") -> Tables:
    """Read a mixed set of dump files, told apart by their content."""
    return index_dumps(tables_of(read_lines(spark, paths, node=node, series_id=series_id)))


def load_cluster(spark: SparkSession, nodes: dict[str, str]) -> Tables:
    """The same for several nodes, ``{node: glob}``; each is a series of its own."""
    return index_dumps(tables_of(read_cluster(spark, nodes)))
