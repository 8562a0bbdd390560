"""Named queries over the tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscope.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def flat(df: DataFrame, *cols, **named) -> DataFrame:
    """Plain columns only: integers and flags as BIGINT, everything else as it is."""
    out = []
    for c in [*[F.col(c).alias(c) for c in cols], *[v.alias(k) for k, v in named.items()]]:
        out.append(c)
    sel = df.select(*out)
    kinds = dict(sel.dtypes)
    return sel.select(*[
        F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "boolean", "smallint", "tinyint") else F.col(c)
        for c in sel.columns])
