"""Snapshot diagnostics on Spark: thread dumps, GC logs and samples as DataFrames."""

from stackscope.options import Options

__all__ = ["Options"]
