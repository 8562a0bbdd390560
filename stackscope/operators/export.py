"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(results: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One dataset per result table, partitioned by series where it has one."""
    if fmt not in ("parquet", "json"):
        raise ValueError("format must be parquet or json")
    for name, df in results.items():
        w = df.write.mode("overwrite")
        if "series_id" in df.columns and len(df.columns) > 1:
            w = w.partitionBy("series_id")
        w.format(fmt).save(f"{path}/{name}")
