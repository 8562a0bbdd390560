"""Running values over long ordered groups.

A plain window puts a whole group into one task. A log file or a series may hold
a third of all rows, so the order is cut into chunks: windows run inside
``(keys, chunk)``, one summary row per chunk is carried forward, and both are
combined. No task ever sees more than one chunk or the list of chunk summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], chunk: str, order: list[str], *,
            last: dict[str, Column] | None = None,
            prev: dict[str, Column] | None = None,
            total: dict[str, Column] | None = None,
            high: dict[str, Column] | None = None) -> DataFrame:
    """Add running columns.

    last: latest non-null marker, this row included; prev: the same without this
    row; total: running sum; high: running maximum. ``chunk`` must not decrease
    along the order within ``keys``.
    """
    last, prev, total, high = last or {}, prev or {}, total or {}, high or {}
    marked = {**last, **prev}
    aggs = []
    # a single numeric order and numeric markers keep the summary a hash aggregate
    pos = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    for n, m in marked.items():
        aggs.append(F.max_by(m, F.when(m.isNotNull(), pos)).alias(f"_c_{n}"))
    for n, m in total.items():
        aggs.append(F.sum(m).alias(f"_c_{n}"))
    for n, m in high.items():
        aggs.append(F.max(m).alias(f"_c_{n}"))
    summary = df.groupBy(*keys, chunk).agg(*aggs)

    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, chunk,
        *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in marked],
        *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in total],
        *[F.max(f"_c_{n}").over(before).alias(f"_c_{n}") for n in high])

    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    w_prev = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = df.select(
        "*",
        *[F.last(m, ignorenulls=True).over(w).alias(f"_l_{n}") for n, m in last.items()],
        *[F.last(m, ignorenulls=True).over(w_prev).alias(f"_l_{n}") for n, m in prev.items()],
        *[F.sum(m).over(w).alias(f"_l_{n}") for n, m in total.items()],
        *[F.max(m).over(w).alias(f"_l_{n}") for n, m in high.items()])
    joined = local.join(carry, [*keys, chunk], "left")
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in marked],
        *[(F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_c_{n}", zero)).alias(n) for n in total],
        *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in high])

