"""Merging and checking site knowledge with the bundled one.

Knowledge is configuration: a few dozen rows that become column expressions.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackscope import schema
from stackscope.knowledge import (
    BUNDLED_RULES, FRAME_MEANINGS, IDLE_PATTERNS, THREAD_STATES, LabelEntry, RuleEntry,
)

MAX_ENTRIES = 5000


def merge_labels(defaults, overrides) -> tuple[LabelEntry, ...]:
    """User entries first; a bundled entry of the same name is replaced."""
    taken = {e.name for e in overrides}
    return (*overrides, *[e for e in defaults if e.name not in taken])


def merge_rules(defaults, overrides) -> tuple[RuleEntry, ...]:
    """A user rule with a bundled id takes its place; new rules follow."""
    by_id = {r.rule_id: r for r in overrides}
    out = [by_id.pop(r.rule_id, r) for r in defaults]
    return (*out, *[r for r in overrides if r.rule_id in by_id])


def idle_patterns(overrides=()) -> tuple[LabelEntry, ...]:
    return merge_labels(IDLE_PATTERNS, tuple(overrides))


def frame_meanings(overrides=()) -> tuple[LabelEntry, ...]:
    return merge_labels(FRAME_MEANINGS, tuple(overrides))


def rules(overrides=()) -> tuple[RuleEntry, ...]:
    return merge_rules(BUNDLED_RULES, tuple(overrides))


def merge_kb(defaults: DataFrame, overrides: DataFrame, key: str, keep_position: bool) -> DataFrame:
    """The same merge on tables (columns: key, kb_ord, ...), with kb_ord renumbered.

    keep_position puts a replacement where the bundled entry was; otherwise all
    overrides come first.
    """
    d = defaults.withColumn("_src", F.lit(1)).withColumn("_slot", F.col("kb_ord"))
    slot = defaults.select(key, F.col("kb_ord").alias("_slot"))
    o = overrides.withColumn("_src", F.lit(0)).join(slot, key, "left")
    if not keep_position:
        o = o.withColumn("_slot", F.lit(None).cast("int"))
    rank = Window.partitionBy(key).orderBy("_src", "kb_ord")
    both = d.unionByName(o.select(*d.columns)) \
        .withColumn("_rn", F.row_number().over(rank)).filter("_rn = 1")
    # numbered chunk by chunk: ranks inside a thousand places, and the rows of the chunks before
    at = F.coalesce("_slot", "kb_ord")
    both = both.withColumn("_group", F.when(F.col("_slot").isNotNull(), 1).otherwise(2 if keep_position else 0)) \
        .withColumn("_chunk", F.floor(at / 1024))
    sizes = both.groupBy("_group", "_chunk").agg(F.count("*").alias("_n"))
    # one row for a thousand entries
    before = Window.orderBy("_group", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("_group", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_group", "_chunk").orderBy(at, "kb_ord", key)
    return both.withColumn("_place", F.row_number().over(inside) - 1).join(carry, ["_group", "_chunk"]).withColumn(
        "kb_ord", (F.col("_before") + F.col("_place")).cast("int")).drop(
        "_src", "_slot", "_rn", "_group", "_chunk", "_place", "_before")


def rule_table(spark: SparkSession, entries=BUNDLED_RULES) -> DataFrame:
    rows = []
    for r in entries:
        d = asdict(r)
        rows.append(tuple(list(d[f.name]) if isinstance(d[f.name], tuple) else d[f.name]
                          for f in schema.RULE.fields))
    return spark.createDataFrame(rows, schema.RULE)


def rules_from_table(df: DataFrame) -> tuple[RuleEntry, ...]:
    """Rule rows as entries; the table is configuration and its size is checked."""
    rows = df.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} rules")
    out = []
    for r in rows:
        d = r.asDict()
        out.append(RuleEntry(
            d["rule_id"], d["title"], d["severity"].upper(), d["recommendation"],
            tuple(d["frames"] or ()), d["name_regex"], tuple(s.upper() for s in (d["states"] or ())),
            d["min_threads"] or 1, d["warn_threads"], d["critical_threads"],
            d["persist_dumps"], d["cpu_delta"]))
    return tuple(out)


def validate_rules(rules_df: DataFrame) -> DataFrame:
    """(rule_id, error) for every violated requirement; no rows means all rules are valid."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    frames = F.coalesce("frames", F.array().cast("array<string>"))
    states = F.coalesce("states", F.array().cast("array<string>"))
    bad_state = F.try_element_at(F.filter(
        states, lambda s: ~F.upper(s).isin(*THREAD_STATES)), F.lit(1))
    checks = [
        F.when(blank("rule_id") | blank("title") | blank("severity") | blank("recommendation"),
               F.lit("a rule needs an id, a title, a severity and a recommendation")),
        F.when(~blank("severity") & ~F.upper("severity").isin("INFO", "WARNING", "CRITICAL"),
               F.concat(F.lit("no such severity: "), F.col("severity"))),
        F.when(bad_state.isNotNull(), F.concat(F.lit("no such thread state: "), bad_state)),
        F.when((F.size(frames) == 0) & F.col("name_regex").isNull() & (F.size(states) == 0),
               F.lit("a rule has to match on frames, names or states")),
        F.when(F.col("cpu_delta").isNotNull() & ~F.col("cpu_delta").isin("any", "zero", "spinning"),
               F.lit("no such processor time condition")),
        F.when(F.col("name_regex").isNotNull() & F.expr(
            "try_reflect('java.util.regex.Pattern', 'compile', name_regex)").isNull(),
            F.concat(F.lit("bad name regex: "), F.col("name_regex"))),
    ]
    return (rules_df
            .select("rule_id", F.explode(F.array_compact(F.array(*checks))).alias("error")))
