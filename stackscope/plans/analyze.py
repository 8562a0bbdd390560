"""The whole analysis of a set of series as one set of result tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscope.knowledge import BUNDLED_RULES, FRAME_MEANINGS, IDLE_PATTERNS
from stackscope.operators import baseline as B
from stackscope.operators import fleet, locks, middleware, quality, series, single, stuck
from stackscope.operators.derive import derive
from stackscope.operators.findings import Context, marked_threads, rank_findings, run_detectors
from stackscope.operators.pauses import reattribute_to_pauses
from stackscope.options import Options
from stackscope.session import cut, store
from stackscope.sources.tables import Tables


class ResultTables(Mapping):
    """Result tables by name; each is planned when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class Analysis:
    """Lazy result tables, all keyed by series_id."""

    context: Context
    findings: DataFrame
    tables: ResultTables


def analyze(t: Tables, os_sample: DataFrame | None = None, pauses: DataFrame | None = None,
            pinned: DataFrame | None = None, baseline: B.Baseline | None = None,
            options: Options = Options(), idle=IDLE_PATTERNS, meanings=FRAME_MEANINGS,
            rules=BUNDLED_RULES, runs: DataFrame | None = None) -> Analysis:
    """Plan every result of the engine over one or many series.

    The parsed tables are written first, so no result goes back to the text, and every result
    scans only the columns it needs. ``runs`` are open runs of the same series over earlier dumps
    (``series.merge_runs``); runs that go on from them are judged at their full length.
    """
    t = replace(t, dump=store(t.dump), jvm_cycle=store(t.jvm_cycle), parse_issue=store(t.parse_issue))
    thread = store(derive(t.thread, options, idle, meanings))
    dump = t.dump
    occ = series.series_index(thread)
    # the waits-for relation is small next to the threads; it is stored once and shared
    edges = cut(locks.waits_for(thread))
    on_cycle = locks.cycle_nodes(edges)
    contended = locks.contended_locks(thread)
    blockers = cut(locks.top_blockers(edges, on_cycle))
    members = locks.deadlock_members(edges, t.jvm_cycle, on_cycle)
    cycles = locks.deadlock_cycles(members)
    found = series.stack_runs(occ, dump)
    found = store(found if runs is None else series.merge_runs(found.unionByName(runs)))
    candidates = series.run_candidates(found, occ, options.stuck_k, options.max_frames_shown)
    verdicts = stuck.classify_stuck(candidates, contended, blockers, os_sample, options.critical_victims)
    raw_genuine = stuck.genuine(verdicts)
    if pauses is not None:
        verdicts = reattribute_to_pauses(verdicts, dump, pauses, options.pause_slack_ms)
    verdicts = store(verdicts)
    holders = series.persistent_lock_holders(thread)
    trend = series.pool_trend(thread, dump, options.leak_min_growth)
    platform = middleware.detect_middleware(thread, dump)
    ctx = Context(dump, thread, occ, verdicts, cycles, blockers, trend, platform, pauses, pinned,
                  rules, options)
    findings = rank_findings(run_detectors(ctx))
    flags = series.flag_rows(thread, raw_genuine, holders, t.jvm_cycle)
    if pauses is not None:
        moved = verdicts.filter("reattributed").select("series_id", "key").distinct().withColumn("_gone", F.lit(True))
        only = flags.groupBy("series_id", "key").agg(F.count("*").alias("_n"))
        flags = flags.join(only, ["series_id", "key"]).join(moved, ["series_id", "key"], "left").filter(
            ~((F.col("flag") == "stuck") & (F.col("_n") == 1) & F.coalesce("_gone", F.lit(False)))) \
            .drop("_n", "_gone")
    out = {
        "dump": lambda: dump,
        "state_distribution": lambda: single.state_distribution(thread),
        "state_counts": lambda: single.state_counts(thread),
        "gc_jit": lambda: single.gc_jit_sanity(thread),
        "virtual_counts": lambda: single.virtual_counts(thread),
        "carriers": lambda: single.carrier_map(thread),
        "pools": lambda: single.pool_stats(thread),
        "categories": lambda: single.category_breakdown(thread),
        "stack_groups": lambda: single.stack_groups(thread, options.top_stacks, options.max_frames_shown),
        "method_stats": lambda: single.method_stats(thread),
        "cpu": lambda: single.cpu_attribution(thread, os_sample),
        "thread_detail": lambda: single.thread_detail(thread, options.max_frames_shown),
        "stacks": lambda: single.stack_table(thread, options.max_frames_shown),
        "contended_locks": lambda: contended,
        "lock_waiters": lambda: locks.lock_wait(thread),
        "top_blockers": lambda: blockers,
        "deadlocks": lambda: cycles,
        "deadlock_members": lambda: members,
        "blocker_tree": lambda: locks.blocker_tree(thread),
        "stack_runs": lambda: found,
        "stuck_threads": lambda: stuck.genuine(verdicts).drop("frames"),
        "lock_holders": lambda: holders,
        "pool_trends": lambda: trend,
        "pool_trend_counts": lambda: series.pool_trend_counts(thread, dump),
        "timelines": lambda: series.flagged_timelines(occ, flags),
        "all_timelines": lambda: series.all_timelines(occ),
        "pool_utilization": lambda: single.pool_utilization(thread),
        "quality": lambda: quality.quality_notes(dump, occ, t.parse_issue),
        "marked_threads": lambda: marked_threads(thread),
        "middleware": lambda: platform,
        "middleware_panel": lambda: middleware.middleware_panel(thread, platform),
        "nodes": lambda: fleet.node_summary(thread, dump, findings),
        "outliers": lambda: fleet.outliers(thread),
        "findings": lambda: findings,
    }
    if baseline is not None:
        now = B.build(thread, dump)
        out["state_shifts"] = lambda: B.state_shifts(now.state, baseline.state)
        out["pool_deltas"] = lambda: B.pool_deltas(now.pool, baseline.pool)
        out["new_stacks"] = lambda: B.new_recurring_stacks(thread, baseline.stack)
    return Analysis(ctx, findings, ResultTables(out))


def release_drift(t: Tables, baseline: B.Baseline, options: Options = Options()) -> dict[str, DataFrame]:
    """What differs from a stored baseline; nothing is recorded."""
    thread = derive(t.thread, options)
    now = B.build(thread, t.dump)
    return {
        "state_shifts": B.state_shifts(now.state, baseline.state),
        "pool_deltas": B.pool_deltas(now.pool, baseline.pool),
        "new_stacks": B.new_recurring_stacks(thread, baseline.stack),
    }
