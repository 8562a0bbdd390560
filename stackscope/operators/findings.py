"""Detectors and severity-ranked findings.

A detector is a function ``(Context) -> DataFrame`` with the finding columns,
registered under an order that breaks ties within a severity.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscope.functions.frames import any_sig_contains
from stackscope.functions.names import is_stuck_marked
from stackscope.functions.scan import running
from stackscope.knowledge import BUNDLED_RULES, MIN_POOL_FOR_SATURATION, MUXER_QUEUE, SOCKET_FRAMES
from stackscope.operators import middleware as mw
from stackscope.operators.derive import java_threads
from stackscope.operators.rules import evaluate_rules, union_all
from stackscope.operators.series import dump_count
from stackscope.operators.single import count_if, pool_utilization
from stackscope.options import Options
from stackscope.session import store

SEVERITIES = ["CRITICAL", "WARNING", "INFO"]
DUMP = ["series_id", "dump_idx"]


@dataclass
class Context:
    """What detectors read. ``thread`` is the derived table."""

    dump: DataFrame
    thread: DataFrame
    occ: DataFrame
    verdicts: DataFrame
    cycles: DataFrame
    blockers: DataFrame
    trend: DataFrame
    platform: DataFrame
    pauses: DataFrame | None = None
    pinned: DataFrame | None = None
    rules: tuple = BUNDLED_RULES
    options: Options = field(default_factory=Options)


DETECTORS: dict[str, tuple[int, Callable[[Context], DataFrame]]] = {}


def detector(name: str, order: int | None = None):
    """Register a detector; site detectors come after the built-in ones by default."""
    def add(fn):
        DETECTORS[name] = (order if order is not None else 1000 + len(DETECTORS), fn)
        return fn
    return add


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def finding(df: DataFrame, id_, severity, title, detail, recommendation, confidence="high", why="",
            **evidence) -> DataFrame:
    """Project detector rows to findings; evidence values become strings (lists as JSON)."""
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)
    sev = col(severity)
    order = F.when(sev == "CRITICAL", 0).when(sev == "WARNING", 1).otherwise(2)
    pairs = []
    for k, v in evidence.items():
        pairs += [F.lit(k), v.cast("string")]
    ev = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select("series_id", col(id_).alias("id"), sev.alias("severity"), order.alias("sev_ord"),
                     col(title).alias("title"), col(detail).alias("detail"),
                     col(recommendation).alias("recommendation"), col(confidence).alias("confidence"),
                     col(why).alias("why"),
                     F.map_filter(ev, lambda k, v: v.isNotNull()).alias("evidence"))


def _short(name: Column) -> Column:
    return F.when(F.length(name) > 60, F.concat(F.substring(name, 1, 57), F.lit("..."))).otherwise(name)


@detector("deadlock", 10)
def deadlock(ctx: Context) -> DataFrame:
    return finding(
        ctx.cycles, "deadlock", "CRITICAL", _text("Deadlock of ", F.col("size"), " threads"),
        _text("Each of these ", F.col("size"), " threads holds a lock that another one of them needs."),
        "Take these locks in one global order or use timed attempts; only a restart frees them now.",
        "high", F.when(F.col("source") == "jvm", "reported by the JVM")
        .otherwise("a closed cycle in the waits-for graph"),
        dump=F.col("dump_idx"), threads=F.to_json("threads"), source=F.col("source"))


def marked_threads(t: DataFrame) -> DataFrame:
    """Every thread name that the server marked, with the dumps it is in; findings show the first 100."""
    return t.filter(is_stuck_marked(F.col("name"))).groupBy("series_id", "name").agg(
        F.when(F.col("name").contains("[STUCK]"), "weblogic-stuck").otherwise("weblogic-hogging").alias("id"),
        F.count("*").alias("n"))


def _marked(ctx: Context, cond, id_, severity, label) -> DataFrame:
    names = ctx.thread.filter(cond).groupBy("series_id", "name").agg(
        F.count("*").alias("n"), F.min(F.struct("dump_idx", "thread_ord")).alias("_first"))
    w = Window.partitionBy("series_id").orderBy("_first", "name")
    shown = names.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 100").groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "name", "n"))).alias("s"))
    df = names.groupBy("series_id").agg(F.count("*").alias("threads")).join(shown, "series_id")
    return finding(
        df, id_, severity, _text("WebLogic marked ", F.col("threads"), " thread(s) ", label),
        "The server's own health monitor timed these requests and marked their threads.",
        "Read the stacks: the usual cause is an outbound call without a timeout.",
        "high", "the marker is measured by the server",
        threads=F.to_json(F.transform("s", lambda x: x["name"])),
        dumpsSeen=F.to_json(F.transform("s", lambda x: x["n"])))


@detector("weblogic-stuck", 20)
def weblogic_stuck(ctx: Context) -> DataFrame:
    return _marked(ctx, F.col("name").contains("[STUCK]"), "weblogic-stuck", "CRITICAL", "[STUCK]")


@detector("weblogic-hogging", 21)
def weblogic_hogging(ctx: Context) -> DataFrame:
    cond = ~F.col("name").contains("[STUCK]") & F.col("name").contains("[HOGGING]")
    return _marked(ctx, cond, "weblogic-hogging", "WARNING", "[HOGGING]")


@detector("stuck-thread", 30)
def stuck_thread(ctx: Context) -> DataFrame:
    # a run has two dumps or more, also where only its last ones are in this batch
    v = ctx.verdicts.filter(F.col("kind").isin("NATIVE_WAIT", "SPINNING", "FROZEN", "BLOCKED_CHAIN"))
    native = F.col("kind") == "NATIVE_WAIT"
    title = (F.when(native, _text("Persistent native wait: ", _short(F.col("name"))))
             .when(F.col("kind") == "SPINNING", _text("Spinning thread: ", _short(F.col("name"))))
             .when(F.col("kind") == "BLOCKED_CHAIN",
                   _text("Blocked for ", F.col("run_length"), " dumps: ", _short(F.col("name"))))
             .otherwise(_text("Frozen for ", F.col("run_length"), " dumps: ", _short(F.col("name")))))
    rec = (F.when(native, "Harmless unless the thread should be serving a request; then add a read timeout.")
           .when(F.col("kind") == "SPINNING", "Profile the frames shown; they point into the loop.")
           .when(F.col("kind") == "BLOCKED_CHAIN", "Follow the lock to its holder and shorten what it guards.")
           .otherwise("Bound the call in the top frame with a timeout, or profile it."))
    return finding(
        v, F.when(native, "idle-native-wait").otherwise("stuck-thread"),
        F.when(native, "INFO").when(F.col("severity") == "CRITICAL", "CRITICAL").otherwise("WARNING"),
        title, _text("\"", F.col("name"), "\" kept its stack through dumps ", F.col("from_dump"), "..",
                     F.col("to_dump"), ": ", F.col("why"), "."),
        rec, F.col("confidence"), F.col("why"),
        thread=F.col("name"), dumps=_text(F.col("from_dump"), "..", F.col("to_dump")),
        states=F.to_json("states"), cpuDeltaMillis=F.col("cpu_delta_ms"),
        wallClockSeconds=F.col("wall_s"), victims=F.when(F.col("victims") > 0, F.col("victims")),
        frames=F.to_json(F.slice("frozen_frames", 1, 12)))


@detector("network-hang", 40)
def network_hang(ctx: Context) -> DataFrame:
    sock = lambda s: s.contains("socketRead") | s.contains("NioSocketImpl.park")
    frozen = ctx.verdicts.filter(~F.col("kind").isin("IDLE", "HOUSEKEEPING", "DISCARDED")) \
        .filter(F.exists(F.slice("frozen_frames", 1, 4), sock))
    marked = ctx.thread.filter(is_stuck_marked(F.col("name"))).select(
        "series_id", F.col("norm_name").alias("name")).distinct().withColumn("_m", F.lit(True))
    fz = frozen.join(marked, ["series_id", "name"], "left").groupBy("series_id").agg(
        F.count("*").alias("frozen"), F.coalesce(F.bool_or("_m"), F.lit(False)).alias("stuck_marked"))
    in_read = (F.col("state") == "RUNNABLE") & any_sig_contains(F.col("frames"), SOCKET_FRAMES, top=4)
    per_dump = java_threads(ctx.thread).filter(in_read).groupBy(*DUMP).agg(F.count("*").alias("n"))
    worst = per_dump.groupBy("series_id").agg(
        F.max_by(F.struct("dump_idx", "n"), F.struct("n", -F.col("dump_idx"))).alias("w"))
    df = worst.join(fz, "series_id", "full_outer").select(
        "series_id", F.coalesce("w.n", F.lit(0)).alias("worst"), F.coalesce("w.dump_idx", F.lit(-1)).alias("at"),
        F.coalesce("frozen", F.lit(0)).alias("frozen"), F.coalesce("stuck_marked", F.lit(False)).alias("marked"))
    severe = F.col("marked") | (F.col("worst") >= ctx.options.critical_victims)
    none = F.col("frozen") == 0
    return finding(
        df, "network-hang", F.when(severe, "CRITICAL").when(none, "INFO").otherwise("WARNING"),
        F.when(none, "Threads in blocking socket reads").otherwise("Threads in blocking socket reads across dumps"),
        _text("At most ", F.col("worst"), " RUNNABLE thread(s) sit in a socket read at once (dump ", F.col("at"),
              "); ", F.col("frozen"), " kept that stack across dumps."),
        "Set read timeouts on every outbound call and check firewalls that drop idle connections.",
        F.when(none, "low").otherwise("high"),
        F.when(none, "one snapshot can catch a read by chance").otherwise("the same read is open in consecutive dumps"),
        dump=F.col("at"), runnableInSocketRead=F.col("worst"), frozenAcrossDumps=F.col("frozen"))


@detector("finalizer-backlog", 50)
def finalizer_backlog(ctx: Context) -> DataFrame:
    fin = ctx.thread.filter(F.col("name") == "Finalizer").groupBy(*DUMP).agg(
        F.min_by(F.struct("state", "frames"), "thread_ord").alias("f")).filter(F.size("f.frames") > 0)
    idle = (F.col("f.state") == "WAITING") & any_sig_contains(
        F.col("f.frames"), ("java.lang.ref.ReferenceQueue.remove", "java.lang.Object.wait"), top=4)
    busy = fin.filter(~idle).groupBy("series_id").agg(
        F.count("*").alias("busy"), F.min("dump_idx").alias("_a"), F.max("dump_idx").alias("_b"),
        F.max_by("f.state", "dump_idx").alias("state"),
        F.max_by(F.get("f.frames", F.lit(0))["raw"], "dump_idx").alias("frame")).join(dump_count(ctx.dump), "series_id")
    lasting = F.col("busy") >= F.greatest(F.lit(2), F.floor(F.col("n_dumps") / 2))
    return finding(
        busy, "finalizer-backlog", F.when(lasting, "WARNING").otherwise("INFO"),
        _text("Finalizer busy in ", F.col("busy"), " of ", F.col("n_dumps"), " dump(s)"),
        _text("Instead of waiting for work the Finalizer is ", F.col("state"), " in ", F.col("frame"), "."),
        "Close resources explicitly and look for classes with finalizers on the hot path.",
        F.when(lasting, "high").otherwise("low"), "an idle Finalizer waits on its reference queue",
        dumps=_text(F.col("_a"), "..", F.col("_b")), busyDumps=F.col("busy"),
        finalizerState=F.col("state"), frame=F.col("frame"))


@detector("top-blocker", 60)
def top_blocker(ctx: Context) -> DataFrame:
    best = ctx.blockers.groupBy("series_id").agg(F.max_by(
        F.struct("dump_idx", "holder", "direct", "transitive"),
        F.struct("transitive", -F.col("dump_idx"), -F.col("first_ord"))).alias("b")) \
        .select("series_id", "b.*").filter("transitive >= 2")
    stack = ctx.thread.select(*DUMP, F.col("name").alias("holder"), "thread_ord", "frames") \
        .join(best.select(*DUMP, "holder"), [*DUMP, "holder"], "left_semi") \
        .groupBy(*DUMP, "holder").agg(F.max_by(
            F.slice(F.transform("frames", lambda f: f["raw"]), 1, 8), "thread_ord").alias("stack"))
    df = best.join(stack, [*DUMP, "holder"], "left")
    return finding(
        df, "top-blocker",
        F.when(F.col("transitive") >= ctx.options.critical_victims, "CRITICAL").otherwise("WARNING"),
        _text("\"", F.col("holder"), "\" holds up ", F.col("transitive"), " thread(s)"),
        _text("In dump ", F.col("dump_idx"), " its locks block ", F.col("direct"), " thread(s) directly and ",
              F.col("transitive"), " in all."),
        "Read its stack: bound its I/O or shrink the guarded section.",
        "high", "counted from the waits-for graph",
        dump=F.col("dump_idx"), thread=F.col("holder"), directVictims=F.col("direct"),
        transitiveVictims=F.col("transitive"), frames=F.to_json("stack"))


@detector("long-gc-pause", 70)
def long_gc_pause(ctx: Context) -> DataFrame | None:
    if ctx.pauses is None:
        return None
    long = ctx.pauses.filter("duration_ms >= 1000")
    w = Window.partitionBy("series_id").orderBy(F.desc("duration_ms"), "start_ts", "cause")
    top = long.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 5").groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "start_ts", "duration_ms", "cause", "kind"))).alias("p")) \
        .withColumn("worst", F.get("p", F.lit(0)))
    return finding(
        top, "long-gc-pause",
        F.when(F.col("worst.duration_ms") >= 5000, "CRITICAL").otherwise("WARNING"),
        _text("Stop-the-world pause of ", F.round("worst.duration_ms", 0).cast("long"), " ms (",
              F.col("worst.cause"), ")"),
        _text(F.size("p"), " listed pause(s) lasted a second or more; nothing runs meanwhile."),
        "Tune the heap and the pause target, or use a collector with short pauses.",
        "high", "durations come from the JVM's own log", pauses=F.to_json("p"))


@detector("frequent-safepoints", 71)
def frequent_safepoints(ctx: Context) -> DataFrame | None:
    if ctx.pauses is None:
        return None
    us = F.unix_micros("start_ts")
    agg = ctx.pauses.groupBy("series_id").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("stopped"), F.min(us).alias("_a"),
        F.max_by(us + (F.col("duration_ms") * 1000).cast("long"), us).alias("_b"))
    window = F.greatest(F.lit(1), F.floor((F.col("_b") - F.col("_a")) / 1000)).cast("double")
    df = agg.withColumn("window", window).withColumn("pct", 100.0 * F.col("stopped") / F.col("window")) \
            .filter("pct >= 10.0 AND n >= 5")
    return finding(
        df, "frequent-safepoints", "WARNING",
        _text("Application stopped ", F.format_number("pct", 1), "% of the time (", F.col("n"), " pauses)"),
        _text(F.round("stopped").cast("long"), " ms of ", F.round("window").cast("long"), " ms were pauses."),
        "Check the allocation rate, explicit collections and safepoints not caused by collection.",
        "high", "summed from the JVM's own log", stoppedMs=F.round("stopped").cast("long"),
        windowMs=F.round("window").cast("long"), pauseCount=F.col("n"))


@detector("thread-leak", 80)
def thread_leak(ctx: Context) -> DataFrame:
    return finding(
        ctx.trend.filter("leak_suspect"), "thread-leak", "WARNING",
        _text("Pool \"", F.col("pool"), "\" only grows: ", F.col("first_count"), " to ", F.col("last_count")),
        "Its thread count never fell over the series; tasks may never end or pools are made per request.",
        "Compare its stacks in the first and last dump; shut pools down and bound their size.",
        "medium", "healthy pools shrink or level off between dumps",
        pool=F.col("pool"), growth=F.col("growth"))


@detector("pool-sizing", 90)
def pool_sizing(ctx: Context) -> DataFrame:
    u = pool_utilization(ctx.thread).join(
        dump_count(ctx.dump).filter("n_dumps >= 2"), "series_id", "left_semi")
    tight = (F.col("avg_busy_pct") >= 90) & (F.col("blocked_seen") > 0)
    loose = (F.col("avg_busy_pct") <= 10) & (F.col("max_size") >= 20)
    pct = F.round("avg_busy_pct").cast("long")
    return finding(
        u.filter(tight | loose), "pool-sizing", "INFO",
        F.when(tight, _text("Pool \"", F.col("pool"), "\" is ", pct, "% busy with blocked work"))
        .otherwise(_text("Pool \"", F.col("pool"), "\" is ", pct, "% busy at size ", F.col("max_size"))),
        "A hint from the observed load; compare it with the configured limits.",
        F.when(tight, "Raise the limit or fix what keeps the workers busy.").otherwise("Shrink the pool."),
        "medium", "load is measured per dump", pool=F.col("pool"), avgBusyPct=pct, observedMax=F.col("max_size"),
        advice=F.when(tight, "increase").otherwise("oversized"))


@detector("rules", 100)
def rules_detector(ctx: Context) -> DataFrame:
    r = evaluate_rules(ctx.thread, ctx.dump, ctx.occ, ctx.rules)
    return finding(
        r, F.col("rule_id"), F.col("severity"), F.col("title"),
        _text("Rule \"", F.col("rule_id"), "\" matched ", F.col("matched"), " thread(s) in dump ", F.col("dump_idx"), "."),
        F.col("recommendation"), F.col("confidence"), "every match shows the rule's frames and state",
        dump=F.col("dump_idx"), matchedThreads=F.col("matched"), threads=F.to_json("threads"), frame=F.col("frame"))


@detector("virtual-thread-pinned", 110)
def virtual_thread_pinned(ctx: Context) -> DataFrame | None:
    if ctx.pinned is None:
        return None
    from stackscope.operators.samples import pinned_summary
    return finding(
        pinned_summary(ctx.pinned), "virtual-thread-pinned", "WARNING",
        _text(F.col("n"), " pinned virtual thread event(s)"),
        _text("A virtual thread blocked its carrier, for up to ", F.round("max_ms", 2), " ms."),
        "Replace synchronized sections around blocking calls with explicit locks.",
        "high", "recorded by the JVM", count=F.col("n"), maxMs=F.col("max_ms"), frames=F.to_json("frames"))


def _on(ctx: Context, *platforms: str) -> DataFrame:
    keep = ctx.platform.filter(F.col("platform").isin(*platforms)).select("series_id", "platform")
    return ctx.thread.join(keep, "series_id")


def _starved(ctx: Context, t: DataFrame, group, id_, label, needs_blocked=False) -> DataFrame:
    s = mw.pool_health_summary(mw.pool_health(t, group)).filter(
        (F.col("total") >= MIN_POOL_FOR_SATURATION) & F.col("saturated"))
    severe = F.col("max_blocked") >= ctx.options.critical_victims
    if needs_blocked:
        s = s.filter("max_blocked > 0")
        confidence = F.lit("medium")
    else:
        severe = severe | F.col("saturated_throughout")
        confidence = F.when(F.col("saturated_throughout"), "high").otherwise("medium")
    return finding(
        s, id_, F.when(severe, "CRITICAL").otherwise("WARNING"),
        _text(label, " ", F.col("grp"), ": all ", F.col("total"), " workers busy",
              F.when(F.col("saturated_throughout"), " in every dump").otherwise("")),
        _text("In dump ", F.col("worst_dump"), " no worker is free; up to ", F.col("max_blocked"), " are BLOCKED."),
        "See what the busy workers wait for; raise the limit only when the backend has room.",
        confidence, "idle workers are told apart by their stacks",
        group=F.col("grp"), dump=F.col("worst_dump"), threads=F.col("total"), busy=F.col("busy"),
        blocked=F.col("max_blocked"), saturatedAllDumps=F.col("saturated_throughout"))


@detector("weblogic-thread-starvation", 120)
def weblogic_thread_starvation(ctx: Context) -> DataFrame:
    q = mw.queue_group()
    return _starved(ctx, _on(ctx, "WEBLOGIC"), F.when(q != MUXER_QUEUE, q),
                    "weblogic-thread-starvation", "WebLogic queue")


@detector("weblogic-muxer-blocked", 121)
def weblogic_muxer_blocked(ctx: Context) -> DataFrame:
    per = _on(ctx, "WEBLOGIC").filter(mw.muxer()).groupBy(*DUMP).agg(
        F.count("*").alias("n"), count_if(F.col("state") == "BLOCKED").alias("b"))
    s = per.groupBy("series_id").agg(
        F.max("n").alias("muxers"),
        F.max_by(F.struct("dump_idx", "b"), F.struct("b", -F.col("dump_idx"))).alias("w")).filter("w.b > 0")
    every = F.col("w.b") >= F.col("muxers")
    return finding(
        s, "weblogic-muxer-blocked", F.when(every, "CRITICAL").otherwise("WARNING"),
        _text(F.col("w.b"), " of ", F.col("muxers"), " socket muxer threads BLOCKED"),
        _text("In dump ", F.col("w.dump_idx"), " muxers wait for a monitor instead of polling sockets."),
        "Find the holder; muxers must share no lock with application code.",
        "high", "a healthy muxer polls", dump=F.col("w.dump_idx"), muxerThreads=F.col("muxers"),
        blocked=F.col("w.b"))


@detector("tomcat-connector-exhaustion", 130)
def tomcat_connector_exhaustion(ctx: Context) -> DataFrame:
    return _starved(ctx, _on(ctx, "TOMCAT"), mw.connector_group(),
                    "tomcat-connector-exhaustion", "Tomcat connector")


@detector("tomcat-poller-blocked", 131)
def tomcat_poller_blocked(ctx: Context) -> DataFrame:
    b = _on(ctx, "TOMCAT").withColumn("grp", mw.support_group()).filter(
        F.col("grp").isNotNull() & (F.col("state") == "BLOCKED"))
    s = b.groupBy("series_id", "grp").agg(F.count("*").alias("n"), F.min("name").alias("first"))
    at = b.groupBy("series_id").agg(F.max("dump_idx").alias("at"))
    return finding(
        s.join(at, "series_id"), "tomcat-poller-blocked", "CRITICAL",
        _text("Tomcat connector ", F.col("grp"), ": poller or acceptor BLOCKED"),
        "While it waits for a monitor the connector takes no new work.",
        "Find the holder; these threads must share no lock with application code.",
        "high", "a healthy poller waits in its selector", connector=F.col("grp"), threads=F.col("n"),
        thread=F.col("first"), dump=F.col("at"))


@detector("tomcat-background-processor-blocked", 132)
def tomcat_background_processor_blocked(ctx: Context) -> DataFrame:
    b = _on(ctx, "TOMCAT").filter(F.col("name").startswith("ContainerBackgroundProcessor")
                                  & (F.col("state") == "BLOCKED"))
    s = b.groupBy("series_id").agg(
        F.count("*").alias("n"), F.max_by("name", F.struct("dump_idx", "thread_ord")).alias("name"),
        F.min("dump_idx").alias("_a"), F.max("dump_idx").alias("_b")).join(dump_count(ctx.dump), "series_id")
    lasting = F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("n_dumps") / 2))
    return finding(
        s, "tomcat-background-processor-blocked", F.when(lasting, "CRITICAL").otherwise("WARNING"),
        _text("Tomcat background processor BLOCKED in ", F.col("n"), " of ", F.col("n_dumps"), " dump(s)"),
        "Sessions do not expire while it waits.", "Find the holder of the monitor.",
        F.when(lasting, "high").otherwise("medium"), "between runs it sleeps, it does not block",
        thread=F.col("name"), dumps=_text(F.col("_a"), "..", F.col("_b")), blockedDumps=F.col("n"))


@detector("websphere-webcontainer-saturation", 140)
def websphere_webcontainer_saturation(ctx: Context) -> DataFrame:
    g = F.when(F.col("name").rlike(r"^WebContainer : \d+$"), F.lit("WebContainer"))
    return _starved(ctx, _on(ctx, "WEBSPHERE"), g, "websphere-webcontainer-saturation", "WebSphere pool")


@detector("liberty-executor-saturation", 141)
def liberty_executor_saturation(ctx: Context) -> DataFrame:
    g = F.when(F.col("name").rlike(r"^Default Executor-thread-\d+$"), F.lit("Default Executor"))
    return _starved(ctx, _on(ctx, "LIBERTY"), g, "liberty-executor-saturation", "Liberty pool",
                    needs_blocked=True)


@detector("javacore-oom-trigger", 142)
def javacore_oom_trigger(ctx: Context) -> DataFrame:
    keep = ctx.platform.filter(F.col("platform").isin("WEBSPHERE", "LIBERTY")).select("series_id")
    r = F.col("dump_reason")
    oom = r.contains("OutOfMemoryError") | (r.contains("systhrow") & r.contains("OutOfMemory"))
    d = ctx.dump.join(keep, "series_id", "left_semi").filter(oom).groupBy("series_id").agg(
        F.min_by(F.struct("dump_idx", "source_name", "dump_reason"), "dump_idx").alias("d"))
    return finding(
        d, "javacore-oom-trigger", "CRITICAL", "Dump written because memory ran out",
        _text("Dump ", F.col("d.dump_idx"), " (", F.col("d.source_name"), "): ", F.col("d.dump_reason")),
        "Analyse the heap dump; the threads show the victims, not the cause.",
        "high", "the JVM records the reason", dump=F.col("d.dump_idx"), event=F.col("d.dump_reason"))


def run_detectors(ctx: Context, names: list[str] | None = None) -> DataFrame:
    """All findings with the order of their detector."""
    parts = []
    for name, (order, fn) in sorted(DETECTORS.items(), key=lambda kv: kv[1][0]):
        if names is not None and name not in names:
            continue
        df = fn(ctx)
        if df is not None:
            parts.append(df.withColumn("detector_ord", F.lit(order)))
    return union_all(parts)


def rank_findings(findings: DataFrame) -> DataFrame:
    """By severity, then detector, then title.

    Findings are stored in ranges of that order over all series; ranks are counted inside ranges and carried on, so a
    series with very many findings has many tasks.
    """
    order = ["sev_ord", "detector_ord", "title", "_evidence"]
    rows = store(findings.withColumn("_evidence", F.to_json("evidence")))
    ranged = store(rows.repartitionByRange("series_id", *order).withColumn("_range", F.spark_partition_id()))
    return running(ranged, ["series_id"], "_range", order, total={"rank": F.lit(1)}) \
        .withColumn("rank", F.col("rank").cast("int")).drop("_range", "_evidence")


def severity_gate(findings: DataFrame, fail_on: str = "critical") -> DataFrame:
    """One row per series with findings: is the gate met."""
    met = F.col("severity") == "CRITICAL"
    if fail_on == "warning":
        met = met | (F.col("severity") == "WARNING")
    return findings.groupBy("series_id").agg(
        count_if(met).alias("hits"), (count_if(met) > 0).alias("failed"))


def findings_summary(ranked: DataFrame, top: int = 10) -> DataFrame:
    """Counts per severity and the first findings, as the summary document."""
    counts = ranked.groupBy("series_id").agg(*[
        count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    first = ranked.filter(F.col("rank") <= top).groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "severity", "title"))),
                    lambda s: F.struct(s["id"].alias("id"), s["severity"].alias("severity"),
                                       s["title"].alias("title"))).alias("top"))
    return counts.join(first, "series_id", "left")


def summary_text(ranked: DataFrame, top: int = 5) -> DataFrame:
    """The same as one chat message per series."""
    s = findings_summary(ranked, top)
    lines = F.array_join(F.transform(F.coalesce("top", F.array()), lambda f: F.concat(
        F.lit("- ["), f["severity"], F.lit("] "), f["title"])), "\n")
    return s.select("series_id", F.concat(
        F.col("critical").cast("string"), F.lit(" critical, "), F.col("warning").cast("string"),
        F.lit(" warning, "), F.col("info").cast("string"), F.lit(" info\n"), lines).alias("text"))
