import pytest
from dumps import dump, line_table, thread
from pyspark.sql import functions as F

from stackscope import Options
from stackscope.functions import frames
from stackscope.knowledge import RuleEntry
from stackscope.operators import baseline as B
from stackscope.operators import export, findings, fleet, history, locks, quality, series, single, stuck, views
from stackscope.operators.derive import derive
from stackscope.operators.findings import DETECTORS, Context, detector, finding, run_detectors
from stackscope.operators.pauses import pause_covers
from stackscope.operators.redact import redact
from stackscope.operators import rules as R
from stackscope.operators.rules import evaluate_rules
from stackscope.plans.analyze import analyze, release_drift
from stackscope.session import store
from stackscope.sources import kb
from stackscope.sources.hotspot import parse_hotspot
from stackscope.sources.tables import Tables


def stored(t: Tables) -> Tables:
    return Tables(store(t.dump), store(t.thread), store(t.jvm_cycle), store(t.parse_issue))


_PARSED: dict = {}


def parse(spark, lines, series="series"):
    """Stored tables of the text; the same text is parsed once per session."""
    key = (series, tuple(lines))
    if key not in _PARSED:
        _PARSED[key] = stored(parse_hotspot(line_table(spark, lines, series=series)))
    return _PARSED[key]


def fired(t, rule):
    d = derive(t.thread)
    return evaluate_rules(d, t.dump, series.series_index(d), (rule,))


def wants(a):
    return f"waiting to lock <0x{a:08x}> (a com.shop.L{a})"


def has(a):
    return f"locked <0x{a:08x}> (a com.shop.L{a})"


def test_victims_cycles_and_tree(spark):
    """A blocks B, B blocks C and D; X and Y wait for each other and Z for X."""
    def t(name, n, want=None, hold=None):
        lock = {0: ([wants(want)] if want else []) + ([has(hold)] if hold else [])}
        return thread(name, n, state="BLOCKED" if want else "RUNNABLE", locks=lock)
    d = dump("2024-03-01 10:00:00", [t("A", 1, None, 1), t("B", 2, 1, 2), t("C", 3, 2), t("D", 4, 2),
                                     t("X", 5, 4, 3), t("Y", 6, 3, 4), t("Z", 7, 3)])
    th = derive(parse(spark, d).thread)
    edges = locks.waits_for(th)
    got = {r.holder: (r.direct, r.transitive) for r in locks.transitive_victims(edges).collect()}
    assert got == {"A": (1, 3), "B": (2, 2), "X": (2, 2), "Y": (1, 2)}
    cyc = locks.deadlock_cycles(locks.deadlock_members(edges)).collect()
    assert [(r.threads, r.source) for r in cyc] == [(["X", "Y"], "wait-for-graph")]
    tree = sorted((r.root, r.depth, r.name) for r in locks.blocker_tree(th).collect())
    assert tree == [("A", 0, "A"), ("A", 1, "B"), ("A", 2, "C"), ("A", 2, "D")]
    top = locks.contended_locks(th).orderBy("rank").first()
    assert (top.lock_class, top.holder, top.waiters) == ("com.shop.L2", "B", 2)


def test_long_chain_victims(spark):
    n = 70
    rows = [("s", 0, f"t{i}", f"t{i + 1}", i) for i in range(n)]
    e = spark.createDataFrame(rows, "series_id string, dump_idx int, waiter string, holder string, waiter_ord int")
    got = {r.holder: r.transitive for r in locks.transitive_victims(e).collect()}
    assert got == {f"t{i}": i for i in range(1, n + 1)}


def test_cycle_only_dump_has_a_tree(spark):
    def t(name, n, want, hold):
        return thread(name, n, state="BLOCKED", locks={0: [wants(want), has(hold)]})
    th = derive(parse(spark, dump(None, [t("P", 1, 2, 1), t("Q", 2, 3, 2), t("R", 3, 1, 3)])).thread)
    got = sorted((r.root, r.depth, r.name) for r in locks.blocker_tree(th).collect())
    assert len(got) == 3 and [g[1] for g in got] == [0, 1, 2]


def stuck_series():
    """Three dumps: a spinner, a kernel wait, a blocked pair, an idle worker and one that moves."""
    out = []
    for k in range(3):
        out += dump(f"2024-03-01 10:00:{k * 20:02d}", [
            thread("spinner", 1, cpu=k * 19000.0, frames=("com.shop.Loop.spin",), locks={0: [has(9)]}),
            thread("reader", 2, cpu=1.0, frames=("java.net.SocketInputStream.socketRead0", "com.shop.Net.get")),
            thread("b1", 3, cpu=1.0, state="BLOCKED", frames=("com.shop.Cache.get",), locks={0: [wants(9)]}),
            thread("b2", 4, cpu=1.0, state="BLOCKED", frames=("com.shop.Cache.get",), locks={0: [wants(9)]}),
            thread("poller", 5, cpu=1.0, frames=("sun.nio.ch.EPoll.wait", "com.shop.P.run")),
            thread("mover", 6, cpu=1.0, frames=(f"com.shop.M.m{k}",)),
            thread("Finalizer", 7, cpu=1.0, state="WAITING", frames=("java.lang.ref.ReferenceQueue.remove",), sync=[])])
    return out


def test_verdicts_and_findings(spark):
    t = parse(spark, stuck_series())
    a = analyze(t)
    v = {r.name: (r.kind, r.severity, r.confidence, r.victims) for r in a.context.verdicts.collect()}
    assert v == {
        "spinner": ("SPINNING", "CRITICAL", "high", 2), "reader": ("NATIVE_WAIT", "INFO", "high", 0),
        "b1": ("BLOCKED_CHAIN", "WARNING", "high", 2), "b2": ("BLOCKED_CHAIN", "WARNING", "high", 2),
        "poller": ("IDLE", None, "high", 0)}
    f = [(r.id, r.severity) for r in a.findings.orderBy("rank").collect()]
    assert f[0] == ("stuck-thread", "CRITICAL") and ("top-blocker", "WARNING") in f and ("idle-native-wait", "INFO") in f
    assert ("network-hang", "WARNING") in f and not any(i == "finalizer-backlog" for i, _ in f)
    h = a.tables["lock_holders"].collect()
    assert [(r.holder, r.dumps, r.starved_total) for r in h] == [("spinner", 3, 2)]
    flags = {r.display_name: r.flags for r in a.tables["timelines"].collect()}
    assert flags["spinner"] == ["stuck", "persistent-lock-holder"] and "reader" not in flags
    for name in ("nodes", "quality", "thread_detail", "stacks", "cpu", "all_timelines", "method_stats"):
        assert a.tables[name].count() > 0, name


def test_pauses_take_the_blame(spark):
    t = parse(spark, stuck_series())
    pause = spark.createDataFrame([("series", "2024-03-01 09:59:59", 45000.0, "Full", "gc")],
                                  "series_id string, ts string, duration_ms double, cause string, kind string") \
        .select("series_id", F.to_timestamp("ts").alias("start_ts"), "duration_ms", "cause", "kind")
    a = analyze(t, pauses=pause)
    kinds = {r.kind for r in a.context.verdicts.collect()}
    assert kinds == {"DISCARDED", "IDLE"}
    ids = {r.id: r.severity for r in a.findings.collect()}
    assert "stuck-thread" not in ids and ids["long-gc-pause"] == "CRITICAL"


def test_top_samples_stand_in_for_cpu_fields(spark):
    lines = []
    for k in range(3):
        lines += dump(f"2024-03-01 10:00:{k * 20:02d}", [
            thread("hot", 1, frames=("com.shop.A.a",), nid="0x10"),
            thread("cold", 2, frames=("x.Y.read0", "com.shop.A.b"), nid="0x11"),
            thread("plain", 3, frames=("com.shop.A.c",), nid="0x12"),
            thread("jdk", 4, frames=("java.util.Foo.bar",), nid="0x13")])
    t = parse(spark, lines)
    d = derive(t.thread)
    os = spark.createDataFrame([("series", 1, 16, 97.0, 1.0), ("series", 2, 17, 0.5, 0.0), ("series", 3, 18, 20.0, 0.0)],
                               "series_id string, sample_ord long, pid long, cpu_pct double, mem_pct double")
    v = stuck.classify_stuck(series.stuck_candidates(series.series_index(d), t.dump), locks.contended_locks(d),
                             locks.transitive_victims(locks.waits_for(d)), os)
    assert {r.name: r.kind for r in v.collect()} == {
        "hot": "SPINNING", "cold": "NATIVE_WAIT", "plain": "FROZEN", "jdk": "DISCARDED"}
    rows = [(r.name, r.top_percent) for r in single.cpu_attribution(d, os).filter("dump_idx = 0").orderBy("rank").collect()]
    assert rows == [("hot", 97.0), ("plain", 20.0), ("cold", 0.5)]


def test_idle_server_has_no_findings(spark):
    lines = []
    for k in range(3):
        lines += dump(f"2024-03-01 10:00:{k * 20:02d}", [
            thread("http-nio-8080-exec-1", 1, state="WAITING", frames=("org.apache.tomcat.util.threads.TaskQueue.take",), sync=[]),
            thread("http-nio-8080-Acceptor", 2, frames=("sun.nio.ch.Net.accept0", "org.apache.tomcat.util.net.Acceptor.run")),
            thread("Reference Handler", 3, frames=("java.lang.ref.Reference.waitForReferencePendingList",))])
    a = analyze(parse(spark, lines))
    assert a.findings.count() == 0
    assert a.tables["quality"].count() == 0


def test_leak_and_pool_counts(spark):
    lines = []
    for k, n in enumerate((3, 5, 7, 9, 11)):
        lines += dump(f"2024-03-01 10:00:{k * 10:02d}", [thread(f"pool-9-thread-{i}", i + 1, sync=[]) for i in range(n)])
    t = parse(spark, lines)
    r = series.pool_trend(derive(t.thread), t.dump).first()
    assert (r.pool, r.first_count, r.last_count, r.growth, r.leak_suspect) == ("pool-9", 3, 11, 8, True)


def test_saturated_pools_and_gating(spark):
    def workers(k, name, frame, state="RUNNABLE"):
        return [thread(name.format(i), 100 * k + i + 1, state=state, frames=(frame,), sync=[]) for i in range(8)]
    lines = []
    for k in range(2):
        lines += dump(f"2024-03-01 10:00:{k * 20:02d}", workers(1, "http-nio-8080-exec-{}", "com.shop.S.serve"))
    ids = {r.id: r.severity for r in analyze(parse(spark, lines)).findings.collect()}
    assert ids.get("tomcat-connector-exhaustion") == "CRITICAL" and "weblogic-thread-starvation" not in ids
    lines = [s.replace("http-nio-8080-exec-", "Default Executor-thread-") for s in lines]
    ids = {r.id for r in analyze(parse(spark, lines)).findings.collect()}
    assert "liberty-executor-saturation" not in ids, "no blocked worker, no finding"


def test_rule_with_persistence_and_cpu(spark):
    rule = RuleEntry("spin", "{count} in {dump}", "CRITICAL", "r", frames=("Loop.spin",), persist_dumps=3,
                     cpu_delta="spinning", critical_threads=1)
    t = parse(spark, stuck_series())
    r = fired(t, rule).first()
    assert (r.severity, r.title, r.confidence) == ("CRITICAL", "1 in 0", "high")
    calm = RuleEntry("calm", "c", "WARNING", "r", frames=("Loop.spin",), cpu_delta="zero")
    assert fired(t, calm).count() == 0


def test_site_detector(spark):
    @detector("site-check")
    def site(ctx):
        return finding(ctx.thread.filter("name = 'mover'").select("series_id").distinct(), "site-check", "INFO", "t", "d", "r")
    try:
        t = parse(spark, stuck_series())
        ctx = Context(t.dump, derive(t.thread), *[None] * 6)
        assert [r.id for r in run_detectors(ctx, ["site-check"]).collect()] == ["site-check"]
    finally:
        del DETECTORS["site-check"]


def test_quality(spark):
    lines = dump("2024-03-01 10:00:00", [thread("a", 1)]) + dump("2024-03-01 10:02:00", [thread("a", 1)], banner="Full thread dump other")
    t = parse(spark, lines)
    codes = sorted(r.code for r in quality.quality_notes(t.dump, series.series_index(derive(t.thread)), t.parse_issue).collect())
    assert codes == ["gap", "mixed-jvms", "no-synchronizers"]


def test_fleet(spark):
    def node(name, blocked):
        ts = [thread(f"t{i}", i + 1, state="BLOCKED" if blocked else "RUNNABLE", frames=("com.shop.X.hang" if blocked else "com.shop.X.ok",))
              for i in range(6)]
        return line_table(spark, dump("2024-03-01 10:00:00", ts), series=name)
    lines = node("n1", False).unionByName(node("n2", False)).unionByName(node("n3", True))
    d = derive(stored(parse_hotspot(lines)).thread)
    got = sorted((r.node, r.kind, r.explanation) for r in fleet.outliers(d).collect())
    assert [g[:2] for g in got] == [("n3", "state-distribution"), ("n3", "state-distribution"), ("n3", "unique-stack")]
    assert got[2][2] == "node n3 diverges: 6 threads share a stack in com.shop.X.hang that no other node shows (fleet median: 0)"
    assert any("100% of threads BLOCKED (fleet median: 0%)" in g[2] for g in got)


def test_small_recurring_stacks_are_neither_new_nor_unique(spark):
    """A stack after the 15 largest of a baseline or of another node was still seen there."""
    def node(name, sizes):
        stacks = [f"com.shop.{x}.run" for x, n in sizes for _ in range(n)]
        ts = [thread(f"t{i}", i + 1, frames=(s,)) for i, s in enumerate(stacks)]
        return line_table(spark, dump("2024-03-01 10:00:00", ts), series=name)
    many = [(f"S{k}", 3) for k in range(16)] + [("Small", 2)]
    now = [*many[:16], ("Small", 6), ("Fresh", 2)]
    before = derive(stored(parse_hotspot(node("n1", many))).thread)
    d = derive(stored(parse_hotspot(node("n1", now))).thread)
    new = B.new_recurring_stacks(d, B.build(before, before.select("series_id", "dump_idx").distinct()).stack).collect()
    assert [r.stack[0].split("(")[0] for r in new] == ["com.shop.Fresh.run"]
    both = derive(stored(parse_hotspot(node("n1", now).unionByName(node("n2", many)))).thread)
    assert fleet.unique_stack_outliers(both).count() == 0


def test_marked_threads_are_all_listed(spark):
    ts = [thread(f"[STUCK] ExecuteThread: '{i}' for queue: 'q'", i + 1) for i in range(130)]
    got = findings.marked_threads(parse(spark, dump("2024-03-01 10:00:00", ts)).thread).collect()
    assert len({r.name for r in got}) == 130 and {(r.id, r.n) for r in got} == {("weblogic-stuck", 1)}


def _rule_threads(spark, n):
    import random
    rnd = random.Random(n)
    sig = lambda: "com." + "".join(rnd.choice("abÄ.") for _ in range(rnd.randrange(12)))
    rows = [("s", i % 3, i, rnd.choice(["", "a.b-1", "ab-12", "[X] ab", "worker(1)", "aab", f"ab-{i}"]), f"k{i}",
             rnd.choice(["RUNNABLE", "BLOCKED", "WAITING"]), [(x, x + "(Y)") for x in (sig() for _ in range(rnd.randrange(5)))],
             i % 17 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, dump_idx int, thread_ord int, name string, key string, state string, "
                                       "frames array<struct<sig: string, raw: string>>, is_vm boolean")


def test_rules_of_a_table_match_as_entries_do(spark):
    """Patterns with and without a literal start, escapes, quantifiers, alternatives, short, long and empty needles."""
    t = _rule_threads(spark, 150)
    patterns = [None, None, "a.b-1", r"a\.b-1", "ab-1?2", "a*b.*", "ab|a.b-1", "(?i)AB-12", r"\[X\] ab", r"worker\(\d\)", "a{2}b", "ab-\\d+", ""]
    needles = [(), (), ("a",), ("ab", "Ä"), ("com.",), ("",), ("bb.a",), ("nowhere in any frame of them",), ("b", "b"), ("com.a", "..")]
    states = [(), (), ("RUNNABLE",), ("BLOCKED", "WAITING")]
    entries = tuple(RuleEntry(f"{i}.{j}.{k}", "t", "INFO", "r", frames=f, name_regex=p, states=st)
                    for i, p in enumerate(patterns) for j, f in enumerate(needles) for k, st in enumerate(states))
    rows = lambda df: sorted((r.thread_ord, r.rule_id, r.frame or "") for r in df.collect())
    want = []
    for i in range(0, len(entries), 130):
        want += rows(R.rule_matches(t, entries[i:i + 130]))
    got = rows(R.rule_table_matches(t, kb.rule_table(spark, entries)))
    assert got == sorted(want) and len(got) > 1000
    assert R.rule_table_matches(t.limit(0), kb.rule_table(spark, entries[:9])).count() == 0
    assert R.rule_table_matches(t, kb.rule_table(spark, ())).count() == 0


def test_fifty_thousand_rules(spark):
    t = _rule_threads(spark, 60)
    many = spark.range(50_000).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("rule_id"), F.lit("t").alias("title"), F.lit("INFO").alias("severity"),
        F.lit(None).cast("int").alias("warn_threads"), F.lit(None).cast("int").alias("critical_threads"), F.lit("r").alias("recommendation"),
        F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("com.shop.Order"), F.col("id").cast("string")))).alias("frames"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("ab-"), F.col("id").cast("string"))).alias("name_regex"),
        F.array().cast("array<string>").alias("states"), F.lit(1).alias("min_threads"), F.lit(None).cast("int").alias("persist_dumps"),
        F.lit(None).cast("string").alias("cpu_delta"))
    names = [r.name for r in t.filter("NOT is_vm").collect()]
    want = sorted(f"r{n[3:]}" for n in names if n.startswith("ab-") and int(n[3:]) % 2 == 1)
    assert sorted(r.rule_id for r in R.rule_table_matches(t, many).collect()) == want and want
    open_ones = many.filter("rule_id < 'r2'").withColumn("frames", F.lit(None).cast("array<string>")).withColumn("name_regex", F.lit(".*x"))
    with pytest.raises(ValueError):
        R.rule_table_matches(t, open_ones)


def test_call_trees_against_counting_by_hand(spark):
    """Random stacks over two frames: nodes, counts, collapsed chains and ranks, without a limit."""
    import random
    from collections import Counter
    rnd = random.Random(5)
    stacks = {i: [rnd.choice("ab") for _ in range(rnd.randrange(9))] for i in range(60)}
    stacks[60] = list("xyzxyzxyz")
    rows = [("s", 0, i, f"t{i}", "RUNNABLE", [(f, f) for f in reversed(p)]) for i, p in stacks.items()]
    t = spark.createDataFrame(rows, "series_id string, dump_idx int, thread_ord int, name string, state string, "
                                    "frames array<struct<raw: string, sig: string>>")
    n = Counter("\n".join(p[:d]) for p in stacks.values() for d in range(1, min(len(p), 8) + 1))
    got = views.with_paths(views.flame_trie(t, 8), t, path="depth").collect()
    assert {r.path: r.n for r in got} == n and len(got) == len(n)
    kids = {p: [c for c in n if c.rpartition("\n")[0] == p and c != p] for p in n}
    swallowed = {c[0] for p, c in kids.items() if len(c) == 1 and n[c[0]] == n[p]}
    want = {}
    for head in n.keys() - swallowed:
        last, size = head, 1
        while len(kids[last]) == 1 and kids[last][0] in swallowed:
            last, size = kids[last][0], size + 1
        want[head] = (last, size, n[head])
    tree = views.with_paths(views.call_stack_tree(t, 8), t, head="depth", last="last_depth").collect()
    assert {r["head"]: (r["last"], r["chain"], r["n"]) for r in tree} == want
    order = sorted(tree, key=lambda r: (r["depth"], -r["n"], r["first_ord"]))
    assert [r["rank"] for r in order] == list(range(1, len(want) + 1))
    assert views.call_stack_tree(t, 8, max_nodes=3).count() == 3
    assert views.call_stack_tree(t.limit(0), 8).count() == 0


def test_history_and_baseline_files(spark, tmp_path):
    path = str(tmp_path / "h")
    a = spark.createDataFrame([("i1", "2024-03-01 10:00:00", "rel-1", '{"n":1}', "b1"), ("i2", "2024-03-02 10:00:00", "rel-2", "pool", None)],
                              "id string, t string, label string, summary string, baseline string").withColumn("ts", F.to_timestamp("t"))
    s = spark.createDataFrame([("i1", h) for h in "abcd"] + [("i2", h) for h in "xy"], "analysis_id string, hash string")
    history.record(a.filter("id = 'i1'"), s.filter("analysis_id = 'i1'"), path)
    for _ in range(2):  # a run that is recorded again is there once
        history.record(a.filter("id = 'i2'"), s.filter("analysis_id = 'i2'"), path, "run/2")
    an, st = history.read_history(spark, path)
    assert (an.count(), st.count()) == (2, 6)
    assert [x.count() for x in history.read_history(spark, path + "-none")] == [0, 0]
    q = spark.createDataFrame([("q", h) for h in "abce"], "query_id string, hash string")
    r = history.similar_incidents(an, st, q).collect()
    assert [(x.analysis_id, x.overlap) for x in r] == [("i1", 0.6)]
    assert [x.id for x in history.history_list(an).collect()] == ["i2", "i1"]
    assert [x.id for x in history.history_search(an, "POOL").collect()] == ["i2"]
    assert history.baseline_for_label(an, "rel-1").first().baseline == "b1"
    t = parse(spark, stuck_series())
    d = derive(t.thread)
    B.save(B.build(d, t.dump), str(tmp_path / "b"))
    b = B.load(spark, str(tmp_path / "b"))
    drift = release_drift(t, b)
    assert drift["new_stacks"].count() == 0 and {r.delta_points for r in drift["state_shifts"].collect()} == {0.0}
    with pytest.raises(ValueError):
        (b.header.drop("type").write.parquet(str(tmp_path / "x/header")),
         [getattr(b, p).write.parquet(str(tmp_path / f"x/{p}")) for p in ("state", "pool", "stack")])
        B.load(spark, str(tmp_path / "x"))
    export.write_results({"dump": t.dump}, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out/dump")).count() == 3


def test_redaction(spark):
    rows = [(0, "ops@app01.prod.acme.com called 10.0.0.5 and app01.prod.acme.com"),
            (1, "replica-app01.prod.acme.com at 10.0.0.5, com.acme.web.Page.render stays, 10.0.0.6"),
            (2, "nothing here"), (3, "db02.acme.io ops@app01.prod.acme.com")]
    df = spark.createDataFrame(rows, "id int, text string")
    out, mapping = redact(df, "id", "text")
    got = [r.text for r in out.orderBy("id").collect()]
    assert got == ["user-1@host-1 called ip-1 and host-1",
                   "replica-host-1 at ip-1, com.acme.web.Page.render stays, ip-2", "nothing here", "host-3 user-1@host-1"]
    assert mapping.filter("kind = 'email'").count() == 1


def test_redaction_against_sql(spark, monkeypatch):
    """Sides of hosts, hosts side by side, prefixes, null and empty texts, far ids and many chunks of numbers."""
    import random
    duckdb = pytest.importorskip("duckdb")
    from stackscope.operators import redact as module
    from stackscope.plans.catalog_sources import _REDACTED
    monkeypatch.setattr(module, "CHUNK_ROWS", 3)
    rnd = random.Random(7)
    bits = ["a.com", "b-c.net", "x-a.com", "_a.com", "@d.org", "me@a.com", "10.1.2.3", "1.2.3.4.com", "f.comx", "g.io.h", " ", ", ", "-", "",
            "\n", "(", "p.q.internal", "r_s.lan", "A.com", "t.co.uk", "u.COM", "--v.de", "me@b.c", "w.com.", "y.com/z.net", "300.1.1.1"]
    rows = [(rnd.randrange(10**12), "".join(rnd.choice(bits) + rnd.choice(["", " ", "-", "/"]) for _ in range(rnd.randrange(9))))
            for _ in range(300)] + [(5, None), (6, "")]
    rows = list({i: (i, t) for i, t in rows}.values())
    out, mapping = redact(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(r.ord for r in mapping.filter("kind = 'host'").collect()) == list(range(1, mapping.filter("kind = 'host'").count() + 1))
    assert sorted((r.doc_id, r.text) for r in out.filter("text is not null").collect()) == sorted(
        r for r in con.execute(_REDACTED).fetchall() if r[1] is not None)
    assert [r.doc_id for r in out.filter("text is null").collect()] == [5]


def test_pause_cover_against_brute_force(spark):
    import random
    rnd = random.Random(3)
    pauses = [(rnd.choice("ab"), rnd.randrange(0, 20000), rnd.randrange(1, 900)) for _ in range(60)]
    points = [(rnd.choice("ab"), i, rnd.randrange(0, 20000)) for i in range(300)]
    p = spark.createDataFrame(pauses, "series_id string, s long, d long").select(
        "series_id", F.timestamp_seconds("s").alias("start_ts"), (F.col("d") * 1000.0).alias("duration_ms"))
    q = spark.createDataFrame(points, "series_id string, id int, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id: r.covered for r in pause_covers(q, p).collect()}
    want = {i: any(s == x and a - 2 <= t <= a + d + 2 for x, a, d in pauses) for s, i, t in points}
    assert got == want


def test_options_reach_the_operators(spark):
    o = Options(stuck_k=4, pool_patterns=(("mine", r"mo(ver)"),))
    t = parse(spark, stuck_series())
    d = derive(t.thread, o)
    assert series.stuck_candidates(series.series_index(d), t.dump, o.stuck_k).count() == 0
    assert {r.pool for r in d.filter("name = 'mover'").collect()} == {"mine ver"}


def test_similar_sets_against_all_pairs(spark):
    """Prefixes of rare hashes lose no pair at any threshold, with a hash that everything shares."""
    import random

    from stackscope.operators import history
    rnd = random.Random(4)
    sets = {f"a{k}": {"common"} | {f"h{rnd.randrange(12 + 3 * (k % 5))}" for _ in range(rnd.randrange(0, 9))} for k in range(40)}
    asks = {f"q{k}": {"common", f"new{k}"} | set(rnd.sample(sorted(sets[f"a{k}"]), rnd.randrange(0, len(sets[f"a{k}"]) + 1))) for k in range(15)}
    stacks = spark.createDataFrame([(i, h) for i, s in sets.items() for h in s] * 2, "analysis_id string, hash string")
    query = spark.createDataFrame([(i, h) for i, s in asks.items() for h in s], "query_id string, hash string")
    analysis = spark.createDataFrame([(i, None, i) for i in sets], "id string, ts timestamp, label string")
    for t in (0.3, 0.5, 1.0):
        want = {(q, a, len(x & y)) for q, x in asks.items() for a, y in sets.items() if len(x & y) / len(x | y) >= t}
        got = history.similar_incidents(analysis, stacks, query, t).collect()
        assert {(r.query_id, r.analysis_id, r.shared) for r in got} == want and len(got) == len(want)


def test_a_frame_is_parsed_from_a_line_computed_once(spark):
    """Values used in several fields and conditions stand once in the plan, however the line is made."""
    df = spark.createDataFrame([(")1:avaJ.C(m.C.b.a/12@esab.avaj ta\t",), (")dohteM evitaN(nur ta",), ("nur",), (None,)], "l string")
    f = df.select(frames.parse_frame(F.reverse("l")).alias("f"))
    assert f._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    assert [r.f and tuple(r.f) for r in f.collect()] == [
        ("a.b.C.m(C.Java:1)", "a.b.C", "m", "C.Java:1", "a.b.C.m", False),
        ("run(Native Method)", "run", "", "Native Method", "run.", True), None, None]
    j9 = df.select(frames.normalize_j9_frame(F.reverse("l")).alias("f"))
    assert j9._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
