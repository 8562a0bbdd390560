import json
import re

import pytest
from dumps import dump, line_table, thread, write
from pyspark.sql import functions as F

from stackscope.sources import kb
from stackscope.knowledge import IDLE_PATTERNS, LabelEntry, RuleEntry
from stackscope.sources.gclog import parse_gc_log
from stackscope.sources.hotspot import parse_hotspot
from stackscope.sources.javacore import parse_javacore
from stackscope.sources.jsondump import parse_json_dump
from stackscope.sources.lines import read_cluster, read_lines, sniff_format
from stackscope.sources.load import load_dumps
from stackscope.sources.samples import slice_samples
from stackscope.sources.top import parse_top


def collect(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def series_text():
    a = [thread("main", 1, cpu=12.5, elapsed=3.25, daemon=True, sync=["0x00000000aa"],
                frames=("java.lang.Object.wait0", "com.shop.Main.run"),
                locks={0: ["waiting on <0x00000000e1> (a java.lang.Object)"],
                       1: ["locked <0x00000000e1> (a java.lang.Object)", "eliminated <owner is scalar replaced> (a com.shop.X)"]}),
         thread("worker", 2, state="BLOCKED (on object monitor)", nid="77",
                locks={0: ["waiting to lock <0x00000000e2> (a com.shop.L)"]}, sync=[]),
         thread("GC Thread#0", 3, state=None, frames=(), java_id=False)]
    b = [thread("main", 1, state="TIMED_WAITING (sleeping)", sync=[])]
    deadlock = ["", "Found one Java-level deadlock:", "=============================", '"A":',
                "  waiting to lock monitor 0x1 (object 0x2, a X),", '  which is held by "B"', '"B":',
                "  waiting to lock monitor 0x3,", '  which is held by "A"', "",
                "Java stack information for the threads listed above:", '"A":', "\tat com.shop.A.a(A.java:1)",
                "", "Found 1 deadlock.", ""]
    log = ["2024-03-01 10:00:09 INFO still alive", "java.lang.IllegalStateException: no", "\tat com.shop.Log.e(L.java:1)", ""]
    return (["some log line", ""] + dump("2024-03-01 10:00:00", a, tail=deadlock + ["JNI global refs: 3", ""]) + log
            + dump("2024-03-01 10:00:20.123", b) + ["2024-03-01 10:00:40", "trailing noise"])


def everything(t):
    return {
        "dump": collect(t.dump, *t.dump.columns),
        "thread": collect(t.thread.drop("thread_ord").withColumn("frames", F.to_json("frames")).withColumn(
            "locks", F.to_json("locks")), *[c for c in t.thread.columns if c != "thread_ord"]),
        "cycle": collect(t.jvm_cycle, "dump_idx", "pos", "thread_name"),
        "issue": collect(t.parse_issue, "dump_idx", "message"),
    }


def test_hotspot_fields(spark):
    t = parse_hotspot(line_table(spark, series_text()))
    d = t.dump.orderBy("dump_idx").collect()
    assert [str(r.ts) for r in d] == ["2024-03-01 10:00:00", "2024-03-01 10:00:20"]
    assert [r.source_name for r in d] == ["f.log#1", "f.log#2"]
    rows = {(r.dump_idx, r.name): r for r in t.thread.collect()}
    m = rows[(0, "main")]
    assert (m.java_id, m.daemon, m.prio, m.cpu_ms, m.elapsed_s) == (1, True, 5, 12.5, 3.25)
    assert (m.nid_hex, m.nid_dec, m.header_cond) == ("0x65", 101, "waiting on condition")
    assert [(f.sig, f.native) for f in m.frames] == [("java.lang.Object.wait0", True), ("com.shop.Main.run", False)]
    assert [(x.kind, x.address, x.frame_idx) for x in m.locks] == [
        ("WAITING_ON", "0x00000000e1", 0), ("LOCKED_MONITOR", "0x00000000e1", 1), ("ELIMINATED", None, 1),
        ("LOCKED_SYNCHRONIZER", "0x00000000aa", -1)]
    assert rows[(0, "worker")].state == "BLOCKED" and rows[(0, "worker")].nid_dec == 77
    assert rows[(0, "GC Thread#0")].java_id is None and rows[(0, "GC Thread#0")].frames == []
    # the exception logged after the dump belongs to no thread
    assert len(rows[(0, "worker")].frames) == 1
    assert [r.thread_name for r in t.jvm_cycle.orderBy("pos").collect()] == ["A", "B"]


@pytest.mark.parametrize("chunk_rows", [1, 2, 3, 7])
def test_chunks_do_not_change_the_result(spark, chunk_rows):
    """Cutting the file anywhere gives what one piece gives."""
    text = series_text()
    assert everything(parse_hotspot(line_table(spark, text, chunk_rows=chunk_rows))) == \
        everything(parse_hotspot(line_table(spark, text)))


def test_double_spacing_does_not_change_the_threads(spark):
    text = series_text()
    spaced = [x for s in text for x in (s, "")]
    a, b = (everything(parse_hotspot(line_table(spark, x))) for x in (text, spaced))
    assert a["thread"] == b["thread"] and a["dump"] == b["dump"] and a["cycle"] == b["cycle"]


def test_dump_without_banner_and_time(spark):
    body = dump(None, [thread("main", 1)], banner=None) + dump("2024-03-01 10:00:20", [thread("main", 1)])
    t = parse_hotspot(line_table(spark, ["2024-03-01 10:00:00"] + body))
    d = t.dump.orderBy("dump_idx").collect()
    assert [(r.source_name, str(r.ts)) for r in d] == [("f.log#1", "2024-03-01 10:00:00"), ("f.log#2", "2024-03-01 10:00:20")]
    # a time line used up by the implicit dump is not the next dump's time
    t = parse_hotspot(line_table(spark, ["2024-03-01 10:00:00"] + dump(None, [thread("a", 1)], banner=None)
                                 + dump(None, [thread("a", 1)])))
    assert sorted(str(r.ts) for r in t.dump.collect()) == ["2024-03-01 10:00:00", "None"]


def test_interleaved_noise_and_issue_text(spark):
    lines = dump("2024-03-01 10:00:00", [thread("main", 1, frames=("a.B.c", "a.B.d"))])
    at = next(i for i, s in enumerate(lines) if "a.B.d" in s)
    lines.insert(at, "INFO noise in between")
    t = parse_hotspot(line_table(spark, lines))
    assert t.thread.select(F.size("frames")).first()[0] == 2
    assert t.parse_issue.first().message == '1 line(s) of a dump fit no known form, the first being ("INFO noise in between")'


def test_files_formats_and_order(spark, tmp_path):
    late = write(tmp_path, "a.txt", dump("2024-03-01 10:05:00", [thread("main", 1)]))
    early = write(tmp_path, "b.txt", dump("2024-03-01 10:01:00", [thread("main", 1)]))
    core = write(tmp_path, "c.txt", javacore())
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps(json_doc()))
    kinds = {r.file.rsplit("/", 1)[1]: r.format for r in sniff_format(read_lines(spark, [late, core, str(doc)])).collect()}
    assert kinds == {"a.txt": "hotspot", "c.txt": "javacore", "d.json": "json"}
    t = load_dumps(spark, [late, early, core, str(doc)])
    got = [(r.source_name, r.reordered) for r in t.dump.orderBy("dump_idx").collect()]
    assert got == [("b.txt#1", True), ("a.txt#1", True), ("c.txt", True), ("d.json", True)]
    nodes = read_cluster(spark, {"n1": late, "n2": early})
    assert {r.series_id for r in nodes.select("series_id").distinct().collect()} == {"n1", "n2"}


def test_split_files_keep_their_line_order(spark, tmp_path):
    """A file read in many splits parses as in one."""
    lines = []
    for k in range(4):
        lines += dump(f"2024-03-01 10:0{k}:00", [thread(f"t{i}", i + 1, cpu=1.0, sync=[]) for i in range(25)])
    p = write(tmp_path, "big.log", lines)
    whole = everything(parse_hotspot(read_lines(spark, p)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        cut = read_lines(spark, p)
        assert cut.select("chunk").distinct().count() > 5
        assert everything(parse_hotspot(cut)) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def javacore():
    return [
        "0SECTION       TITLE subcomponent dump routine", "NULL           ===============",
        '1TISIGINFO     Dump Event "systhrow" (00040000) Detail "java/lang/OutOfMemoryError" received',
        "1TIDATETIME    Date: 2024/03/01 at 11:00:00:500", "1TIDATETIMEUTC Date: 2024/03/01 at 10:30:00:500 (UTC)",
        "1LKMONPOOLDUMP Monitor Pool Dump (flat & inflated object-monitors):",
        '3LKMONOBJECT       com/shop/Cache@0x00000000E0: owner "W : 1" (0x12), entry count 1',
        "3LKWAITERQ            Waiting to enter:", '3LKWAITER                "W : 2" (0x13)', '3LKWAITNOTIFY            "W : 3" (0x14)',
        "1LKDEADLOCK    Deadlock detected !!!", '2LKDEADLOCKTHR  Thread "W : 1" (0x1)', '2LKDEADLOCKTHR  Thread "W : 2" (0x2)',
        '2LKDEADLOCKTHR  Thread "W : 1" (0x1)', "2XMFULLTHDDUMP Full thread dump J9 VM (2.9)", "1XMTHDINFO     Thread Details",
        '3XMTHREADINFO      "W : 1" J9VMThread:0x0000A1, omrthread_t:0x1, java/lang/Thread:0x2, state:R, prio=5',
        "3XMJAVALTHREAD            (java/lang/Thread getId:0x1F, isDaemon:true)",
        "3XMTHREADINFO1            (native thread ID:0x3039, native priority:0x5)",
        "3XMCPUTIME               CPU usage total: 1.500000000 secs, user: 1.0 secs", "3XMTHREADINFO3           Java callstack:",
        "4XESTACKTRACE                at com/shop/Cache.load(Cache.java:7(Compiled Code))",
        "5XESTACKTRACE                   (entered lock: com/shop/Cache@0x00000000E0, entry count: 1)",
        '3XMTHREADINFO      "W : 2" J9VMThread:0x0000A2, java/lang/Thread:0x2, state:B, prio=5',
        '3XMTHREADBLOCK     Blocked on: com/shop/Cache@0x00000000E0 Owned by: "W : 1" (J9VMThread:0x1)',
        "3XMTHREADINFO3           Java callstack:", "4XESTACKTRACE                at com/shop/Cache.get(Cache.java:3)",
        '3XMTHREADINFO      "W : 3" J9VMThread:0x0000A3, java/lang/Thread:0x2, state:CW, prio=5',
        "3XMTHREADINFO3           Java callstack:", "4XESTACKTRACE                at java/lang/Object.wait(Native Method)",
        "3XMTHREADINFO      Anonymous native thread", "garbage line"]


@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_javacore(spark, chunk_rows):
    t = parse_javacore(line_table(spark, javacore(), chunk_rows=chunk_rows))
    d = t.dump.first()
    assert str(d.ts) == "2024-03-01 10:30:00.500000" and d.saw_sync and "OutOfMemoryError" in d.dump_reason
    assert d.banner == "Full thread dump J9 VM (2.9)"
    rows = {r.name: r for r in t.thread.collect()}
    assert set(rows) == {"W : 1", "W : 2", "W : 3"}
    a, b, c = (rows[f"W : {i}"] for i in (1, 2, 3))
    assert (a.java_id, a.daemon, a.nid_dec, a.cpu_ms, a.state, a.tid_hex) == (31, True, 12345, 1500.0, "RUNNABLE", "0x0000a1")
    assert a.frames[0].raw == "com.shop.Cache.load(Cache.java:7)"
    assert [(x.kind, x.address, x.cls, x.frame_idx) for x in a.locks] == [("LOCKED_MONITOR", "0x00000000e0", "com.shop.Cache", 0)]
    assert b.state == "BLOCKED" and [x.kind for x in b.locks] == ["WAITING_TO_LOCK"]
    assert [(x.kind, x.cls) for x in c.locks] == [("WAITING_ON", "com.shop.Cache")]
    assert [r.thread_name for r in t.jvm_cycle.orderBy("pos").collect()] == ["W : 1", "W : 2"]
    assert len(t.parse_issue.collect()) == 2


def json_doc():
    return {"threadDump": {"processId": "9", "time": "2024-03-01T10:30:01.5Z", "runtimeVersion": "21", "threadContainers": [
        {"container": "root", "threads": [
            {"tid": "24", "name": "carrier-1", "stack": ["java.base/jdk.internal.vm.Continuation.run(C.java:1)"]},
            {"tid": "31", "name": "", "virtual": True, "carrier": "24", "state": "RUNNABLE",
             "stack": ["java.base/java.lang.VirtualThread.park(V.java:1)", "com.shop.H.handle(H.java:2)"] * 40}]}]}}


def test_json_dump(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps(json_doc()))
    t = parse_json_dump(spark, str(p))
    rows = {r.name: r for r in t.thread.collect()}
    v = rows["virtual-31"]
    assert (v.is_virtual, v.java_id, v.carrier_tid, v.state, len(v.frames)) == (True, 31, "24", "RUNNABLE", 80)
    assert v.frames[0].sig == "java.lang.VirtualThread.park" and v.tid_hex is None
    assert rows["carrier-1"].state == "UNKNOWN" and rows["carrier-1"].state_detail == "root"


def test_gc_log(spark):
    lines = [
        "[2024-03-01T10:00:00.100+0000][info][gc] GC(1) Pause Young (Normal) (G1 Evacuation Pause) 512M->12M(1024M) 12.5ms",
        "[2024-03-01T10:00:01.100+0000][info][gc] GC(2) Pause Full (System.gc()) 1M->1M(8M) 6250.0ms",
        '[2024-03-01T10:00:02.100+0000][info][safepoint] Safepoint "Cleanup", Time since last: 1 ns, At safepoint: 5 ns, Total: 1500000 ns',
        "[2024-03-01T10:00:03.100+0000][info][gc] GC(3) Concurrent Mark Cycle 5.0ms",
        "2024-03-01T10:00:04.100+0000: 1.5: [Full GC (Ergonomics) 1K->1K(2K), 4.5 secs] [Times: user=1]",
        "2024-03-01T10:00:05.100+0000: 2.5: Total time for which application threads were stopped: 0.25 seconds, x",
        "noise", "2024-13-01T10:00:05.100+0000: 2.5: [GC (x) a, 0.1 secs]"]
    got = [(r.duration_ms, r.cause, r.kind) for r in parse_gc_log(line_table(spark, lines)).orderBy("start_ts").collect()]
    assert got == [(12.5, "G1 Evacuation Pause", "gc"), (6250.0, "System.gc()", "gc"), (1.5, "Cleanup", "safepoint"),
                   (4500.0, "Ergonomics", "gc"), (250.0, "threads stopped", "safepoint")]


def test_top(spark):
    lines = ["top - 10:00", "  PID USER  %CPU %MEM COMMAND", "  12 app  97,5 1.5 java x", "MiB Mem: 12", "  13 app 2.0",
             "%CPU PID", "50.5 14"]
    got = [(r.pid, r.cpu_pct, r.mem_pct, r.command) for r in parse_top(line_table(spark, lines, chunk_rows=2)).orderBy("pid").collect()]
    assert got == [(12, 97.5, 1.5, "java x"), (13, 2.0, 0.0, ""), (14, 50.5, 0.0, "")]


def test_slices_widen(spark):
    rows = [("s", i, 7, "t", 50, [f"a.B.m{i}(X.java:1)"]) for i in range(0, 40)]
    df = spark.createDataFrame(rows, "series_id string, sec bigint, thread_id bigint, thread_name string, os_tid bigint, frames array<string>") \
        .withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    t = slice_samples(df, slice_ms=1000, max_slices=10)
    d = t.dump.orderBy("dump_idx").collect()
    assert len(d) == 10 and "4000 ms" in d[0].banner
    assert [r.frames[0].method for r in t.thread.orderBy("dump_idx").collect()] == [f"m{i}" for i in range(3, 40, 4)]


def test_slices_widen_as_far_as_needed_and_keep_deep_stacks(spark):
    rows = [("far", i * 3 * 10**7, 7, "t", 50, [f"a.B.m{k}(X.java:1)" for k in range(90)]) for i in range(10)]
    rows += [("near", i, 7, "t", 50, ["a.B.m(X.java:1)"]) for i in range(3)]
    df = spark.createDataFrame(rows, "series_id string, sec bigint, thread_id bigint, thread_name string, os_tid bigint, frames array<string>") \
        .withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    t = slice_samples(df, slice_ms=100, max_slices=3)
    width = {r.series_id: int(re.search(r"(\d+) ms", r.banner).group(1)) for r in t.dump.collect()}
    assert width["near"] == 100
    slices = lambda w: len({i * 3 * 10**10 // w for i in range(10)})
    assert slices(width["far"]) <= 3 < slices(width["far"] // 2)
    assert t.dump.filter("series_id = 'far'").count() == slices(width["far"])
    assert {len(r.frames) for r in t.thread.filter("series_id = 'far'").collect()} == {90}


def test_knowledge_merge_and_rule_checks(spark):
    mine = (LabelEntry("socket-accept", "mine", ("x",)), LabelEntry("new", "n", ("y",)))
    merged = kb.idle_patterns(mine)
    assert [e.name for e in merged[:2]] == ["socket-accept", "new"] and len(merged) == len(IDLE_PATTERNS) + 1
    over = RuleEntry("classloader-contention", "t", "INFO", "r", frames=("z",))
    rules = kb.rules((over, RuleEntry("own", "t", "INFO", "r", frames=("z",))))
    assert rules[2] is over and rules[-1].rule_id == "own"
    table = kb.rule_table(spark, rules)
    assert kb.validate_rules(table).count() == 0
    assert kb.rules_from_table(table)[2].frames == ("z",)


def _planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_javacore_threads_are_grouped_once(spark):
    """The threads that the LOCKS section is merged into are read from files: only its own locks are gathered in the plan."""
    t = parse_javacore(line_table(spark, javacore()))
    assert _planned(t.thread).count("collect_list(") <= 1
    frames = {r["name"]: [f["raw"] for f in r["frames"]] for r in t.thread.collect()}
    assert frames["W : 1"] == ["com.shop.Cache.load(Cache.java:7)"] and frames["W : 3"] == ["java.lang.Object.wait(Native Method)"]


def test_hotspot_frames_are_gathered_as_text(spark):
    """Fields of a frame are read after the lines of a thread are grouped, so the shuffle carries each frame once."""
    t = parse_hotspot(line_table(spark, series_text()))
    plan = _planned(t.thread.select("name", "frames"))
    assert "Native Method" in plan and "Native Method" not in plan[plan.index("Aggregate"):]
    frames = {(r["name"], r["dump_idx"]): [tuple(f) for f in r["frames"]] for r in t.thread.collect()}
    assert frames["main", 0] == [
        ("java.lang.Object.wait0(Native Method)", "java.lang.Object", "wait0", "Native Method", "java.lang.Object.wait0", True),
        ("com.shop.Main.run(X.java:1)", "com.shop.Main", "run", "X.java:1", "com.shop.Main.run", False)]
