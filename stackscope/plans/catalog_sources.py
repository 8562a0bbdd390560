"""Queries that print tables as raw text, read it back and compare with the tables."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stackscope.functions.frames import parse_frame
from stackscope.knowledge import HOST_SUFFIXES
from stackscope.operators import history as H
from stackscope.operators import samples as SM
from stackscope.operators import series as S
from stackscope.operators.derive import derive
from stackscope.operators.redact import redact
from stackscope.plans.catalog_series import RUNS
from stackscope.plans.registry import flat, query
from stackscope.plans.snapshots import dump_text, event_tables, read
from stackscope.plans.sqlbase import snap
from stackscope.session import shared_dir, store
from stackscope.sources import kb
from stackscope.sources.gclog import parse_gc_log
from stackscope.sources.hotspot import parse_hotspot, segment_lines
from stackscope.sources.javacore import parse_javacore
from stackscope.sources.jsondump import DOCUMENT, json_tables
from stackscope.sources.lines import sniff_format
from stackscope.sources.load import load_cluster, load_dumps
from stackscope.sources.samples import slice_samples
from stackscope.sources.tables import Tables, index_dumps
from stackscope.sources.top import parse_top
from stackscope.streaming.trigger import threshold_trigger

ROWS_PER_CHUNK = 4096


def parsed(spark, sf):
    """The snapshot printed to stored text lines and parsed back."""
    return parse_hotspot(store(dump_text(event_tables(spark, sf))))


def stored(t: Tables) -> Tables:
    """The thread and dump tables kept as files, for queries that read them repeatedly."""
    return Tables(store(t.dump), store(t.thread), t.jvm_cycle, t.parse_issue)


@query("stuck_runs_from_text", snap(body="," + RUNS + """
SELECT key, norm AS name, from_dump, to_dump, run_length, state AS states, h AS fp, cpu_delta AS cpu_delta_ms, wall_s,
  CAST(et = 'click' AS BIGINT) AS top_native, r0 AS top_frame
FROM cand JOIN (SELECT DISTINCT h, r0 FROM snap) USING (h)"""))
def _(spark, sf):
    t = stored(parsed(spark, sf))
    c = S.stuck_candidates(S.series_index(derive(t.thread)), t.dump)
    return flat(c, "key", "name", "from_dump", "to_dump", "run_length", "fp", "cpu_delta_ms", "wall_s", "top_native",
                states=F.array_join("states", ","), top_frame=F.get("frozen_frames", F.lit(0)))


@query("parsed_dumps", snap(body="""
SELECT dump_idx, epoch_ms(CAST(day AS TIMESTAMP)) AS ts_ms, 'Full thread dump of all' AS banner,
  'events.log#' || CAST(dump_idx + 1 AS VARCHAR) AS source_name, 0 AS reordered FROM days"""))
def _(spark, sf):
    return flat(parsed(spark, sf).dump, "dump_idx", "banner", "source_name", "reordered", ts_ms=F.unix_millis("ts"))


@query("parsed_threads", snap(body="""
SELECT dump_idx, name, u AS java_id, CAST(u % 2 = 0 AS BIGINT) AS daemon, u % 3 + 4 AS prio, 0 AS os_prio, CAST(cpu AS DOUBLE) AS cpu_ms,
  elapsed AS elapsed_s, '0x' || lower(hex(u + 4096)) AS tid_hex, '0x' || lower(hex(u + 1)) AS nid_hex, u + 1 AS nid_dec,
  state, 'waiting on condition' AS header_cond, 3 AS frames,
  CASE WHEN et = 'view' OR (et = 'error' AND u % 5 = 0) THEN 2 WHEN et IN ('error', 'purchase') THEN 1 ELSE 0 END AS locks FROM snap"""))
def _(spark, sf):
    return flat(parsed(spark, sf).thread, "dump_idx", "name", "java_id", "daemon", "prio", "os_prio", "cpu_ms", "elapsed_s", "tid_hex",
                "nid_hex", "nid_dec", "state", "header_cond", frames=F.size("frames"), locks=F.size("locks"))


@query("parsed_frames", snap(body="""
SELECT dump_idx, name, 0 AS pos, r0 AS raw, f0 AS sig, CAST(et = 'click' AS BIGINT) AS native FROM snap
UNION ALL SELECT dump_idx, name, 1, r1, f1, 0 FROM snap UNION ALL SELECT dump_idx, name, 2, r2, f2, 0 FROM snap"""))
def _(spark, sf):
    f = parsed(spark, sf).thread.select("dump_idx", "name", F.posexplode("frames").alias("pos", "f"))
    return flat(f, "dump_idx", "name", "pos", raw=F.col("f.raw"), sig=F.col("f.sig"), native=F.col("f.native"))


@query("parsed_locks", snap(body="""
SELECT dump_idx, name, 'WAITING_TO_LOCK' AS kind, '0x00000000e000000' || CAST(u % 8 AS VARCHAR) AS address, 'com.shop.Ledger' || CAST(u % 8 AS VARCHAR) AS cls, 0 AS frame_idx FROM snap WHERE et = 'error'
UNION ALL SELECT dump_idx, name, 'LOCKED_MONITOR', '0x00000000e000000' || CAST((u + 3) % 8 AS VARCHAR), 'com.shop.Ledger' || CAST((u + 3) % 8 AS VARCHAR), 1 FROM snap WHERE et = 'error' AND u % 5 = 0
UNION ALL SELECT dump_idx, name, 'LOCKED_MONITOR', '0x00000000e000000' || CAST(u % 8 AS VARCHAR), 'com.shop.Ledger' || CAST(u % 8 AS VARCHAR), 0 FROM snap WHERE et = 'purchase'
UNION ALL SELECT dump_idx, name, 'WAITING_ON', '0x00000000f' || lpad(CAST(u AS VARCHAR), 7, '0'), 'java.lang.Object', 0 FROM snap WHERE et = 'view'
UNION ALL SELECT dump_idx, name, 'LOCKED_MONITOR', '0x00000000f' || lpad(CAST(u AS VARCHAR), 7, '0'), 'java.lang.Object', 1 FROM snap WHERE et = 'view'"""))
def _(spark, sf):
    f = parsed(spark, sf).thread.select("dump_idx", "name", F.explode("locks").alias("l"))
    return flat(f, "dump_idx", "name", kind=F.col("l.kind"), address=F.col("l.address"), cls=F.col("l.cls"), frame_idx=F.col("l.frame_idx"))


@query("segmented_lines", snap(body="""
, x AS (SELECT dump_idx, CASE WHEN et IN ('view') OR (et = 'error' AND u % 5 = 0) THEN 2 WHEN et IN ('error', 'purchase') THEN 1 ELSE 0 END AS l FROM snap)
SELECT dump_idx + 1 AS dump_no, 'header' AS code, count(*) AS n FROM x GROUP BY dump_idx
UNION ALL SELECT dump_idx + 1, 'state', count(*) FROM x GROUP BY dump_idx
UNION ALL SELECT dump_idx + 1, 'frame', 3 * count(*) FROM x GROUP BY dump_idx
UNION ALL SELECT dump_idx + 1, 'lock', CAST(sum(l) AS BIGINT) FROM x GROUP BY dump_idx HAVING sum(l) > 0
UNION ALL SELECT dump_idx + 1, 'blank', count(*) + 1 FROM x GROUP BY dump_idx
UNION ALL SELECT dump_idx + 1, 'banner', 1 FROM days
UNION ALL SELECT dump_idx, 'time', 1 FROM days WHERE dump_idx > 0"""))
def _(spark, sf):
    seg = segment_lines(store(dump_text(event_tables(spark, sf))))
    return flat(seg.groupBy("dump_no", "code").agg(F.count("*").alias("n")), "dump_no", "code", "n")


def printed(spark, sf, by_node=False):
    """The snapshot as text files in the shared folder, one for every day (and node)."""
    path = f"{shared_dir(spark)}/printed-{uuid.uuid4().hex}"
    text = dump_text(event_tables(spark, sf, by_node)).select("series_id", F.shiftright("pos", 40).alias("day"), "pos", "line")
    text.repartition("series_id", "day").sortWithinPartitions("series_id", "day", "pos").drop("pos") \
        .write.partitionBy("series_id", "day").text(path)
    return path


@query("loaded_threads", snap(body="""
SELECT dump_idx, name, u AS java_id, CAST(cpu AS DOUBLE) AS cpu_ms, state, 3 AS frames, r0 AS top_frame,
  CASE WHEN et = 'view' OR (et = 'error' AND u % 5 = 0) THEN 2 WHEN et IN ('error', 'purchase') THEN 1 ELSE 0 END AS locks FROM snap"""))
def _(spark, sf):
    """Files read by path, told apart by content, parsed and ordered."""
    t = load_dumps(spark, f"{printed(spark, sf)}/series_id=all").thread
    return flat(t, "dump_idx", "name", "java_id", "cpu_ms", "state", frames=F.size("frames"), top_frame=F.get("frames", F.lit(0))["raw"],
                locks=F.size("locks"))


@query("loaded_dumps", snap(body="""
SELECT dump_idx, epoch_ms(CAST(day AS TIMESTAMP)) AS ts_ms, 'Full thread dump of all' AS banner, 'cluster' AS series_id FROM days"""))
def _(spark, sf):
    d = load_dumps(spark, f"{printed(spark, sf)}/series_id=all", series_id="cluster").dump
    return flat(d, "dump_idx", "banner", "series_id", ts_ms=F.unix_millis("ts"))


@query("cluster_threads", snap(by_node=True, body="""
SELECT CASE series_id WHEN 'n3' THEN 'third' ELSE series_id END AS series_id, dump_idx, name, state, elapsed AS elapsed_s FROM snap"""))
def _(spark, sf):
    """Ten nodes in one read, each named by a glob of its own."""
    path = printed(spark, sf, True)
    nodes = {("third" if k == 3 else f"n{k}"): f"{path}/series_id=n{k}/day=*" for k in range(10)}
    return flat(load_cluster(spark, nodes).thread, "series_id", "dump_idx", "name", "state", "elapsed_s")


def document_lines(spark, sf):
    """Documents as files, every fourth one with a tagged first line, every other fourth a JSON one."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("0SECTION TITLE\n"), "text")).when(
        k == 1, F.concat(F.lit('\n  {"threadDump": 1}\n'), "text")).otherwise(F.col("text"))
    return read(spark, sf, "documents").select(
        F.lit("all").alias("series_id"), F.col("doc_id").cast("string").alias("file"), F.lit(0).cast("bigint").alias("chunk"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"))


@query("sniff_format", """
SELECT CAST(doc_id AS VARCHAR) AS file, CASE doc_id % 4 WHEN 0 THEN 'javacore' WHEN 1 THEN 'json' ELSE 'hotspot' END AS format FROM documents""")
def _(spark, sf):
    return flat(sniff_format(document_lines(spark, sf)), "file", "format")


def javacore_text(spark, sf):
    """The event snapshot printed as javacores, one file per day."""
    t = event_tables(spark, sf)
    d = t.dump.select("series_id", "dump_idx", "ts")
    day = F.concat(F.lit("core-"), F.lpad(F.col("dump_idx").cast("string"), 4, "0"))
    head = d.select("series_id", day.alias("file"), F.posexplode(F.array(
        F.lit("0SECTION       TITLE subcomponent dump routine"), F.lit("NULL           ==============="),
        F.lit('1TISIGINFO     Dump Event "user" (00004000) received'),
        F.concat(F.lit("1TIDATETIME    Date: "), F.date_format("ts", "yyyy/MM/dd 'at' HH:mm:ss"), F.lit(":250")),
        F.lit("2XMFULLTHDDUMP Full thread dump J9 VM"), F.lit("1XMTHDINFO     Thread Details"))).alias("pos", "line"))
    n = F.col("thread_ord").cast("string")
    letter = (F.when(F.col("state") == "RUNNABLE", "R").when(F.col("state") == "BLOCKED", "B").otherwise("CW"))
    frames = F.transform("frames", lambda f: F.concat(
        F.lit("4XESTACKTRACE                at "), F.translate(f["cls"], ".", "/"), F.lit("."), f["method"], F.lit("("), f["loc"],
        F.when(f["native"], ")").otherwise("(Compiled Code))")))
    wait = F.get(F.filter("locks", lambda l: l["kind"] == "WAITING_TO_LOCK"), F.lit(0))
    held = F.filter("locks", lambda l: l["kind"] == "LOCKED_MONITOR")
    lines = F.array_compact(F.concat(
        F.array(F.concat(F.lit('3XMTHREADINFO      "'), F.col("name"), F.lit('" J9VMThread:'), F.col("tid_hex"),
                         F.lit(", omrthread_t:0x1, java/lang/Thread:0x2, state:"), letter, F.lit(", prio="), F.col("prio").cast("string")),
                F.concat(F.lit("3XMJAVALTHREAD            (java/lang/Thread getId:0x"), F.hex("java_id"), F.lit(", isDaemon:"),
                         F.col("daemon").cast("string"), F.lit(")")),
                F.concat(F.lit("3XMTHREADINFO1            (native thread ID:"), F.col("nid_hex"), F.lit(", native priority:0x5)")),
                F.concat(F.lit("3XMCPUTIME               CPU usage total: "), (F.col("cpu_ms") / 1000).cast("decimal(20,3)").cast("string"), F.lit(" secs")),
                F.when(wait.isNotNull(), F.concat(F.lit("3XMTHREADBLOCK     Blocked on: "), F.translate(wait["cls"], ".", "/"), F.lit("@"),
                                                  wait["address"], F.lit(" Owned by: <unknown>"))),
                F.lit("3XMTHREADINFO3           Java callstack:")),
        frames,
        F.transform(held, lambda l: F.concat(F.lit("5XESTACKTRACE                   (entered lock: "), F.translate(l["cls"], ".", "/"), F.lit("@"),
                                             l["address"], F.lit(", entry count: 1)")))))
    body = t.thread.select("series_id", day.alias("file"), ((F.col("thread_ord") + 1) * 64).alias("_p"), F.posexplode(lines).alias("i", "line")) \
        .select("series_id", "file", (F.col("_p") + F.col("i")).alias("pos"), "line")
    return head.unionByName(body).withColumn("source_name", F.col("file")) \
        .withColumn("chunk", F.shiftright("pos", 12)).filter("line IS NOT NULL")


@query("parsed_javacore_threads", snap(body="""
SELECT dump_idx, name, u AS java_id, CAST(u % 2 = 0 AS BIGINT) AS daemon, u % 3 + 4 AS prio, CAST(cpu AS DOUBLE) AS cpu_ms,
  '0x' || lower(hex(u + 4096)) AS tid_hex, u + 1 AS nid_dec, CASE state WHEN 'TIMED_WAITING' THEN 'WAITING' ELSE state END AS state,
  r0 || ' < ' || r1 || ' < ' || r2 AS stack,
  CASE WHEN et = 'error' AND u % 5 = 0 THEN 'WAITING_TO_LOCK,LOCKED_MONITOR' WHEN et = 'error' THEN 'WAITING_TO_LOCK'
    WHEN et IN ('purchase', 'view') THEN 'LOCKED_MONITOR' ELSE '' END AS locks FROM snap"""))
def _(spark, sf):
    t = parse_javacore(store(javacore_text(spark, sf))).thread
    return flat(t, "dump_idx", "name", "java_id", "daemon", "prio", "tid_hex", "nid_dec", "state", cpu_ms=F.round("cpu_ms"),
                stack=F.array_join(F.transform("frames", lambda f: f["raw"]), " < "),
                locks=F.array_join(F.transform("locks", lambda l: l["kind"]), ","))


@query("parsed_javacore_dumps", snap(body="""
SELECT dump_idx, epoch_ms(CAST(day AS TIMESTAMP)) + 250 AS ts_ms, 'Full thread dump J9 VM' AS banner, 'Dump Event "user" (00004000) received' AS dump_reason FROM days"""))
def _(spark, sf):
    return flat(parse_javacore(store(javacore_text(spark, sf))).dump, "dump_idx", "banner", "dump_reason", ts_ms=F.unix_millis("ts"))


@query("parsed_json_threads", """
SELECT row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS dump_idx, 'n' || CAST(user_id % 10 AS VARCHAR) AS series_id,
  CASE WHEN event_type = 'view' THEN 'virtual-' || CAST(user_id AS VARCHAR) ELSE event_type || '-' || CAST(user_id AS VARCHAR) END AS name, user_id AS java_id,
  CASE event_type WHEN 'click' THEN 'RUNNABLE' WHEN 'error' THEN 'BLOCKED' ELSE 'UNKNOWN' END AS state, CAST(event_type = 'view' AS BIGINT) AS is_virtual,
  'com.shop.Job' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || '.run' AS sig FROM events""")
def _(spark, sf):
    e = F.col("event_type")
    k = F.from_json("props", "k bigint")["k"].cast("string")
    doc = F.concat(
        F.lit('{"threadDump": {"processId": 7, "time": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z", "runtimeVersion": "21", "threadContainers": [{"container": "pool", "threads": [{"tid": "'),
        F.col("user_id").cast("string"), F.lit('", "name": "'), F.when(e == "view", "").otherwise(F.concat(e, F.lit("-"), F.col("user_id").cast("string"))),
        F.lit('", '), F.when(e == "click", '"state": "RUNNABLE", ').when(e == "error", '"state": "BLOCKED", ').otherwise(""),
        F.lit('"stack": ["java.base/com.shop.Job'), k, F.lit('.run(Job.java:1)"]}]}]}}'))
    docs = read(spark, sf, "events").select(
        F.concat(F.lit("n"), (F.col("user_id") % 10).cast("string")).alias("series_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("file"),
        F.lit(1).cast("bigint").alias("dump_no"), F.col("event_id").cast("string").alias("source_name"), F.from_json(doc, DOCUMENT)["threadDump"].alias("threadDump"))
    t = index_dumps(json_tables(docs)).thread
    return flat(t, "series_id", "dump_idx", "name", "java_id", "state", "is_virtual", sig=F.get("frames", F.lit(0))["sig"])


@query("parse_gc_log", """
WITH e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, epoch_ms(ts) AS ms FROM events)
SELECT 'n' || CAST(user_id % 10 AS VARCHAR) AS series_id, epoch_us(ts) // 1000 AS start_ms,
  CASE event_type WHEN 'click' THEN cents / 100.0 WHEN 'error' THEN cents / 100.0 WHEN 'purchase' THEN cents * 10.0 ELSE cents * 10.0 END AS duration_ms,
  CASE event_type WHEN 'click' THEN 'G1 Evacuation Pause' WHEN 'error' THEN 'Op' || CAST(user_id % 3 AS VARCHAR) WHEN 'purchase' THEN 'Allocation Failure' ELSE 'threads stopped' END AS cause,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'gc' ELSE 'safepoint' END AS kind
FROM e WHERE event_type IN ('click', 'error', 'purchase', 'view')""")
def _(spark, sf):
    e, n = F.col("event_type"), F.col("event_id").cast("string")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0000"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    secs = (cents.cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    line = (F.when(e == "click", F.concat(F.lit("["), iso, F.lit("][info][gc] GC("), n, F.lit(") Pause Young (Normal) (G1 Evacuation Pause) 512M->128M(1024M) "), secs, F.lit("ms")))
            .when(e == "error", F.concat(F.lit("["), iso, F.lit('][info][safepoint] Safepoint "Op'), (F.col("user_id") % 3).cast("string"), F.lit('", Time since last: 5 ns, Total: '),
                                         (cents * 10000).cast("string"), F.lit(" ns")))
            .when(e == "purchase", F.concat(iso, F.lit(": 12.345: [GC (Allocation Failure) 5K->1K(9K), "), secs, F.lit(" secs] [Times: user=0.01]")))
            .when(e == "view", F.concat(iso, F.lit(": 12.345: Total time for which application threads were stopped: "), secs, F.lit(" seconds")))
            .otherwise(F.concat(F.lit("plain line "), n)))
    lines = read(spark, sf, "events").select(F.concat(F.lit("n"), (F.col("user_id") % 10).cast("string")).alias("series_id"), line.alias("line"))
    p = parse_gc_log(lines)
    # seconds in the text become milliseconds: cents hundredths of a second are cents * 10 ms
    return flat(p, "series_id", "cause", "kind", start_ms=F.unix_millis("start_ts"), duration_ms=F.round("duration_ms", 4))


@query("parse_top", """
SELECT o_orderpriority AS series_id, o_custkey AS pid, o_totalprice AS cpu_pct,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0.0 ELSE (o_orderkey % 97) / 10.0 END AS mem_pct,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'java worker' ELSE 'java' END AS command
FROM orders WHERE o_orderstatus <> 'P'""")
def _(spark, sf):
    """Orders as listing rows in two layouts; pending ones are noise."""
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    short = p.isin("1-URGENT", "2-HIGH")
    price = F.regexp_replace(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), r"\.", ",")
    row = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("MiB Mem : "), price)).when(
        short, F.concat_ws(" ", F.lit(" "), price, F.col("o_custkey").cast("string"), F.lit("java worker"))).otherwise(
        F.concat_ws("   ", F.col("o_custkey").cast("string"), F.lit("app"), price, ((k % 97) / 10).cast("decimal(9,1)").cast("string"), F.lit("java")))
    o = read(spark, sf, "orders").select(p.alias("series_id"), (k + 1).alias("pos"), row.alias("line"))
    head = o.select("series_id").distinct().select("series_id", F.lit(0).cast("bigint").alias("pos"), F.when(
        F.col("series_id").isin("1-URGENT", "2-HIGH"), "%CPU PID COMMAND").otherwise("PID USER %CPU %MEM COMMAND").alias("line"))
    lines = head.unionByName(o).withColumn("file", F.lit("top.txt")).withColumn("chunk", F.floor(F.col("pos") / ROWS_PER_CHUNK))
    return flat(parse_top(lines), "series_id", "pid", "cpu_pct", "command", mem_pct=F.round("mem_pct", 1))


def exec_samples(spark, sf):
    u = F.col("user_id")
    return read(spark, sf, "events").select(
        F.concat(F.lit("n"), (u % 10).cast("string")).alias("series_id"), "ts", u.alias("thread_id"),
        F.concat(F.lit("worker-"), u.cast("string")).alias("thread_name"), (u + 100).alias("os_tid"),
        F.array(F.concat(F.lit("com.shop."), F.col("event_type"), F.lit(".Job.run(Job.java:7)")), F.lit("java.lang.Thread.run(Thread.java:1)")).alias("frames"))


@query("slice_samples", """
WITH e AS (SELECT 'n' || CAST(user_id % 10 AS VARCHAR) AS series_id, epoch_us(ts) // 1000 AS ms, ts, user_id AS u, event_type AS et FROM events),
p AS (SELECT unnest(range(0, 25)) AS d),
w AS (SELECT series_id, 600000 * (1 << min(d)) AS w FROM (SELECT series_id, d, count(DISTINCT ms // (600000 * (1 << d))) AS n FROM e, p GROUP BY ALL) WHERE n <= 300 GROUP BY 1),
b AS (SELECT e.*, w, ms // w * w AS bucket FROM e JOIN w USING (series_id)),
i AS (SELECT series_id, bucket, row_number() OVER (PARTITION BY series_id ORDER BY bucket) - 1 AS dump_idx FROM (SELECT DISTINCT series_id, bucket FROM b))
SELECT series_id, dump_idx, bucket AS ts_ms, w AS slice_ms, CASE WHEN u > 0 THEN u END AS java_id, 'worker-' || CAST(u AS VARCHAR) AS name, u + 100 AS nid_dec,
  'com.shop.' || arg_max(et, ts) || '.Job.run' AS top FROM b JOIN i USING (series_id, bucket) GROUP BY ALL""")
def _(spark, sf):
    t = slice_samples(exec_samples(spark, sf), slice_ms=600_000)
    d = t.dump.select("series_id", "dump_idx", F.unix_millis("ts").alias("ts_ms"), F.regexp_extract("banner", r"(\d+) ms", 1).cast("bigint").alias("slice_ms"))
    return flat(t.thread.join(d, ["series_id", "dump_idx"]), "series_id", "dump_idx", "ts_ms", "slice_ms", "java_id", "name", "nid_dec",
                top=F.get("frames", F.lit(0))["sig"])


@query("merge_kb_first", """
WITH d AS (SELECT p_brand || '-' || CAST(p_size AS VARCHAR) AS name, min(p_partkey) AS kb_ord, 'bundled' AS src FROM part GROUP BY 1),
o AS (SELECT p_brand || '-' || CAST(p_size AS VARCHAR) AS name, max(p_partkey) AS kb_ord, 'site' AS src FROM part WHERE p_retailprice > 1500 GROUP BY 1),
m AS (SELECT *, 0 AS g FROM o UNION ALL SELECT *, 1 FROM d WHERE name NOT IN (SELECT name FROM o))
SELECT name, src, row_number() OVER (ORDER BY g, kb_ord, name) - 1 AS kb_ord FROM m""")
def _(spark, sf):
    return _merged(spark, sf, False)


@query("merge_kb_in_place", """
WITH d AS (SELECT p_brand || '-' || CAST(p_size AS VARCHAR) AS name, min(p_partkey) AS kb_ord, 'bundled' AS src FROM part WHERE p_partkey % 3 > 0 GROUP BY 1),
o AS (SELECT p_brand || '-' || CAST(p_size AS VARCHAR) AS name, max(p_partkey) AS kb_ord, 'site' AS src FROM part WHERE p_retailprice > 1500 GROUP BY 1),
m AS (SELECT d.name, coalesce(o.src, d.src) AS src, 1 AS g, d.kb_ord AS s FROM d LEFT JOIN o USING (name)
  UNION ALL SELECT name, src, 2, kb_ord FROM o WHERE name NOT IN (SELECT name FROM d))
SELECT name, src, row_number() OVER (ORDER BY g, s, name) - 1 AS kb_ord FROM m""")
def _(spark, sf):
    return _merged(spark, sf, True)


def _merged(spark, sf, keep):
    p = read(spark, sf, "part").withColumn("name", F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))
    d = (p.filter("p_partkey % 3 > 0") if keep else p).groupBy("name").agg(F.min("p_partkey").alias("kb_ord")).withColumn("src", F.lit("bundled"))
    o = p.filter("p_retailprice > 1500").groupBy("name").agg(F.max("p_partkey").alias("kb_ord")).withColumn("src", F.lit("site"))
    return flat(kb.merge_kb(d, o, "name", keep), "name", "src", "kb_ord")


@query("validate_rules", """
SELECT CAST(p_partkey AS VARCHAR) AS rule_id, CASE e WHEN 1 THEN 'a rule needs an id, a title, a severity and a recommendation' WHEN 2 THEN 'no such severity: LOUD'
  WHEN 3 THEN 'no such thread state: LOST' WHEN 4 THEN 'a rule has to match on frames, names or states' WHEN 5 THEN 'no such processor time condition'
  ELSE 'bad name regex' END AS error
FROM (SELECT p_partkey, unnest(CASE p_size % 7 WHEN 0 THEN [1] WHEN 1 THEN [2] WHEN 2 THEN [3] WHEN 3 THEN [4] WHEN 4 THEN [5] WHEN 5 THEN [6] ELSE CASE WHEN p_partkey % 2 = 0 THEN [6] ELSE [] END END) AS e FROM part)""")
def _(spark, sf):
    k = F.col("p_size") % 7
    none = F.lit(None).cast("string")
    r = read(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("rule_id"), F.when(k == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.when(k == 1, "LOUD").otherwise("warning").alias("severity"), F.lit("look").alias("recommendation"),
        F.when(k == 3, F.array().cast("array<string>")).otherwise(F.array("p_name")).alias("frames"),
        F.when(k == 5, "(open").when((k == 6) & (F.col("p_partkey") % 2 == 0), "(?P<n>a)").when(k == 6, r"(?<n>a)\p{Alpha}+")
        .otherwise(none).alias("name_regex"),
        F.when(k == 2, F.array(F.lit("blocked"), F.lit("LOST"))).otherwise(F.array().cast("array<string>")).alias("states"),
        F.when(k == 4, "sometimes").otherwise(none).alias("cpu_delta"))
    return flat(kb.validate_rules(r), "rule_id", error=F.when(
        F.col("error").startswith("bad name regex"), "bad name regex").otherwise(F.col("error")))


@query("contention_summary", """
WITH g AS (SELECT o_orderpriority AS series_id, l_returnflag AS kind, 'lock-' || CAST(l_suppkey % 50 AS VARCHAR) AS cls, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS total, max(l_quantity) AS mx
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT series_id, kind, cls, n, CAST(total AS DOUBLE) AS total_ms, mx AS max_ms, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY total DESC, kind, cls) AS rank FROM g) WHERE rank <= 30""")
def _(spark, sf):
    w = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("series_id"), F.col("l_returnflag").alias("kind"),
        F.concat(F.lit("lock-"), (F.col("l_suppkey") % 50).cast("string")).alias("cls"), F.col("l_quantity").alias("duration_ms"))
    return flat(SM.contention_summary(w), "series_id", "kind", "cls", "n", "total_ms", "max_ms", "rank")


def pinned(spark, sf):
    return read(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("n"), (F.col("user_id") % 10).cast("string")).alias("series_id"), "ts", F.col("user_id").cast("string").alias("thread"),
        F.col("value").alias("duration_ms"), F.array(F.concat(F.lit("frame-"), F.col("event_id").cast("string"))).alias("frames"))


@query("pinned_summary", """
WITH e AS (SELECT 'n' || CAST(user_id % 10 AS VARCHAR) AS series_id, event_id, value, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'purchase')
SELECT series_id, count(*) AS n, max(value) AS max_ms, 'frame-' || CAST(arg_min(event_id, r) AS VARCHAR) AS frames FROM e GROUP BY 1""")
def _(spark, sf):
    return flat(SM.pinned_summary(pinned(spark, sf)), "series_id", "n", "max_ms", frames=F.array_join("frames", ","))


@query("finding_pinned", """
WITH e AS (SELECT 'n' || CAST(user_id % 10 AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'purchase')
SELECT series_id, 'virtual-thread-pinned' AS id, 'WARNING' AS severity, CAST(count(*) AS VARCHAR) AS count FROM e GROUP BY 1""")
def _(spark, sf):
    from stackscope.operators import findings as D
    from stackscope.plans.catalog_findings import _context, _finding_rows
    return _finding_rows(D.virtual_thread_pinned(_context(spark, sf, True, pinned=pinned(spark, sf))), "count")


def history(spark, sf):
    """Document sources as past analyses; a stack is a line of a document in its language."""
    d = read(spark, sf, "documents")
    a = d.groupBy("source").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.min("lang").alias("lang"))
    analysis = a.select(F.col("source").alias("id"), F.timestamp_seconds(F.col("last") * 60).alias("ts"), F.concat(F.lit("Release "), F.col("lang")).alias("label"),
                        F.concat(F.lit("Incident with "), F.col("n").cast("string"), F.lit(" stacks, first "), F.col("first").cast("string")).alias("summary"),
                        F.when(F.col("first") % 2 == 0, F.concat(F.lit("base-"), F.col("source"))).alias("baseline"))
    stacks = d.select(F.col("source").alias("analysis_id"), "lang", F.explode(F.split("text", "\n")).alias("line")).select(
        "analysis_id", F.md5(F.concat("lang", "line")).alias("hash"))
    return analysis, stacks


_HISTORY = """
WITH a AS (SELECT source AS id, max(doc_id) * 60 AS ts_s, 'Release ' || min(lang) AS label, 'Incident with ' || CAST(count(*) AS VARCHAR) || ' stacks, first ' || CAST(min(doc_id) AS VARCHAR) AS summary,
    CASE WHEN min(doc_id) % 2 = 0 THEN 'base-' || source END AS baseline FROM documents GROUP BY source),
s AS (SELECT DISTINCT source AS id, md5(lang || unnest(string_split(text, chr(10)))) AS hash FROM documents)
"""


@query("similar_incidents", _HISTORY + """
, q AS (SELECT DISTINCT 'pair' || CAST(CAST(substr(id, 4) AS BIGINT) // 2 AS VARCHAR) AS query_id, hash FROM s),
sh AS (SELECT query_id, id, count(*) AS shared FROM q JOIN s USING (hash) GROUP BY ALL),
o AS (SELECT sh.*, shared / ((SELECT count(*) FROM s x WHERE x.id = sh.id) + (SELECT count(*) FROM q x WHERE x.query_id = sh.query_id) - shared) AS ov FROM sh)
SELECT query_id, id AS analysis_id, label, shared, round(ov, 3) AS overlap, row_number() OVER (PARTITION BY query_id ORDER BY ov DESC, ts_s DESC, id) AS rank FROM o JOIN a USING (id) WHERE ov >= 0.3""")
def _(spark, sf):
    analysis, stacks = history(spark, sf)
    # every two sources together are asked for
    pair = F.floor(F.substring("analysis_id", 4, 9).cast("bigint") / 2).cast("string")
    q = stacks.select(F.concat(F.lit("pair"), pair).alias("query_id"), "hash").distinct()
    return flat(H.similar_incidents(analysis, stacks, q), "query_id", "analysis_id", "label", "shared", "overlap", "rank")


@query("history_list", _HISTORY + "SELECT id, label, summary FROM a ORDER BY ts_s DESC, id LIMIT 12")
def _(spark, sf):
    return flat(H.history_list(history(spark, sf)[0], 12), "id", "label", "summary")


@query("history_search", _HISTORY + "SELECT id, label FROM a WHERE contains(lower(label), 'release d') OR contains(lower(summary), 'first 1') ORDER BY ts_s DESC, id LIMIT 50")
def _(spark, sf):
    a = history(spark, sf)[0]
    both = H.history_search(a, "RELEASE D").unionByName(H.history_search(a, "First 1"))
    return flat(both.dropDuplicates(["id"]), "id", "label")


@query("history_show", _HISTORY + "SELECT id, label, summary, (SELECT count(*) FROM s WHERE s.id = a.id) AS stacks FROM a WHERE id = 'src7'")
def _(spark, sf):
    a, s = history(spark, sf)
    return flat(H.history_show(a, s, "src7"), "id", "label", "summary", "stacks")


@query("history_stacks", _HISTORY + "SELECT hash FROM s WHERE id = 'src7'")
def _(spark, sf):
    return H.stacks_of(history(spark, sf)[1], "src7")


@query("baseline_for_label", _HISTORY + "SELECT label, arg_max(baseline, ts_s) AS baseline FROM a WHERE baseline IS NOT NULL GROUP BY label")
def _(spark, sf):
    return flat(H.baseline_for_label(history(spark, sf)[0]), "label", "baseline")


@query("shared_hashes", _HISTORY + """
, r AS (SELECT x.id AS query_id, y.id AS analysis_id, hash, row_number() OVER (PARTITION BY x.id, y.id ORDER BY hash) AS rank FROM s x JOIN s y USING (hash) WHERE x.id = 'src7')
SELECT query_id, analysis_id, hash, rank FROM r WHERE rank <= 10 AND (SELECT count(*) FROM r z WHERE z.analysis_id = r.analysis_id) /
  ((SELECT count(*) FROM s WHERE s.id = r.analysis_id) + (SELECT count(*) FROM s WHERE s.id = 'src7') - (SELECT count(*) FROM r z WHERE z.analysis_id = r.analysis_id)) >= 0.3""")
def _(spark, sf):
    a, s = history(spark, sf)
    q = s.filter("analysis_id = 'src7'").select(F.col("analysis_id").alias("query_id"), "hash")
    return flat(H.shared_hashes(s, q, H.similar_incidents(a, s, q)), "query_id", "analysis_id", "hash", "rank")


_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"
_IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"
_ADDR = f"{_EMAIL}|{_IP}"
# the sides of a host are matched with it instead of looked at; a mark behind every sign serves as the side of the next host
_SIDED = r"([^\w.@])((?:[A-Za-z0-9][A-Za-z0-9-]*\.)+(?:" + "|".join(HOST_SUFFIXES) + r"))([^\w.])"


def _marked(text: str) -> str:
    return rf"chr(1) || regexp_replace({text}, '([^\w.@-])', '\1' || chr(1), 'g') || chr(1)"


_REDACTED = rf"""
WITH a AS (SELECT doc_id, text, regexp_extract_all(text, '{_ADDR}') AS l FROM documents),
one AS (SELECT doc_id, unnest(l) AS token, unnest(range(1, len(l) + 1)) AS p FROM a),
ip AS (SELECT token, 'ip-' || row_number() OVER (ORDER BY doc_id, p) AS pseudo
  FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, p) AS k FROM one WHERE NOT contains(token, '@')) WHERE k = 1),
cut1 AS (SELECT doc_id, unnest(s) AS part, unnest(l || [NULL]) AS token, unnest(range(1, len(s) + 1)) AS i
  FROM (SELECT doc_id, l, string_split_regex(text, '{_ADDR}') AS s FROM a)),
blank AS (SELECT doc_id, string_agg(part || CASE WHEN contains(token, '@') THEN 'user-0@host-0' ELSE coalesce(pseudo, '') END, '' ORDER BY i) AS text
  FROM cut1 LEFT JOIN ip USING (token) GROUP BY 1),
b AS (SELECT doc_id, regexp_extract_all({_marked("text")}, '{_SIDED}', 2) AS hl FROM blank),
two AS (SELECT doc_id, unnest(hl) AS token, unnest(range(1, len(hl) + 1)) AS p FROM b),
met AS (SELECT CASE WHEN contains(token, '@') THEN 'email' ELSE 'ip' END AS kind, token, doc_id, 0 AS stage, p FROM one
  UNION ALL SELECT 'host', split_part(token, '@', 2), doc_id, 0, p FROM one WHERE contains(token, '@')
  UNION ALL SELECT 'host', token, doc_id, 1, p FROM two),
place AS (SELECT *, row_number() OVER (PARTITION BY kind, token ORDER BY doc_id, stage, p) AS k FROM met),
num AS (SELECT kind, token, stage, row_number() OVER (PARTITION BY kind ORDER BY doc_id, stage, p) AS ord FROM place WHERE k = 1),
tail AS (SELECT token, ord, unnest([array_to_string(string_split(token, '-')[i:], '-') for i in range(2, len(string_split(token, '-')) + 1)]) AS s FROM num WHERE kind = 'host' AND stage = 1),
base AS (SELECT tail.token, arg_min(tail.s, n.ord) AS s, min(n.ord) AS base_ord FROM tail JOIN num n ON n.kind = 'host' AND n.token = tail.s AND n.ord < tail.ord GROUP BY 1),
host AS (SELECT n.token, CASE WHEN s IS NULL THEN 'host-' || ord ELSE left(n.token, len(n.token) - len(s)) || 'host-' || base_ord END AS pseudo
  FROM num n LEFT JOIN base USING (token) WHERE n.kind = 'host'),
addr AS (SELECT n.token, CASE kind WHEN 'ip' THEN 'ip-' || ord ELSE 'user-' || ord || '@' || host.pseudo END AS pseudo
  FROM num n LEFT JOIN host ON kind = 'email' AND host.token = split_part(n.token, '@', 2) WHERE kind <> 'host'),
red1 AS (SELECT doc_id, string_agg(part || coalesce(pseudo, ''), '' ORDER BY i) AS text FROM cut1 LEFT JOIN addr USING (token) GROUP BY 1),
red2 AS (SELECT doc_id, {_marked("text")} AS text FROM red1),
cut2 AS (SELECT doc_id, unnest(s) AS part, unnest(hl || [NULL]) AS token, unnest(x || ['']) AS x, unnest(y || ['']) AS y, unnest(range(1, len(s) + 1)) AS i
  FROM (SELECT doc_id, hl, string_split_regex(text, '{_SIDED}') AS s, regexp_extract_all(text, '{_SIDED}', 1) AS x,
    regexp_extract_all(text, '{_SIDED}', 3) AS y FROM red2 JOIN b USING (doc_id)))
SELECT doc_id, replace(string_agg(part || x || coalesce(pseudo, '') || y, '' ORDER BY i), chr(1), '') AS text
FROM cut2 LEFT JOIN host USING (token) GROUP BY 1 UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL"""


@query("redacted_documents", _REDACTED)
def _(spark, sf):
    """Whole texts with every address and host name replaced."""
    return redact(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")[0]


@query("redaction_numbers", f"""
WITH t AS (SELECT doc_id, unnest(l) AS token, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(text, '{_ADDR}') AS l FROM documents)),
f AS (SELECT CASE WHEN contains(token, '@') THEN 'email' ELSE 'ip' END AS kind, token, min(doc_id * 100000 + p) AS f FROM t GROUP BY ALL)
SELECT kind, token, row_number() OVER (PARTITION BY kind ORDER BY f) AS ord FROM f""")
def _(spark, sf):
    m = redact(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")[1]
    return flat(m.filter("kind <> 'host'"), "kind", "token", "ord")


@query("threshold_trigger", """
WITH RECURSIVE e AS (SELECT user_id AS pid, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) * 10000 AS ticks FROM events),
d AS (SELECT *, ticks - lag(ticks) OVER w AS dt, us - lag(us) OVER w AS du FROM e WINDOW w AS (PARTITION BY pid ORDER BY us)),
b AS (SELECT pid, us, CASE WHEN 100.0 * (dt / 100.0) / (du / 1e6) / 4 >= 60 THEN 'cpu' WHEN k >= 90 THEN 'thread' END AS why FROM d),
h AS (SELECT * FROM b WHERE why IS NOT NULL),
f AS (SELECT pid, min(us) AS us FROM h GROUP BY pid
  UNION ALL SELECT f.pid, (SELECT min(h.us) FROM h WHERE h.pid = f.pid AND h.us >= f.us + 259200000000) FROM f WHERE f.us IS NOT NULL)
SELECT f.pid, f.us, h.why FROM f JOIN h ON h.pid = f.pid AND h.us = f.us""")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts")
    m = read(spark, sf, "events").select(
        F.col("user_id").alias("pid"), "ts", (F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w) * 10000).alias("ticks"),
        F.from_json("props", "k int")["k"].alias("thread_count"))
    t = threshold_trigger(m, 60.0, 90, 3 * 86400, cores=4)
    return flat(t, "pid", us=F.unix_micros("ts"), why=F.substring_index("reason", " ", 1))


@query("implicit_frames", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'com.' || CAST(page_id AS VARCHAR) || '.Page' END AS cls FROM pages""")
def _(spark, sf):
    """Lines that are frames and lines that only look like one."""
    n = F.col("page_id").cast("string")
    line = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("   at com."), n, F.lit(".Page.show(Page.java:3) ~[app.jar:1]"))).otherwise(
        F.concat(F.lit("at the page "), n))
    return flat(read(spark, sf, "pages"), "page_id", cls=parse_frame(line)["cls"])
