"""Per-dump queries over the event snapshot."""

from pyspark.sql import functions as F

from stackscope.functions import frames as fr
from stackscope.functions import names as nm
from stackscope.operators import single as S
from stackscope.operators.derive import derive, frame_meaning, idle_label, java_threads
from stackscope.operators.views import call_stack_tree, flame_threads, flame_trie, search_threads, with_paths
from stackscope.plans.registry import flat, query
from stackscope.plans.snapshots import event_tables, read
from stackscope.plans.sqlbase import snap


def threads(spark, sf, by_node=False):
    return derive(event_tables(spark, sf, by_node).thread)


@query("state_distribution", snap(body="""
SELECT dump_idx, count(*) AS total, count(*) FILTER (u % 2 = 0) AS daemon, 0 AS vm_threads
FROM snap GROUP BY dump_idx"""))
def _(spark, sf):
    return flat(S.state_distribution(threads(spark, sf)), "dump_idx", "total", "daemon", "vm_threads")


@query("state_counts", snap(body="""
SELECT dump_idx, state, count(*) AS n,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY dump_idx), 6) AS percent
FROM snap GROUP BY dump_idx, state"""))
def _(spark, sf):
    return flat(S.state_counts(threads(spark, sf)), "dump_idx", "state", "n", percent=F.round("percent", 6))


@query("pool_stats", snap(body="""
SELECT dump_idx, pool, count(*) AS size, count(*) FILTER (state = 'RUNNABLE') AS runnable,
  count(*) FILTER (state = 'BLOCKED') AS blocked, count(*) FILTER (state = 'WAITING') AS waiting,
  count(*) FILTER (state = 'TIMED_WAITING') AS timed_waiting,
  count(*) FILTER (mark IN ('[STUCK] ', '[HOGGING] ')) AS stuck,
  count(*) FILTER (cls = 'APPLICATION') AS busy, count(*) FILTER (cls <> 'APPLICATION') AS idle
FROM snap GROUP BY dump_idx, pool"""))
def _(spark, sf):
    return flat(S.pool_stats(threads(spark, sf)), "dump_idx", "pool", "size", "runnable", "blocked", "waiting",
                "timed_waiting", "stuck", "busy", "idle")


@query("category_breakdown", snap(body="""
SELECT dump_idx, category, count(*) AS n FROM snap WHERE category IS NOT NULL GROUP BY dump_idx, category"""))
def _(spark, sf):
    return flat(S.category_breakdown(threads(spark, sf)), "dump_idx", "category", "n")


_GROUPS = """
g AS (SELECT series_id, dump_idx, h, count(*) AS n, min(u) AS first_ord, arg_min(r0 || ' < ' || r1 || ' < ' || r2, u) AS stack,
        count(*) FILTER (state = 'BLOCKED') AS blocked
      FROM snap GROUP BY series_id, dump_idx, h HAVING count(*) >= 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, dump_idx ORDER BY n DESC, first_ord, h) AS rank FROM g)
        WHERE rank <= 15)
"""


@query("stack_groups", snap(body="," + _GROUPS + """
SELECT dump_idx, rank, h AS stack_hash, n, first_ord, blocked, stack FROM top"""))
def _(spark, sf):
    return flat(S.stack_groups(threads(spark, sf)), "dump_idx", "rank", "stack_hash", "n", "first_ord", "blocked",
                stack=F.array_join("stack", " < "))


@query("stack_group_members", snap(body="""
SELECT dump_idx, h AS stack_hash, name, rank FROM (
  SELECT dump_idx, h, name, row_number() OVER (PARTITION BY dump_idx, h ORDER BY u) AS rank FROM snap)
WHERE rank <= 25"""))
def _(spark, sf):
    return flat(S.stack_group_members(threads(spark, sf)), "dump_idx", "stack_hash", "name", "rank")


@query("method_stats", snap(body=""",
m AS (
  SELECT dump_idx, 'last_executed' AS kind, f0 AS method, u, 0 AS p FROM snap
  UNION ALL SELECT dump_idx, 'most_used', f0, u, 0 FROM snap
  UNION ALL SELECT dump_idx, 'most_used', f1, u, 1 FROM snap
  UNION ALL SELECT dump_idx, 'most_used', f2, u, 2 FROM snap),
c AS (SELECT dump_idx, kind, method, count(*) AS n, min(u * 10 + p) AS f FROM m GROUP BY ALL)
SELECT dump_idx, kind, method, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dump_idx, kind ORDER BY n DESC, f, method) AS rank FROM c)
WHERE rank <= 15"""))
def _(spark, sf):
    return flat(S.method_stats(threads(spark, sf)), "dump_idx", "kind", "method", "n", "rank")


@query("pool_utilization", snap(body="""
SELECT pool, round(100.0 * sum(busy) / sum(size), 6) AS avg_busy_pct, max(size) AS max_size, CAST(sum(b) AS BIGINT) AS blocked_seen
FROM (SELECT dump_idx, pool, count(*) AS size, count(*) FILTER (cls = 'APPLICATION') AS busy,
        count(*) FILTER (state = 'BLOCKED') AS b FROM snap GROUP BY dump_idx, pool) GROUP BY pool"""))
def _(spark, sf):
    return flat(S.pool_utilization(threads(spark, sf)), "pool", "max_size", "blocked_seen",
                avg_busy_pct=F.round("avg_busy_pct", 6))


@query("gc_jit_sanity", """
WITH t AS (SELECT o_custkey % 16 AS dump_idx, o_orderpriority AS p FROM orders)
SELECT dump_idx, count(*) FILTER (p IN ('1-URGENT', '2-HIGH')) AS gc_threads,
  count(*) FILTER (p = '3-MEDIUM') AS jit_threads,
  CAST(count(*) FILTER (p IN ('1-URGENT', '2-HIGH')) >= 24 OR count(*) FILTER (p = '3-MEDIUM') >= 8 AS BIGINT) AS outsized
FROM t GROUP BY dump_idx""")
def _(spark, sf):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    t = read(spark, sf, "orders").select(
        F.lit("all").alias("series_id"), (F.col("o_custkey") % 16).alias("dump_idx"),
        F.when(p == "1-URGENT", F.concat(F.lit("GC Thread#"), k)).when(
            p == "2-HIGH", F.concat(F.lit("G1 Conc#"), k)).when(
            p == "3-MEDIUM", F.concat(F.lit("C2 CompilerThread"), k)).otherwise(
            F.concat(F.lit("worker-"), k)).alias("name"))
    return flat(S.gc_jit_sanity(t), "dump_idx", "gc_threads", "jit_threads", "outsized")


def _carriers(spark, sf):
    """Orders as virtual threads carried by their customers; dump = customer key modulo 16.

    Customers without a positive balance stand in the dump under another id, so their carriers are not found."""
    o = read(spark, sf, "orders").select(
        F.lit("all").alias("series_id"), (F.col("o_custkey") % 16).alias("dump_idx"),
        F.col("o_orderkey").alias("thread_ord"), F.concat(F.lit("virtual-"), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit(None).cast("bigint").alias("java_id"), F.lit(True).alias("is_virtual"),
        F.col("o_custkey").cast("string").alias("carrier_tid"), F.lit(False).alias("is_vm"))
    c = read(spark, sf, "customer").select(
        F.lit("all").alias("series_id"), (F.col("c_custkey") % 16).alias("dump_idx"),
        F.col("c_custkey").alias("thread_ord"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("java_id"),
        F.lit(False).alias("is_virtual"), F.lit(None).cast("string").alias("carrier_tid"), F.lit(False).alias("is_vm"))
    return o.unionByName(c)


@query("virtual_counts", """
SELECT o.dump_idx, o.n AS virtual, coalesce(c.n, 0) AS platform
FROM (SELECT o_custkey % 16 AS dump_idx, count(*) AS n FROM orders GROUP BY 1) o
LEFT JOIN (SELECT c_custkey % 16 AS dump_idx, count(*) AS n FROM customer GROUP BY 1) c USING (dump_idx)""")
def _(spark, sf):
    return flat(S.virtual_counts(_carriers(spark, sf)), "dump_idx", "virtual", "platform")


@query("carrier_map", """
SELECT o_custkey % 16 AS dump_idx, CAST(o_custkey AS VARCHAR) AS carrier_tid, count(*) AS n,
  coalesce(max(c_name), 'tid ' || CAST(o_custkey AS VARCHAR)) AS carrier,
  array_to_string(list_transform(list_sort(list(o_orderkey))[1:10], lambda x: 'virtual-' || CAST(x AS VARCHAR)), ',') AS names
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
GROUP BY o_custkey""")
def _(spark, sf):
    return flat(S.carrier_map(_carriers(spark, sf)), "dump_idx", "carrier_tid", "carrier", "n",
                names=F.array_join("virtual_names", ","))


@query("cpu_attribution", """
WITH s AS (SELECT o_custkey AS pid, arg_max(o_totalprice, o_orderkey) AS cpu_pct FROM orders GROUP BY o_custkey),
t AS (SELECT c_nationkey AS dump_idx, c_custkey AS ord, c_name AS name,
        CASE WHEN c_acctbal > 0 THEN c_acctbal END AS cpu_ms FROM customer),
j AS (SELECT t.*, s.cpu_pct FROM t LEFT JOIN s ON s.pid = t.ord WHERE cpu_ms IS NOT NULL OR cpu_pct IS NOT NULL)
SELECT dump_idx, name, cpu_ms, cpu_pct AS top_percent, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dump_idx
    ORDER BY CASE WHEN cpu_pct IS NOT NULL THEN 1000000 + cpu_pct ELSE coalesce(cpu_ms, 0) END DESC, ord) AS rank FROM j)
WHERE rank <= 40""")
def _(spark, sf):
    none = F.lit(None)
    t = read(spark, sf, "customer").select(
        F.lit("all").alias("series_id"), F.col("c_nationkey").alias("dump_idx"), F.col("c_custkey").alias("thread_ord"),
        F.col("c_name").alias("name"), none.cast("string").alias("nid_hex"), F.col("c_custkey").alias("nid_dec"),
        F.lit("RUNNABLE").alias("state"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("cpu_ms"),
        none.cast("double").alias("elapsed_s"))
    s = read(spark, sf, "orders").select(
        F.lit("all").alias("series_id"), F.col("o_orderkey").alias("sample_ord"), F.col("o_custkey").alias("pid"),
        F.col("o_totalprice").alias("cpu_pct"), F.lit(0.0).alias("mem_pct"))
    return flat(S.cpu_attribution(t, s), "dump_idx", "name", "cpu_ms", "top_percent", "rank")


_ANNOTATED = """
ann AS (SELECT *, r0 || CASE
    WHEN et = 'error' THEN '|- waiting to lock <0x00000000e000000' || CAST(u % 8 AS VARCHAR) || '> (a com.shop.Ledger' || CAST(u % 8 AS VARCHAR) || ')'
    WHEN et = 'purchase' THEN '|- locked <0x00000000e000000' || CAST(u % 8 AS VARCHAR) || '> (a com.shop.Ledger' || CAST(u % 8 AS VARCHAR) || ')'
    WHEN et = 'view' THEN '|- waiting on <0x00000000f' || lpad(CAST(u AS VARCHAR), 7, '0') || '> (a java.lang.Object)'
    ELSE '' END || '|' || r1 || CASE
    WHEN et = 'error' AND u % 5 = 0 THEN '|- locked <0x00000000e000000' || CAST((u + 3) % 8 AS VARCHAR) || '> (a com.shop.Ledger' || CAST((u + 3) % 8 AS VARCHAR) || ')'
    WHEN et = 'view' THEN '|- locked <0x00000000f' || lpad(CAST(u AS VARCHAR), 7, '0') || '> (a java.lang.Object)'
    ELSE '' END || '|' || r2 AS lines FROM snap),
keyed AS (SELECT *, h || CASE WHEN et IN ('error', 'purchase', 'view') THEN '-' || md5(replace(lines, '|', chr(10))) ELSE '' END AS stack_key FROM ann)
"""


@query("annotated_stacks", snap(body="," + _ANNOTATED + """
SELECT dump_idx, name, stack_key, lines FROM keyed"""))
def _(spark, sf):
    t = threads(spark, sf)
    return flat(t, "dump_idx", "name", stack_key=fr.stack_key(F.col("frames"), F.col("locks")),
                lines=F.array_join(fr.annotated_stack(F.col("frames"), F.col("locks")), "|"))


@query("stack_table", snap(body="," + _ANNOTATED + """
SELECT dump_idx, stack_key, arg_min(lines, u) AS lines FROM keyed GROUP BY dump_idx, stack_key"""))
def _(spark, sf):
    return flat(S.stack_table(threads(spark, sf)), "dump_idx", "stack_key", lines=F.array_join("lines", "|"))


@query("frame_lines", snap(body="," + _ANNOTATED + """
SELECT dump_idx, name, r0 || '|' || r1 || '|' || r2 AS frames FROM keyed"""))
def _(spark, sf):
    lines = fr.annotated_stack(F.col("frames"), F.col("locks"))
    return flat(threads(spark, sf), "dump_idx", "name", frames=F.array_join(fr.frame_lines(lines), "|"))


@query("thread_detail", snap(body="," + _ANNOTATED + """
SELECT dump_idx, name, u AS java_id, '0x' || lower(hex(u + 4096)) AS tid_hex, u + 1 AS nid_dec, u % 3 + 4 AS prio,
  state, 'waiting on condition' AS state_detail, CAST(cpu AS DOUBLE) AS cpu_ms, pool,
  CASE WHEN cls = 'IDLE' THEN 'idle (waiting for work)' END AS class,
  CASE et WHEN 'signup' THEN 'waiting to borrow a connection from HikariCP' WHEN 'error' THEN 'writing a log record' END AS activity,
  category, stack_key FROM keyed"""))
def _(spark, sf):
    return flat(S.thread_detail(threads(spark, sf)), "dump_idx", "name", "java_id", "tid_hex", "nid_dec", "prio",
                "state", "state_detail", "cpu_ms", "pool", "class", "activity", "category", "stack_key")


@query("thread_keys_and_pools", snap(body="""
SELECT dump_idx, name, key, norm AS norm_name, pool, CAST(mark IN ('[STUCK] ', '[HOGGING] ') AS BIGINT) AS stuck_marked,
  0 AS housekeeping, cls AS cls_kind, h AS stack_hash FROM snap"""))
def _(spark, sf):
    return flat(threads(spark, sf), "dump_idx", "name", "key", "norm_name", "pool", "cls_kind", "stack_hash",
                stuck_marked=nm.is_stuck_marked(F.col("name")), housekeeping=nm.is_housekeeping(F.col("name")))


@query("user_pool_rules", """
SELECT CASE WHEN regexp_full_match(c_name, 'Customer#0*([0-9])[0-9]*') AND c_mktsegment = 'BUILDING'
    THEN 'builders ' || regexp_extract(c_name, 'Customer#0*([0-9])[0-9]*', 1)
  WHEN regexp_full_match(c_name, 'Customer#.*') AND c_mktsegment = 'MACHINERY' THEN 'machines' END AS pool, count(*) AS n
FROM customer GROUP BY 1""")
def _(spark, sf):
    c = read(spark, sf, "customer").withColumn("name", F.concat_ws(" ", "c_mktsegment", "c_name"))
    rules = (("builders", r"BUILDING Customer#0*([0-9])[0-9]*"), ("machines", r"MACHINERY Customer#.*"))
    return flat(c.groupBy(nm.assign_pool(F.col("name"), rules).alias("pool")).agg(F.count("*").alias("n")), "pool", "n")


@query("housekeeping_names", """
SELECT p_partkey, CAST(p_size % 6 IN (0, 1, 2, 3) AS BIGINT) AS housekeeping FROM part""")
def _(spark, sf):
    k = F.col("p_partkey").cast("string")
    size = F.col("p_size") % 6
    name = (F.when(size == 0, F.concat(F.lit("C1 CompilerThread"), k)).when(size == 1, F.concat(F.lit("GC Thread#"), k))
            .when(size == 2, "Reference Handler").when(size == 3, F.concat(F.lit("G1 Refine#"), k))
            .when(size == 4, F.concat(F.lit("My Finalizer"), k)).otherwise(F.concat(F.lit("pool-1-thread-"), k)))
    return flat(read(spark, sf, "part"), "p_partkey", housekeeping=nm.is_housekeeping(name))


@query("worker_groups", snap(body="""
SELECT p.platform, CASE
    WHEN p.platform = 'TOMCAT' AND u % 4 = 0 THEN 'http-nio-8080'
    WHEN p.platform = 'WEBLOGIC' AND u % 4 = 2 THEN 'queue ''q'''
    WHEN p.platform = 'WEBSPHERE' AND u % 4 = 3 THEN 'WebContainer' END AS grp, count(*) AS n
FROM snap, (VALUES ('TOMCAT'), ('WEBLOGIC'), ('WEBSPHERE'), ('LIBERTY')) p(platform) GROUP BY ALL"""))
def _(spark, sf):
    t = threads(spark, sf).select("name", F.explode(F.array(*[F.lit(p) for p in (
        "TOMCAT", "WEBLOGIC", "WEBSPHERE", "LIBERTY")])).alias("platform"))
    g = nm.worker_group(F.col("name"), F.col("platform"))
    return flat(t.groupBy("platform", g.alias("grp")).agg(F.count("*").alias("n")), "platform", "grp", "n")


@query("parse_frames", """
WITH s AS (SELECT doc_id, n_chars, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, n_chars, unnest(range(len(l))) AS line, regexp_replace(unnest(l), '[^A-Za-z0-9]', '', 'g') AS w FROM s)
SELECT doc_id, line, 'org.L' || w || '.Main' AS cls, 'run' || CAST(line AS VARCHAR) AS method,
  CASE WHEN n_chars % 3 = 0 THEN 'Native Method' ELSE 'Main.java:' || CAST(n_chars AS VARCHAR) END AS loc,
  'org.L' || w || '.Main.run' || CAST(line AS VARCHAR) AS sig, CAST(n_chars % 3 = 0 AS BIGINT) AS native FROM w""")
def _(spark, sf):
    """Every line of every document as a frame."""
    lines = read(spark, sf, "documents").select("doc_id", "n_chars", F.posexplode(F.split("text", "\n")).alias("line", "w"))
    line = F.concat(F.lit("\tat "), F.when(F.col("n_chars") % 2 == 0, "java.base@21/").otherwise(""), F.lit("org.L"),
                    F.regexp_replace("w", "[^A-Za-z0-9]", ""), F.lit(".Main.run"), F.col("line").cast("string"), F.lit("("), F.when(F.col("n_chars") % 3 == 0, "Native Method").otherwise(
                        F.concat(F.lit("Main.java:"), F.col("n_chars").cast("string"))), F.lit(")"))
    f = fr.parse_frame(line)
    d = lines.select("doc_id", "line", f.alias("f"))
    return flat(d, "doc_id", "line", cls=F.col("f.cls"), method=F.col("f.method"), loc=F.col("f.loc"), sig=F.col("f.sig"),
                native=F.col("f.native"))


@query("j9_frames", """
SELECT p_partkey, 'com.' || replace(p_name, ' ', '.') || '.Job.run(Job.java:' || CAST(p_size AS VARCHAR) || ')' AS frame FROM part""")
def _(spark, sf):
    n = F.col("p_size").cast("string")
    raw = F.concat(F.lit("at com/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/Job.run(Job.java:"), n,
                   F.when(F.col("p_size") % 2 == 0, "(Compiled Code))").otherwise(")"))
    return flat(read(spark, sf, "part"), "p_partkey",
                frame=F.regexp_replace(fr.normalize_j9_frame(raw), "^at ", ""))


@query("state_mapping", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RUNNABLE' WHEN 'F' THEN 'TIMED_WAITING' ELSE 'UNKNOWN' END AS state,
  CASE o_orderstatus WHEN 'O' THEN 'BLOCKED' WHEN 'F' THEN 'UNKNOWN' ELSE 'WAITING' END AS j9_state FROM orders""")
def _(spark, sf):
    o = F.col("o_orderstatus")
    text = F.when(o == "O", " runnable now").when(o == "F", "TIMED_WAITING (sleeping)").otherwise("odd")
    letters = F.when(o == "O", "MW").when(o == "F", "F").otherwise("CW")
    return flat(read(spark, sf, "orders"), "o_orderkey", state=nm.map_state(text), j9_state=nm.map_j9_state(letters)[0])


def _document_stacks(spark, sf):
    """Documents as threads: the lines of the text are the frames."""
    frames = F.transform(F.split("text", "\n"), lambda s: F.struct(
        s.alias("raw"), s.alias("cls"), F.lit("").alias("method"), F.lit("").alias("loc"), s.alias("sig"),
        F.lit(False).alias("native")))
    return read(spark, sf, "documents").select("doc_id", "source", "lang", frames.alias("frames"))


_KB = (("prose-the", "article", ("the ", "The ")), ("prose-und", "german", (" und ", "Und ")),
       ("prose-que", "romance", ("que",)))


@query("idle_labels", """
WITH f AS (SELECT doc_id, pos, line FROM (
    SELECT doc_id, unnest(range(1, 9)) AS pos, string_split(text, chr(10)) AS l FROM documents) x,
    LATERAL (SELECT l[pos] AS line) WHERE line IS NOT NULL),
hit AS (SELECT doc_id, pos, CASE
    WHEN contains(line, 'the ') OR contains(line, 'The ') THEN 'article'
    WHEN contains(line, ' und ') OR contains(line, 'Und ') THEN 'german'
    WHEN contains(line, 'que') THEN 'romance' END AS label FROM f)
SELECT d.doc_id, h.label FROM documents d LEFT JOIN (
  SELECT doc_id, arg_min(label, pos) AS label FROM hit WHERE label IS NOT NULL GROUP BY doc_id) h USING (doc_id)""")
def _(spark, sf):
    from stackscope.knowledge import LabelEntry
    kb = tuple(LabelEntry(n, lb, fs) for n, lb, fs in _KB)
    return flat(_document_stacks(spark, sf), "doc_id", label=idle_label(F.col("frames"), kb))


@query("frame_meanings", """
WITH f AS (SELECT doc_id, pos, line FROM (
    SELECT doc_id, unnest(range(1, 11)) AS pos, string_split(text, chr(10)) AS l FROM documents) x,
    LATERAL (SELECT l[pos] AS line) WHERE line IS NOT NULL),
hit AS (SELECT doc_id, pos, CASE
    WHEN contains(line, ' und ') OR contains(line, 'Und ') THEN 'german/prose-und'
    WHEN contains(line, 'que') THEN 'romance/prose-que' END AS m FROM f)
SELECT m, count(*) AS n FROM (
  SELECT d.doc_id, h.m FROM documents d LEFT JOIN (
    SELECT doc_id, arg_min(m, pos) AS m FROM hit WHERE m IS NOT NULL GROUP BY doc_id) h USING (doc_id)) GROUP BY m""")
def _(spark, sf):
    from stackscope.knowledge import LabelEntry
    kb = tuple(LabelEntry(n, lb, fs, n) for n, lb, fs in _KB[1:])
    m = frame_meaning(F.col("frames"), kb)
    d = _document_stacks(spark, sf).select(F.concat_ws("/", m["activity"], m["category"]).alias("m"), m.alias("s"))
    d = d.select(F.when(F.col("s").isNotNull(), F.col("m")).alias("m"))
    return flat(d.groupBy("m").agg(F.count("*").alias("n")), "m", "n")


@query("app_frames", snap(body="""
SELECT dump_idx, count(*) FILTER (et <> 'view') AS with_app, count(*) AS n FROM snap GROUP BY dump_idx"""))
def _(spark, sf):
    t = java_threads(threads(spark, sf)).groupBy("dump_idx").agg(
        F.count(F.when(fr.has_app_frames(F.col("frames")), 1)).alias("with_app"), F.count("*").alias("n"))
    return flat(t, "dump_idx", "with_app", "n")


@query("fingerprints", """
SELECT doc_id, md5(text) AS stack_hash,
  md5(array_to_string(string_split(text, chr(10))[1:8], chr(10))) AS fp FROM documents""")
def _(spark, sf):
    f = F.col("frames")
    return flat(_document_stacks(spark, sf), "doc_id", stack_hash=fr.stack_hash(f), fp=fr.stack_hash(f, 8))


@query("repeated_documents", """
WITH g AS (SELECT md5(text) AS stack_hash, count(*) AS n, min(doc_id) AS first_ord FROM documents GROUP BY 1 HAVING count(*) >= 2)
SELECT * FROM (SELECT stack_hash, n, first_ord, row_number() OVER (ORDER BY n DESC, first_ord, stack_hash) AS rank FROM g)
WHERE rank <= 15""")
def _(spark, sf):
    d = _document_stacks(spark, sf).withColumn("stack_hash", fr.stack_hash(F.col("frames"))).select(
        F.lit("all").alias("series_id"), F.lit(0).alias("dump_idx"), F.col("doc_id").alias("thread_ord"),
        F.col("source").alias("name"), F.lit("RUNNABLE").alias("state"), F.lit(False).alias("is_vm"), "frames", "stack_hash")
    return flat(S.stack_groups(d), "stack_hash", "n", "first_ord", "rank")


@query("search_threads", snap(body="""
SELECT dump_idx, name, state, pool FROM snap
WHERE (contains(lower(name), 'page1') OR contains(lower(r0 || ' ' || r1 || ' ' || r2), 'page1') OR contains(lower(name), 'thread-1'))
  AND state = 'RUNNABLE' AND u % 2 = 1 AND pool = 'pool-7'"""))
def _(spark, sf):
    t = threads(spark, sf)
    eq = dict(state="RUNNABLE", daemon=False, pool="pool-7")
    hit = search_threads(t, "page1", **eq).unionByName(search_threads(t, "thread-1", **eq)).dropDuplicates(["dump_idx", "thread_ord"])
    return flat(hit, "dump_idx", "name", "state", "pool")


@query("flame_trie", snap(body=""",
p AS (
  SELECT dump_idx, u, 1 AS depth, r2 AS path, r2 AS frame FROM snap WHERE state = 'RUNNABLE'
  UNION ALL SELECT dump_idx, u, 2, r2 || chr(10) || r1, r1 FROM snap WHERE state = 'RUNNABLE'
  UNION ALL SELECT dump_idx, u, 3, r2 || chr(10) || r1 || chr(10) || r0, r0 FROM snap WHERE state = 'RUNNABLE')
SELECT dump_idx, depth, replace(path, chr(10), '|') AS path, frame, count(*) AS n, min(u) AS first_ord FROM p GROUP BY ALL"""))
def _(spark, sf):
    t = threads(spark, sf)
    return flat(with_paths(flame_trie(t), t, path="depth"), "dump_idx", "depth", "frame", "n", "first_ord",
                path=F.replace("path", F.lit("\n"), F.lit("|")))


@query("flame_threads", snap(body=""",
p AS (
  SELECT dump_idx, u, name, r2 AS path FROM snap WHERE state = 'RUNNABLE'
  UNION ALL SELECT dump_idx, u, name, r2 || '|' || r1 FROM snap WHERE state = 'RUNNABLE'
  UNION ALL SELECT dump_idx, u, name, r2 || '|' || r1 || '|' || r0 FROM snap WHERE state = 'RUNNABLE')
SELECT * FROM (SELECT dump_idx, path, name, row_number() OVER (PARTITION BY dump_idx, path ORDER BY u) AS rank FROM p) WHERE rank <= 20"""))
def _(spark, sf):
    t = threads(spark, sf)
    through = flame_threads(t).withColumnRenamed("thread_ord", "first_ord")
    return flat(with_paths(through, t, path="depth"), "dump_idx", "name", "rank", path=F.replace("path", F.lit("\n"), F.lit("|")))


def _url_stacks(spark, sf):
    """Pages as threads: the path segments of the address, root first."""
    seg = F.split(F.regexp_replace("url", r"^[a-z]+://", ""), "/")
    frames = F.transform(F.reverse(F.filter(seg, lambda s: F.length(s) > 0)), lambda s: F.struct(
        s.alias("raw"), s.alias("cls"), F.lit("").alias("method"), F.lit("").alias("loc"), s.alias("sig"), F.lit(False).alias("native")))
    return read(spark, sf, "pages").select(
        F.lit("all").alias("series_id"), F.lit(0).alias("dump_idx"), F.col("page_id").alias("thread_ord"),
        F.col("url").alias("name"), F.lit("RUNNABLE").alias("state"), frames.alias("frames"))


@query("url_flame", """
WITH s AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: length(x) > 0) AS l FROM pages),
p AS (SELECT page_id, d AS depth, array_to_string(l[1:d], '|') AS path, l[d] AS frame FROM (
  SELECT page_id, l, unnest(range(1, least(len(l), 30) + 1)) AS d FROM s))
SELECT depth, path, frame, count(*) AS n, min(page_id) AS first_ord FROM p GROUP BY ALL""")
def _(spark, sf):
    t = _url_stacks(spark, sf)
    return flat(with_paths(flame_trie(t), t, path="depth"), "depth", "frame", "n", "first_ord", path=F.replace("path", F.lit("\n"), F.lit("|")))


@query("call_stack_tree", """
WITH RECURSIVE s AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: length(x) > 0) AS l FROM pages),
p AS (SELECT page_id, d AS depth, array_to_string(l[1:d], '|') AS path, l[d] AS frame,
    CASE WHEN d > 1 THEN array_to_string(l[1:d-1], '|') END AS parent FROM (
  SELECT page_id, l, unnest(range(1, least(len(l), 40) + 1)) AS d FROM s)),
node AS (SELECT depth, path, parent, frame, count(*) AS n, min(page_id) AS f FROM p GROUP BY ALL),
kid AS (SELECT parent AS path, count(*) AS kids, max(n) AS kid_n FROM node WHERE parent IS NOT NULL GROUP BY 1),
chain AS (SELECT n.path FROM node n JOIN kid k USING (path) WHERE kids = 1 AND kid_n = n.n),
walk AS (
  SELECT path AS head, path, frame AS last_frame, 1 AS len FROM node
  WHERE parent IS NULL OR parent NOT IN (SELECT path FROM chain)
  UNION ALL
  SELECT w.head, c.path, c.frame, w.len + 1 FROM walk w JOIN node c ON c.parent = w.path WHERE w.path IN (SELECT path FROM chain)),
ends AS (SELECT head, arg_max(path, len) AS last_path, arg_max(last_frame, len) AS last_frame, max(len) AS chain FROM walk GROUP BY head),
r AS (SELECT n.path AS head_path, e.last_path, e.last_frame, e.chain, n.n, n.depth,
    row_number() OVER (ORDER BY n.depth, n.n DESC, n.f, n.path) AS rank
  FROM ends e JOIN node n ON n.path = e.head)
SELECT * FROM r""")
def _(spark, sf):
    bar = lambda c: F.replace(c, F.lit("\n"), F.lit("|"))
    t = _url_stacks(spark, sf)
    tree = with_paths(call_stack_tree(t), t, head_path="depth", last_path="last_depth")
    return flat(tree, "last_frame", "chain", "n", "depth", "rank", head_path=bar("head_path"), last_path=bar("last_path"))
