"""Queries on rules, detectors, middleware and pauses."""

import uuid

from pyspark.sql import functions as F

from stackscope.functions.names import queue_of
from stackscope.knowledge import BUNDLED_RULES, RuleEntry
from stackscope.operators import findings as D
from stackscope.operators import history as H
from stackscope.operators import locks as L
from stackscope.operators import middleware as M
from stackscope.operators import pauses as P
from stackscope.operators import rules as R
from stackscope.operators import series as S
from stackscope.plans.analyze import analyze
from stackscope.plans.catalog_locks import CHAIN, CLOSURE, CYCLES, chain_threads
from stackscope.plans.catalog_series import VERDICTS, order_threads, snapshot, verdicts
from stackscope.plans.registry import flat, query
from stackscope.plans.snapshots import error_pauses, event_tables, read
from stackscope.plans.sqlbase import snap
from stackscope.session import shared_dir, store

_RULES = """
, rm AS (
  SELECT series_id, dump_idx, u, key, name, 'connection-pool-exhaustion' AS rule_id, r0 AS frame FROM snap WHERE et = 'signup'
  UNION ALL SELECT series_id, dump_idx, u, key, name, 'sync-logging-bottleneck', r0 FROM snap WHERE et = 'error'),
rd AS (SELECT series_id, rule_id, dump_idx, count(*) AS n FROM rm GROUP BY ALL),
rw AS (SELECT series_id, rule_id, arg_max(dump_idx, n * 100000 - dump_idx) AS dump_idx, max(n) AS matched FROM rd GROUP BY ALL),
fired AS (SELECT series_id, rule_id, dump_idx, matched,
    CASE WHEN matched >= 10 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM rw WHERE matched >= 3)
"""


@query("rule_matches", snap(by_node=True, body=_RULES + "SELECT series_id, dump_idx, name, rule_id, frame FROM rm"))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    return flat(R.rule_matches(d), "series_id", "dump_idx", "name", "rule_id", "frame")


@query("evaluate_rules", snap(by_node=True, body=_RULES + """
SELECT f.series_id, f.rule_id, severity, f.dump_idx, matched,
  CAST(matched AS VARCHAR) || CASE f.rule_id WHEN 'connection-pool-exhaustion' THEN ' threads queue for a pooled connection'
    ELSE ' threads held up by a log appender''s lock' END AS title,
  (SELECT string_agg(name, ',' ORDER BY u) FROM (SELECT name, u FROM rm m WHERE m.series_id = f.series_id AND m.rule_id = f.rule_id AND m.dump_idx = f.dump_idx
     ORDER BY u LIMIT 15)) AS threads FROM fired f"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    r = R.evaluate_rules(d, t.dump, S.series_index(d))
    return flat(r, "series_id", "rule_id", "severity", "dump_idx", "matched", "title", threads=F.array_join("threads", ","))


@query("dry_run_rules", snap(by_node=True, body=_RULES + """
, every AS (SELECT series_id, unnest([""" + ", ".join(f"'{r.rule_id}'" for r in BUNDLED_RULES) + """]) AS rule_id FROM n_dumps)
SELECT series_id, rule_id, severity, matched, CAST(severity IS NOT NULL AS BIGINT) AS fired FROM every LEFT JOIN fired USING (series_id, rule_id)"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    return flat(R.dry_run_rules(d, t.dump, S.series_index(d)), "series_id", "rule_id", "severity", "matched", "fired")


SITE_RULES = (
    RuleEntry("busy-checkout", "{count} in dump {dump}", "WARNING", "look", frames=("Checkout",), states=("RUNNABLE",),
              persist_dumps=3, cpu_delta="spinning"),
    RuleEntry("quiet-workers", "quiet", "INFO", "look", name_regex=r"pool-7-thread-\d+", cpu_delta="zero"),
    RuleEntry("reads", "{count} reads", "WARNING", "look", frames=("socketRead0",), warn_threads=1000),
)


@query("site_rules", snap(by_node=True, body="""
, m AS (SELECT series_id, dump_idx, key, u, 'busy-checkout' AS rule_id FROM snap WHERE et = 'purchase'
  UNION ALL SELECT series_id, dump_idx, key, u, 'quiet-workers' FROM snap WHERE u % 4 = 1
  UNION ALL SELECT series_id, dump_idx, key, u, 'reads' FROM snap WHERE et = 'click'),
rd AS (SELECT series_id, rule_id, dump_idx, count(*) AS n, arg_min(key, u) AS k FROM m GROUP BY ALL),
rw AS (SELECT series_id, rule_id, arg_max(dump_idx, n * 100000 - dump_idx) AS dump_idx, max(n) AS matched, arg_max(k, n * 100000 - dump_idx) AS first_key FROM rd GROUP BY ALL),
isl AS (SELECT series_id, rule_id, key, dump_idx - row_number() OVER (PARTITION BY series_id, rule_id, key ORDER BY dump_idx) AS i FROM m),
pk AS (SELECT series_id, min(key) AS pkey FROM (SELECT series_id, key, i, count(*) AS n FROM isl WHERE rule_id = 'busy-checkout' GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1),
cd AS (SELECT series_id, key, CAST(arg_max(cpu, dump_idx) - arg_min(cpu, dump_idx) AS DOUBLE) / (1000 * date_diff('second', min(day), max(day))) AS ratio
  FROM snap GROUP BY ALL HAVING count(*) > 1)
SELECT series_id, rule_id, 'WARNING' AS severity, dump_idx, matched FROM rw JOIN pk USING (series_id) JOIN cd ON cd.series_id = rw.series_id AND cd.key = pk.pkey
  WHERE rule_id = 'busy-checkout' AND ratio >= 0.70
UNION ALL SELECT rw.series_id, rule_id, 'INFO', dump_idx, matched FROM rw JOIN cd ON cd.series_id = rw.series_id AND cd.key = rw.first_key WHERE rule_id = 'quiet-workers' AND ratio <= 0.05
UNION ALL SELECT series_id, rule_id, CASE WHEN matched < 1000 THEN 'INFO' ELSE 'WARNING' END, dump_idx, matched FROM rw WHERE rule_id = 'reads'"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    r = R.evaluate_rules(d, t.dump, S.series_index(d), SITE_RULES)
    return flat(r, "series_id", "rule_id", "severity", "dump_idx", "matched")


def _rule_table(spark, sf):
    """A rule for every user (by name), every nation (by frame) and every region (by state)."""
    u, n, g = (F.col(c) for c in ("user_id", "n_nationkey", "r_regionkey"))
    none = F.array().cast("array<string>")
    num = u.cast("string")

    def rows(df, kind, k, frames, name, states, persist):
        return df.select(
            F.concat(F.lit(kind), k.cast("string")).alias("rule_id"), F.lit("{count} threads").alias("title"), F.lit("warning").alias("severity"),
            F.lit(None).cast("int").alias("warn_threads"), F.lit(None).cast("int").alias("critical_threads"), F.lit("look").alias("recommendation"),
            frames.alias("frames"), name.cast("string").alias("name_regex"), states.alias("states"), F.lit(None).cast("int").alias("min_threads"),
            persist.cast("int").alias("persist_dumps"), F.lit(None).cast("string").alias("cpu_delta"))

    by_name = rows(
        read(spark, sf, "events").select("user_id").distinct(), "u", u,
        F.when(u % 4 == 3, F.array(F.lit("Checkout"), F.lit("Trail"))).otherwise(none),
        F.when(u % 4 == 0, F.concat(F.lit("http-nio-8080-exec-"), num, F.lit(r"\d*")))
        .when(u % 4 == 1, F.concat(F.lit("pool-7-thread-"), num))
        .when(u % 4 == 2, F.concat(F.lit(r"\[STUCK\] ExecuteThread: '"), num, F.lit("' for queue: 'q'")))
        .otherwise(F.concat(F.lit("WebContainer : "), num)),
        F.when(u % 5 == 0, F.array(F.lit("runnable"))).otherwise(none), F.when(u % 7 == 0, 2))
    part = (n % 3).cast("string")
    by_frame = rows(
        read(spark, sf, "nation"), "n", n,
        F.array(F.when(n % 4 == 0, F.concat(F.lit("web.Page"), part, F.lit(".ren"))).when(n % 4 == 1, F.concat(F.lit("Checkout"), part))
                .when(n % 4 == 2, F.lit("callAppenders")).otherwise(F.concat(F.lit("absent"), part))),
        F.lit(None), F.when(n % 3 == 0, F.array(F.lit("RUNNABLE"))), F.lit(None))
    by_state = rows(read(spark, sf, "region"), "r", g, none, F.lit(None),
                    F.array(F.when(g % 2 == 1, F.lit("BLOCKED")).otherwise(F.lit("WAITING"))), F.lit(None))
    return by_name.unionByName(by_frame).unionByName(by_state)


_TABLE_RULES = """
, users AS (SELECT DISTINCT user_id AS k FROM events),
m AS (
  SELECT s.*, 'u' || CAST(k AS VARCHAR) AS rule_id, CASE WHEN k % 4 = 3 THEN CASE et WHEN 'purchase' THEN r0 ELSE r1 END END AS frame
  FROM snap s JOIN users ON u = k
  WHERE CASE k % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN et = 'error' ELSE et IN ('purchase', 'error') END AND (k % 5 <> 0 OR state = 'RUNNABLE')
  UNION ALL
  SELECT s.*, 'u' || CAST(k AS VARCHAR), NULL FROM snap s JOIN users ON u % 4 = 0 AND k % 4 = 0 AND u > k
    AND starts_with(CAST(u AS VARCHAR), CAST(k AS VARCHAR)) WHERE k % 5 <> 0 OR state = 'RUNNABLE'
  UNION ALL
  SELECT s.*, 'n' || CAST(n_nationkey AS VARCHAR), CASE n_nationkey % 4 WHEN 0 THEN r1 ELSE r0 END FROM snap s JOIN nation ON
    CASE n_nationkey % 4 WHEN 0 THEN et = 'click' AND u % 3 = n_nationkey % 3 WHEN 1 THEN et = 'purchase' AND u % 3 = n_nationkey % 3
      WHEN 2 THEN et = 'error' ELSE false END WHERE n_nationkey % 3 <> 0 OR state = 'RUNNABLE'
  UNION ALL
  SELECT s.*, 'r' || CAST(r_regionkey AS VARCHAR), NULL FROM snap s JOIN region ON state = CASE WHEN r_regionkey % 2 = 1 THEN 'BLOCKED' ELSE 'WAITING' END)
"""


@query("rule_table_matches", snap(by_node=True, body=_TABLE_RULES + "SELECT series_id, dump_idx, name, rule_id, frame FROM m"))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    return flat(R.rule_table_matches(d, _rule_table(spark, sf)), "series_id", "dump_idx", "name", "rule_id", "frame")


@query("rule_table_fired", snap(by_node=True, body=_TABLE_RULES + """
, rd AS (SELECT series_id, rule_id, dump_idx, count(*) AS n FROM m GROUP BY ALL),
rw AS (SELECT series_id, rule_id, arg_max(dump_idx, n * 100000 - dump_idx) AS dump_idx, max(n) AS matched FROM rd GROUP BY ALL),
isl AS (SELECT series_id, rule_id, key, dump_idx - row_number() OVER (PARTITION BY series_id, rule_id, key ORDER BY dump_idx) AS i FROM m),
kept AS (SELECT DISTINCT series_id, rule_id FROM (SELECT series_id, rule_id, key, i FROM isl GROUP BY ALL HAVING count(*) >= 2))
SELECT series_id, rule_id, 'WARNING' AS severity, dump_idx, matched, CAST(matched AS VARCHAR) || ' threads' AS title,
  CASE WHEN needs THEN 'high' ELSE 'medium' END AS confidence
FROM (SELECT *, rule_id[1] = 'u' AND CASE WHEN rule_id[1] = 'u' THEN CAST(rule_id[2:] AS BIGINT) % 7 = 0 ELSE false END AS needs FROM rw)
WHERE NOT needs OR (series_id, rule_id) IN (SELECT (series_id, rule_id) FROM kept)"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    r = R.evaluate_rules(d, t.dump, S.series_index(d), _rule_table(spark, sf))
    return flat(r, "series_id", "rule_id", "severity", "dump_idx", "matched", "title", "confidence")


_MW = """
, sc AS (SELECT series_id, 'WEBLOGIC' AS platform, 0 AS o, 5 AS w, count(*) AS hits FROM snap WHERE u % 4 = 2 GROUP BY 1
  UNION ALL SELECT series_id, 'WEBSPHERE', 1, 5, count(*) FROM snap WHERE u % 4 = 3 GROUP BY 1
  UNION ALL SELECT series_id, 'TOMCAT', 3, 5, count(*) FROM snap WHERE u % 4 = 0 GROUP BY 1),
pf AS (SELECT series_id, arg_min(platform, o) AS platform, 5 AS score, arg_min(hits, o) AS hits FROM sc GROUP BY series_id)
"""


@query("detect_middleware", snap(by_node=True, body=_MW + """
SELECT series_id, platform, score, CASE platform WHEN 'WEBLOGIC' THEN 'names of work manager threads'
  WHEN 'WEBSPHERE' THEN 'web container threads by name' ELSE 'connector worker threads by name' END
  || ' (' || CAST(hits AS VARCHAR) || CASE WHEN hits = 1 THEN ' hit)' ELSE ' hits)' END AS evidence FROM pf"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    return flat(M.detect_middleware(d, t.dump), "series_id", "platform", "score", evidence=F.array_join("evidence", "; "))


@query("middleware_hits", snap(by_node=True, body=_MW + "SELECT series_id, platform, w AS weight, hits FROM sc"))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    return flat(M.middleware_hits(d, t.dump), "series_id", "platform", "weight", "hits")


_HEALTH = """
, ph AS (SELECT series_id, dump_idx, grp, count(*) AS total, count(*) FILTER (cls = 'APPLICATION') AS busy, count(*) FILTER (state = 'BLOCKED') AS blocked,
    count(*) FILTER (mark IN ('[STUCK] ', '[HOGGING] ')) AS stuck, count(*) FILTER (mark = '[STANDBY] ') AS standby,
    CAST(count(*) FILTER (cls = 'APPLICATION') >= count(*) AND count(*) FILTER (mark = '[STANDBY] ') = 0 AS BIGINT) AS saturated
  FROM (SELECT *, CASE u % 4 WHEN 2 THEN 'q' WHEN 0 THEN 'http-nio-8080' WHEN 3 THEN 'WebContainer' END AS grp FROM snap) WHERE grp IS NOT NULL GROUP BY ALL)
"""


def _group():
    n = F.col("name")
    from stackscope.functions.names import connector_of, websphere_pool_of
    return F.coalesce(queue_of(n), connector_of(n), websphere_pool_of(n))


@query("pool_health", snap(body=_HEALTH + "SELECT dump_idx, grp, total, busy, blocked, stuck, standby, saturated FROM ph"))
def _(spark, sf):
    _t, d = snapshot(spark, sf)
    return flat(M.pool_health(d, _group()), "dump_idx", "grp", "total", "busy", "blocked", "stuck", "standby", "saturated")


@query("pool_health_summary", snap(by_node=True, body=_HEALTH + """
SELECT series_id, grp, arg_max(dump_idx, busy * 1000000 + blocked * 1000 - dump_idx) AS worst_dump,
  arg_max(total, busy * 1000000 + blocked * 1000 - dump_idx) AS total, max(busy) AS busy,
  arg_max(saturated, busy * 1000000 + blocked * 1000 - dump_idx) AS saturated, max(blocked) AS max_blocked, count(*) AS snapshots,
  CAST(min(saturated) = 1 AND count(*) >= 2 AS BIGINT) AS saturated_throughout FROM ph GROUP BY series_id, grp"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    return flat(M.pool_health_summary(M.pool_health(d, _group())), "series_id", "grp", "worst_dump", "total", "busy", "saturated",
                "max_blocked", "snapshots", "saturated_throughout")


@query("busy_threads", snap(body="""
SELECT * FROM (SELECT dump_idx, name, row_number() OVER (PARTITION BY dump_idx ORDER BY u) AS rank FROM snap WHERE u % 4 = 2 AND cls = 'APPLICATION') WHERE rank <= 10"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf)
    return flat(M.busy_threads(d, queue_of(F.col("name"))), "dump_idx", "name", "rank")


@query("middleware_panel", snap(by_node=True, body=_MW + """
SELECT s.series_id, dump_idx, CASE platform WHEN 'WEBLOGIC' THEN 'queue ''q''' WHEN 'TOMCAT' THEN 'http-nio-8080' ELSE 'WebContainer' END AS grp, count(*) AS total,
  count(*) FILTER (cls = 'APPLICATION') AS busy, count(*) FILTER (state = 'BLOCKED') AS blocked
FROM snap s JOIN pf USING (series_id) WHERE u % 4 = CASE platform WHEN 'WEBLOGIC' THEN 2 WHEN 'TOMCAT' THEN 0 ELSE 3 END GROUP BY ALL"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    return flat(M.middleware_panel(d, M.detect_middleware(d, t.dump)), "series_id", "dump_idx", "grp", "total", "busy", "blocked")


def _context(spark, sf, by_node, **kw):
    t, d = snapshot(spark, sf, by_node)
    none = spark.createDataFrame([], "series_id string")
    base = dict(dump=t.dump, thread=d, occ=S.series_index(d), verdicts=none, cycles=none, blockers=none, trend=none, platform=none)
    return D.Context(**{**base, **{k: v(t, d) if callable(v) else v for k, v in kw.items()}})


def _finding_rows(df, *evidence):
    return flat(df, "series_id", "id", "severity", **{k: F.col("evidence")[k] for k in evidence})


@query("finding_marked_threads", snap(by_node=True, body="""
, m AS (SELECT series_id, name, mark, count(*) AS n FROM snap WHERE mark IN ('[STUCK] ', '[HOGGING] ') GROUP BY ALL)
SELECT series_id, CASE mark WHEN '[STUCK] ' THEN 'weblogic-stuck' ELSE 'weblogic-hogging' END AS id, CASE mark WHEN '[STUCK] ' THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  'WebLogic marked ' || CAST(count(*) AS VARCHAR) || ' thread(s) ' || trim(mark) AS title FROM m GROUP BY series_id, mark"""))
def _(spark, sf):
    c = _context(spark, sf, True)
    return flat(D.weblogic_stuck(c).unionByName(D.weblogic_hogging(c)), "series_id", "id", "severity", "title")


@query("finding_stuck_threads", snap(body="," + VERDICTS + """
SELECT CASE kind WHEN 'NATIVE_WAIT' THEN 'idle-native-wait' ELSE 'stuck-thread' END AS id, severity, norm AS thread,
  CAST(from_dump AS VARCHAR) || '..' || CAST(to_dump AS VARCHAR) AS dumps, CASE WHEN victims > 0 THEN CAST(victims AS VARCHAR) END AS victims FROM judged"""))
def _(spark, sf):
    c = _context(spark, sf, False, verdicts=verdicts)
    return _finding_rows(D.stuck_thread(c), "thread", "dumps", "victims").drop("series_id")


@query("finding_network_hang", snap(by_node=True, body="," + VERDICTS + """
, fz AS (SELECT j.series_id, count(*) AS frozen, bool_or(EXISTS (SELECT 1 FROM snap s WHERE s.series_id = j.series_id AND s.norm = j.norm AND s.mark IN ('[STUCK] ', '[HOGGING] '))) AS m
  FROM judged j WHERE et = 'click' GROUP BY 1),
pd AS (SELECT series_id, dump_idx, count(*) AS n FROM snap WHERE et = 'click' GROUP BY ALL),
w AS (SELECT series_id, max(n) AS worst, arg_max(dump_idx, n * 100000 - dump_idx) AS di FROM pd GROUP BY 1)
SELECT series_id, 'network-hang' AS id, CASE WHEN coalesce(m, false) OR worst >= 5 THEN 'CRITICAL' WHEN frozen IS NULL THEN 'INFO' ELSE 'WARNING' END AS severity,
  CAST(di AS VARCHAR) AS dump, CAST(worst AS VARCHAR) AS "runnableInSocketRead", CAST(coalesce(frozen, 0) AS VARCHAR) AS "frozenAcrossDumps"
FROM w LEFT JOIN fz USING (series_id)"""))
def _(spark, sf):
    c = _context(spark, sf, True, verdicts=verdicts)
    return _finding_rows(D.network_hang(c), "dump", "runnableInSocketRead", "frozenAcrossDumps")


@query("finding_top_blocker", snap(by_node=True, body="," + CLOSURE + """
, b AS (SELECT series_id, dump_idx, holder, direct, transitive, row_number() OVER (PARTITION BY series_id ORDER BY transitive DESC, dump_idx, first_ord) AS r
  FROM direct JOIN victims USING (series_id, dump_idx, holder))
SELECT series_id, 'top-blocker' AS id, CASE WHEN transitive >= 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CAST(dump_idx AS VARCHAR) AS dump,
  holder AS thread, CAST(direct AS VARCHAR) AS "directVictims", CAST(transitive AS VARCHAR) AS "transitiveVictims" FROM b WHERE r = 1 AND transitive >= 2"""))
def _(spark, sf):
    c = _context(spark, sf, True, blockers=lambda t, d: L.top_blockers(L.waits_for(d)))
    return _finding_rows(D.top_blocker(c), "dump", "thread", "directVictims", "transitiveVictims")


@query("finding_pool_sizing", """
WITH o AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS day, 'pool-' || CAST(o_custkey % 60 AS VARCHAR) AS pool,
    CASE WHEN o_custkey % 60 >= 20 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS st FROM orders),
s AS (SELECT series_id, pool, day, count(*) AS size, count(*) FILTER (st <> 'O') AS busy, count(*) FILTER (st = 'P') AS blocked FROM o GROUP BY ALL),
u AS (SELECT series_id, pool, 100.0 * sum(busy) / sum(size) AS pct, max(size) AS mx, sum(blocked) AS b FROM s GROUP BY ALL)
SELECT series_id, 'pool-sizing' AS id, 'INFO' AS severity, pool, CASE WHEN pct >= 90 AND b > 0 THEN 'increase' ELSE 'oversized' END AS advice FROM u
WHERE (pct >= 90 AND b > 0) OR (pct <= 10 AND mx >= 20)""")
def _(spark, sf):
    """Orders as threads: open ones idle, pending ones blocked; in most pools open orders are at work, too."""
    from stackscope.operators.derive import derive
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("thread_ord"), "o_custkey", "o_orderstatus", "o_orderpriority")
    dump, t = order_threads(spark, sf)
    idle = F.struct(*[F.lit(x).alias(n) for x, n in (
        ("java.util.TimerThread.mainLoop(T.java:1)", "raw"), ("java.util.TimerThread", "cls"), ("mainLoop", "method"), ("T.java:1", "loc"),
        ("java.util.TimerThread.mainLoop", "sig"))], F.lit(False).alias("native"))
    base = t.drop("cls_kind", "cls_label", "is_vm", "key", "norm_name", "pool", "activity", "category", "stack_hash", "fp", "wait_lock")
    st = F.when((F.col("o_custkey") % 60 >= 20) & (F.col("o_orderstatus") == "O"), "F").otherwise(F.col("o_orderstatus"))
    j = base.join(o.select("thread_ord", "o_custkey", "o_orderstatus"), "thread_ord") \
        .withColumn("frames", F.when(st == "O", F.array(idle)).otherwise(F.col("frames"))) \
        .withColumn("state", F.when(st == "P", "BLOCKED").otherwise("RUNNABLE"))
    c = _context(spark, sf, False, dump=dump, thread=derive(j))
    return _finding_rows(D.pool_sizing(c), "pool", "advice")


@query("finding_thread_leak", snap(body="""
, o AS (SELECT 'all' AS s, user_id % 11 AS g, CAST(ts AS DATE) AS day, event_id FROM events),
c AS (SELECT g, x.d, (SELECT count(*) FROM events e WHERE e.user_id % 11 = g AND CAST(e.ts AS DATE) <= x.day) AS n FROM (SELECT DISTINCT g FROM o), (SELECT dump_idx AS d, day FROM days) x),
z AS (SELECT *, lag(n) OVER (PARTITION BY g ORDER BY d) AS p FROM c)
SELECT 'thread-leak' AS id, 'WARNING' AS severity, 'pool-' || CAST(g AS VARCHAR) AS pool, CAST(arg_max(n, d) - arg_min(n, d) AS VARCHAR) AS growth
FROM z GROUP BY g HAVING count(*) >= 3 AND coalesce(bool_and(n >= p), true) AND bool_or(n > p) AND arg_max(n, d) - arg_min(n, d) >= 5"""))
def _(spark, sf):
    """A pool that keeps every thread it ever started: the running number of events per user group."""
    from pyspark.sql import Window
    t, d = snapshot(spark, sf)
    days = t.dump.select("series_id", "dump_idx", F.to_date("ts").alias("day"))
    per = read(spark, sf, "events").select((F.col("user_id") % 11).alias("g"), F.to_date("ts").alias("day")).groupBy("g", "day").agg(F.count("*").alias("n")) \
        .join(days, "day")
    w = Window.partitionBy("g").orderBy("dump_idx")
    total = per.withColumn("n", F.sum("n").over(w))
    rise = F.coalesce(F.bool_and(F.col("n") >= F.col("_p")), F.lit(True))
    shape = total.withColumn("_p", F.lag("n").over(w)).groupBy("series_id", "g").agg(
        F.min_by("n", "dump_idx").alias("first_count"), F.max_by("n", "dump_idx").alias("last_count"), rise.alias("_up"), F.count("*").alias("_n"))
    trend = shape.select("series_id", F.concat(F.lit("pool-"), F.col("g").cast("string")).alias("pool"), "first_count", "last_count",
                         (F.col("last_count") - F.col("first_count")).alias("growth"),
                         (F.col("_up") & (F.col("_n") >= 3) & (F.col("last_count") - F.col("first_count") >= 5)).alias("leak_suspect"))
    c = _context(spark, sf, False, trend=trend)
    return _finding_rows(D.thread_leak(c), "pool", "growth").drop("series_id")


@query("finding_deadlocks", CHAIN + CLOSURE + "," + CYCLES + """
SELECT 'all' AS series_id, 'deadlock' AS id, 'CRITICAL' AS severity, CAST(dump_idx AS VARCHAR) AS dump,
  '["' || string_agg(node, '","' ORDER BY node) || '"]' AS threads, 'wait-for-graph' AS source FROM ids GROUP BY dump_idx, cycle_id""")
def _(spark, sf):
    cycles = L.deadlock_cycles(L.deadlock_members(L.waits_for(chain_threads(spark, sf))))
    c = _context(spark, sf, False, cycles=cycles)
    return _finding_rows(D.deadlock(c), "dump", "threads", "source")


@query("finding_starved_pools", snap(by_node=True, body=_MW + _HEALTH + """
, sm AS (SELECT series_id, grp, arg_max(dump_idx, busy * 1000000 + blocked * 1000 - dump_idx) AS d, arg_max(total, busy * 1000000 + blocked * 1000 - dump_idx) AS total,
    arg_max(saturated, busy * 1000000 + blocked * 1000 - dump_idx) AS sat, max(blocked) AS mb, min(saturated) = 1 AND count(*) >= 2 AS always FROM ph GROUP BY ALL)
SELECT series_id, CASE platform WHEN 'WEBLOGIC' THEN 'weblogic-thread-starvation' WHEN 'TOMCAT' THEN 'tomcat-connector-exhaustion' ELSE 'websphere-webcontainer-saturation' END AS id,
  CASE WHEN always OR mb >= 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CAST(d AS VARCHAR) AS dump, CAST(total AS VARCHAR) AS threads, CAST(mb AS VARCHAR) AS blocked
FROM sm JOIN pf USING (series_id) WHERE sat = 1 AND total >= 8 AND grp = CASE platform WHEN 'WEBLOGIC' THEN 'q' WHEN 'TOMCAT' THEN 'http-nio-8080' ELSE 'WebContainer' END"""))
def _(spark, sf):
    c = _context(spark, sf, True, platform=lambda t, d: M.detect_middleware(d, t.dump))
    f = D.weblogic_thread_starvation(c).unionByName(D.tomcat_connector_exhaustion(c)).unionByName(D.websphere_webcontainer_saturation(c))
    return _finding_rows(f, "dump", "threads", "blocked")


@query("middleware_detectors", """
WITH t AS (SELECT o_orderpriority AS series_id, o_orderkey AS k, date_trunc('month', o_orderdate) AS day, o_custkey % 5 AS c, o_orderstatus AS st FROM orders),
d AS (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS i FROM (SELECT DISTINCT series_id, day FROM t)),
x AS (SELECT t.*, i FROM t JOIN d USING (series_id, day)),
n AS (SELECT series_id, count(*) AS n FROM d GROUP BY 1)
SELECT series_id, 'tomcat-poller-blocked' AS id, 'CRITICAL' AS severity, 'http-nio-' || CAST(c AS VARCHAR) AS what, count(*) AS n FROM x WHERE st = 'P' AND c IN (1, 2) GROUP BY series_id, c
UNION ALL SELECT x.series_id, 'tomcat-background-processor-blocked', CASE WHEN count(*) >= greatest(2, max(n) // 2) THEN 'CRITICAL' ELSE 'WARNING' END,
  arg_max('ContainerBackgroundProcessor[' || CAST(k AS VARCHAR) || ']', i * 100000000 + k), count(*) FROM x JOIN n USING (series_id) WHERE st = 'P' AND c = 3 GROUP BY x.series_id""")
def _(spark, sf):
    """Orders as connector support threads and background processors, pending ones BLOCKED."""
    dump, t = order_threads(spark, sf)
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("thread_ord"), (F.col("o_custkey") % 5).alias("c"), "o_orderstatus")
    k, c5 = F.col("thread_ord").cast("string"), F.col("c")
    j = t.join(o, "thread_ord").withColumn("name", F.when(c5.isin(1, 2), F.concat(F.lit("http-nio-"), c5.cast("string"), F.lit("-Poller")))
                                           .when(c5 == 3, F.concat(F.lit("ContainerBackgroundProcessor["), k, F.lit("]")))
                                           .otherwise(F.concat(F.lit("worker-"), k))) \
        .withColumn("state", F.when(F.col("o_orderstatus") == "P", "BLOCKED").otherwise("RUNNABLE"))
    platform = dump.select("series_id").distinct().withColumn("platform", F.lit("TOMCAT"))
    ctx = _context(spark, sf, False, dump=dump, thread=j, platform=platform)
    a = D.tomcat_poller_blocked(ctx).select("series_id", "id", "severity", F.col("evidence")["connector"].alias("what"), F.col("evidence")["threads"].alias("n"))
    b = D.tomcat_background_processor_blocked(ctx).select("series_id", "id", "severity", F.col("evidence")["thread"].alias("what"), F.col("evidence")["blockedDumps"].alias("n"))
    return a.unionByName(b).withColumn("n", F.col("n").cast("bigint"))


@query("finding_muxer_and_oom", """
WITH x AS (SELECT o_orderpriority AS series_id, o_orderkey AS k, date_trunc('month', o_orderdate) AS day, o_orderstatus AS st FROM orders WHERE o_custkey % 4 = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS i FROM (SELECT DISTINCT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS day FROM orders)),
p AS (SELECT series_id, i, count(*) AS n, count(*) FILTER (st = 'P') AS b FROM x JOIN d USING (series_id, day) GROUP BY ALL),
s AS (SELECT series_id, max(n) AS m, max(b) AS b, arg_max(i, b * 100000 - i) AS i FROM p GROUP BY 1)
SELECT series_id, 'weblogic-muxer-blocked' AS id, CASE WHEN b >= m THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CAST(i AS VARCHAR) AS dump FROM s WHERE b > 0
UNION ALL SELECT series_id, 'javacore-oom-trigger', 'CRITICAL', CAST(min(i) AS VARCHAR) FROM d WHERE i % 7 = 3 GROUP BY series_id""")
def _(spark, sf):
    dump, t = order_threads(spark, sf)
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("thread_ord"), "o_custkey", "o_orderstatus")
    k = F.col("thread_ord").cast("string")
    j = t.join(o, "thread_ord").withColumn("name", F.when(F.col("o_custkey") % 4 == 0, F.concat(
        F.lit("ExecuteThread: '"), k, F.lit("' for queue: 'weblogic.socket.Muxer'"))).otherwise(F.col("name"))) \
        .withColumn("state", F.when(F.col("o_orderstatus") == "P", "BLOCKED").otherwise("RUNNABLE"))
    dump = dump.withColumn("dump_reason", F.when(F.col("dump_idx") % 7 == 3, "Dump Event systhrow, java/lang/OutOfMemoryError").otherwise("user"))
    one = lambda p: _context(spark, sf, False, dump=dump, thread=j,
                             platform=dump.select("series_id").distinct().withColumn("platform", F.lit(p)))
    return _finding_rows(D.weblogic_muxer_blocked(one("WEBLOGIC")).unionByName(D.javacore_oom_trigger(one("WEBSPHERE"))), "dump")


@query("finding_finalizer", """
WITH t AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS day, o_orderkey AS k, o_orderstatus AS st FROM orders),
d AS (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS i FROM (SELECT DISTINCT series_id, day FROM t)),
f AS (SELECT series_id, i, arg_min(st, k) AS st FROM t JOIN d USING (series_id, day) GROUP BY ALL)
SELECT series_id, 'finalizer-backlog' AS id, CASE WHEN count(*) FILTER (st <> 'F') >= greatest(2, count(*) // 2) THEN 'WARNING' ELSE 'INFO' END AS severity,
  CAST(count(*) FILTER (st <> 'F') AS VARCHAR) AS "busyDumps" FROM f GROUP BY series_id HAVING count(*) FILTER (st <> 'F') > 0""")
def _(spark, sf):
    """The first order of a month stands for that dump's Finalizer; finished orders are idle ones."""
    dump, t = order_threads(spark, sf)
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("thread_ord"), "o_orderstatus")
    frame = lambda cls, m: F.array(F.struct(F.lit(f"{cls}.{m}(X.java:1)").alias("raw"), F.lit(cls).alias("cls"), F.lit(m).alias("method"),
                                            F.lit("X.java:1").alias("loc"), F.lit(f"{cls}.{m}").alias("sig"), F.lit(False).alias("native")))
    done = F.col("o_orderstatus") == "F"
    j = t.join(o, "thread_ord").withColumn("name", F.lit("Finalizer")).withColumn("state", F.when(done, "WAITING").otherwise("RUNNABLE")) \
        .withColumn("frames", F.when(done, frame("java.lang.ref.ReferenceQueue", "remove")).otherwise(frame("com.shop.Handle", "finalize")))
    return _finding_rows(D.finalizer_backlog(_context(spark, sf, False, dump=dump, thread=j)), "busyDumps")


_PAUSES = """
, pw AS (SELECT 'n' || CAST(user_id % 10 AS VARCHAR) AS series_id, ts AS s, ts + to_microseconds(CAST(round(value * 100) AS BIGINT) * 600000) AS e,
    CAST(CAST(round(value * 100) AS BIGINT) * 600 AS DOUBLE) AS ms, user_id % 3 AS c FROM events WHERE event_type = 'error')
"""


@query("pause_covers", snap(by_node=True, body=_PAUSES + """
SELECT event_id, CAST(EXISTS (SELECT 1 FROM pw WHERE pw.series_id = 'n' || CAST(v.user_id % 10 AS VARCHAR)
  AND v.ts >= pw.s - INTERVAL 2 SECOND AND v.ts <= pw.e + INTERVAL 2 SECOND) AS BIGINT) AS covered FROM events v WHERE event_type <> 'error'"""))
def _(spark, sf):
    p = read(spark, sf, "events").filter("event_type <> 'error'").select(
        F.concat(F.lit("n"), (F.col("user_id") % 10).cast("string")).alias("series_id"), "event_id", "ts")
    return flat(P.pause_covers(p, error_pauses(spark, sf, True)), "event_id", "covered")


@query("reattribute_to_pauses", snap(by_node=True, body="," + VERDICTS.replace("HAVING count(*) >= 3", "HAVING count(*) >= 2") + _PAUSES + """
, cov AS (SELECT d.series_id, d.dump_idx, EXISTS (SELECT 1 FROM pw WHERE pw.series_id = d.series_id
    AND CAST(d.day AS TIMESTAMP) >= pw.s - INTERVAL 2 SECOND AND CAST(d.day AS TIMESTAMP) <= pw.e + INTERVAL 2 SECOND) AS c FROM days d),
r AS (SELECT j.*, (SELECT bool_and(c) FROM cov WHERE cov.series_id = j.series_id AND cov.dump_idx BETWEEN j.from_dump AND j.to_dump) AS hit FROM judged j)
SELECT series_id, key, from_dump, to_dump, CASE WHEN hit THEN 'DISCARDED' ELSE kind END AS kind, CASE WHEN NOT hit THEN severity END AS severity, CAST(hit AS BIGINT) AS reattributed FROM r"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    v = P.reattribute_to_pauses(verdicts(t, d, 2), t.dump, error_pauses(spark, sf, True))
    return flat(v, "series_id", "key", "from_dump", "to_dump", "kind", "severity", "reattributed")


_AXIS = """
, dd AS (SELECT series_id, dump_idx, CAST(epoch_ms(CAST(day AS TIMESTAMP)) AS BIGINT) AS t,
    lead(CAST(epoch_ms(CAST(day AS TIMESTAMP)) AS BIGINT)) OVER (PARTITION BY series_id ORDER BY dump_idx) AS nx FROM days),
ed AS (SELECT series_id, min(t) AS t0, max(t) AS t1, max(dump_idx) AS n FROM dd GROUP BY 1)
"""


@query("axis_position", snap(by_node=True, body=_AXIS + """
, i AS (SELECT event_id, 'n' || CAST(user_id % 10 AS VARCHAR) AS series_id, epoch_us(ts) // 1000 AS t FROM events)
SELECT event_id, CASE WHEN i.t <= t0 THEN CASE WHEN i.t >= t0 - 60000 THEN -0.4 END WHEN i.t > t1 THEN CASE WHEN i.t <= t1 + 60000 THEN n + 0.4 END
  ELSE dd.dump_idx + CAST(i.t - dd.t AS DOUBLE) / greatest(dd.nx - dd.t, 1) END AS position
FROM i JOIN ed USING (series_id) LEFT JOIN dd ON dd.series_id = i.series_id AND dd.t < i.t AND i.t <= dd.nx"""))
def _(spark, sf):
    t = event_tables(spark, sf, True)
    i = read(spark, sf, "events").select(F.concat(F.lit("n"), (F.col("user_id") % 10).cast("string")).alias("series_id"), "event_id", "ts")
    return flat(P.axis_position(i, t.dump), "event_id", "position")


@query("pause_bands", snap(by_node=True, body=_PAUSES + _AXIS + """
, b AS (SELECT series_id, s, ms, c, epoch_us(s) // 1000 AS a, epoch_us(s + to_microseconds(CAST(greatest(ms, 500) * 1000 AS BIGINT))) // 1000 AS z FROM pw),
p AS (SELECT b.*, CASE WHEN a <= t0 THEN CASE WHEN a >= t0 - 60000 THEN -0.4 END WHEN a > t1 THEN CASE WHEN a <= t1 + 60000 THEN n + 0.4 END
    ELSE d1.dump_idx + CAST(a - d1.t AS DOUBLE) / greatest(d1.nx - d1.t, 1) END AS fp,
  CASE WHEN z <= t0 THEN CASE WHEN z >= t0 - 60000 THEN -0.4 END WHEN z > t1 THEN CASE WHEN z <= t1 + 60000 THEN n + 0.4 END
    ELSE d2.dump_idx + CAST(z - d2.t AS DOUBLE) / greatest(d2.nx - d2.t, 1) END AS tp
  FROM b JOIN ed USING (series_id) LEFT JOIN dd d1 ON d1.series_id = b.series_id AND d1.t < a AND a <= d1.nx LEFT JOIN dd d2 ON d2.series_id = b.series_id AND d2.t < z AND z <= d2.nx),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s) AS rn FROM p WHERE fp IS NOT NULL AND tp IS NOT NULL)
SELECT series_id, epoch_us(s) AS start_us, 'cause ' || CAST(c AS VARCHAR) AS cause, fp AS from_pos, greatest(tp, fp + 0.03) AS to_pos FROM r WHERE rn <= 80"""))
def _(spark, sf):
    t = event_tables(spark, sf, True)
    b = P.pause_bands(t.dump, error_pauses(spark, sf, True))
    return flat(b, "series_id", "cause", "from_pos", "to_pos", start_us=F.unix_micros("start_ts"))


@query("finding_pauses", snap(by_node=True, body=_PAUSES + """
, m AS (SELECT series_id, max(ms) AS worst FROM pw GROUP BY 1),
a AS (SELECT series_id, count(*) AS n, sum(ms) AS stopped, greatest(1, date_diff('microsecond', min(s), arg_max(e, s)) // 1000) AS win FROM pw GROUP BY 1)
SELECT series_id, 'long-gc-pause' AS id, CASE WHEN worst >= 5000 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CAST(NULL AS VARCHAR) AS "pauseCount", CAST(NULL AS VARCHAR) AS "windowMs" FROM m WHERE worst >= 1000
UNION ALL SELECT series_id, 'frequent-safepoints', 'WARNING', CAST(n AS VARCHAR), CAST(win AS VARCHAR) FROM a WHERE 100.0 * stopped / win >= 10 AND n >= 5"""))
def _(spark, sf):
    c = _context(spark, sf, True, pauses=error_pauses(spark, sf, True))
    return _finding_rows(D.long_gc_pause(c).unionByName(D.frequent_safepoints(c)), "pauseCount", "windowMs")


def _all_findings(spark, sf):
    t = event_tables(spark, sf, True)
    return analyze(t, pauses=error_pauses(spark, sf, True)).findings


#: every detector over the nodes; those that are not here (Finalizer, muxers, pollers, virtual threads, memory) meet no thread of the snapshot
_FINDINGS = "," + VERDICTS + _MW + _HEALTH + _PAUSES + _RULES + """
, cov AS (SELECT d.series_id, d.dump_idx, EXISTS (SELECT 1 FROM pw WHERE pw.series_id = d.series_id
    AND CAST(d.day AS TIMESTAMP) >= pw.s - INTERVAL 2 SECOND AND CAST(d.day AS TIMESTAMP) <= pw.e + INTERVAL 2 SECOND) AS c FROM days d),
left_over AS (SELECT * FROM judged j WHERE NOT (SELECT bool_and(c) FROM cov WHERE cov.series_id = j.series_id AND cov.dump_idx BETWEEN j.from_dump AND j.to_dump)),
ring AS (SELECT DISTINCT series_id, dump_idx, node FROM reach WHERE node = anc),
ring_id AS (SELECT a.series_id, a.dump_idx, a.node, min(r.anc) AS cycle_id FROM ring a JOIN reach r USING (series_id, dump_idx, node)
  JOIN ring b ON b.series_id = a.series_id AND b.dump_idx = a.dump_idx AND b.node = r.anc GROUP BY ALL),
mk AS (SELECT series_id, name, norm, mark FROM snap WHERE mark IN ('[STUCK] ', '[HOGGING] ') GROUP BY ALL),
fz AS (SELECT series_id, count(*) AS frozen, bool_or(norm IN (SELECT norm FROM mk WHERE mk.series_id = l.series_id)) AS marked FROM left_over l WHERE et = 'click' GROUP BY 1),
sock AS (SELECT series_id, max(n) AS worst FROM (SELECT series_id, dump_idx, count(*) AS n FROM snap WHERE et = 'click' GROUP BY ALL) GROUP BY 1),
tb AS (SELECT series_id, holder, transitive, row_number() OVER (PARTITION BY series_id ORDER BY transitive DESC, dump_idx, first_ord) AS k
  FROM direct JOIN victims USING (series_id, dump_idx, holder)),
lp AS (SELECT series_id, ms, c, row_number() OVER (PARTITION BY series_id ORDER BY ms DESC, s, c) AS k FROM pw WHERE ms >= 1000),
sp AS (SELECT series_id, count(*) AS n, 100.0 * sum(ms) / greatest(1, date_diff('microsecond', min(s), arg_max(e, s)) // 1000) AS pct FROM pw GROUP BY 1),
grid AS (SELECT d.series_id, d.dump_idx, p.pool, (SELECT count(*) FROM snap s WHERE s.series_id = d.series_id AND s.dump_idx = d.dump_idx AND s.pool = p.pool) AS n
  FROM days d JOIN (SELECT DISTINCT series_id, pool FROM snap) p USING (series_id)),
gp AS (SELECT *, lag(n) OVER (PARTITION BY series_id, pool ORDER BY dump_idx) AS p FROM grid),
tl AS (SELECT series_id, pool, arg_min(n, dump_idx) AS n0, arg_max(n, dump_idx) AS n1 FROM gp GROUP BY ALL
  HAVING count(*) >= 3 AND bool_and(coalesce(n >= p, true)) AND bool_or(n > p) AND arg_max(n, dump_idx) - arg_min(n, dump_idx) >= 5),
pu AS (SELECT series_id, pool, 100.0 * sum(busy) / sum(size) AS pct, max(size) AS mx, sum(b) AS b FROM (
    SELECT series_id, dump_idx, pool, count(*) AS size, count(*) FILTER (cls = 'APPLICATION') AS busy, count(*) FILTER (state = 'BLOCKED') AS b FROM snap GROUP BY ALL)
  WHERE series_id IN (SELECT series_id FROM n_dumps WHERE n >= 2) GROUP BY ALL),
sm AS (SELECT series_id, grp, arg_max(total, busy * 1000000 + blocked * 1000 - dump_idx) AS total, arg_max(saturated, busy * 1000000 + blocked * 1000 - dump_idx) AS sat,
    max(blocked) AS mb, min(saturated) = 1 AND count(*) >= 2 AS always FROM ph GROUP BY ALL),
f AS (
  SELECT series_id, 10 AS o, 'deadlock' AS id, 'CRITICAL' AS severity, 'Deadlock of ' || count(*) || ' threads' AS title, 'high' AS confidence, '' AS tie
    FROM ring_id GROUP BY series_id, dump_idx, cycle_id
  UNION ALL SELECT series_id, CASE mark WHEN '[STUCK] ' THEN 20 ELSE 21 END, CASE mark WHEN '[STUCK] ' THEN 'weblogic-stuck' ELSE 'weblogic-hogging' END,
    CASE mark WHEN '[STUCK] ' THEN 'CRITICAL' ELSE 'WARNING' END, 'WebLogic marked ' || count(*) || ' thread(s) ' || trim(mark), 'high', '' FROM mk GROUP BY series_id, mark
  UNION ALL SELECT series_id, 30, CASE kind WHEN 'NATIVE_WAIT' THEN 'idle-native-wait' ELSE 'stuck-thread' END, severity,
    CASE kind WHEN 'NATIVE_WAIT' THEN 'Persistent native wait: ' WHEN 'SPINNING' THEN 'Spinning thread: '
      WHEN 'BLOCKED_CHAIN' THEN 'Blocked for ' || run_length || ' dumps: ' ELSE 'Frozen for ' || run_length || ' dumps: ' END || norm, confidence, from_dump || '..' || to_dump FROM left_over
  UNION ALL SELECT series_id, 40, 'network-hang', CASE WHEN coalesce(marked, false) OR worst >= 5 THEN 'CRITICAL' WHEN frozen IS NULL THEN 'INFO' ELSE 'WARNING' END,
    'Threads in blocking socket reads' || CASE WHEN frozen IS NULL THEN '' ELSE ' across dumps' END, CASE WHEN frozen IS NULL THEN 'low' ELSE 'high' END, '' FROM sock LEFT JOIN fz USING (series_id)
  UNION ALL SELECT series_id, 60, 'top-blocker', CASE WHEN transitive >= 5 THEN 'CRITICAL' ELSE 'WARNING' END, '"' || holder || '" holds up ' || transitive || ' thread(s)', 'high', ''
    FROM tb WHERE k = 1 AND transitive >= 2
  UNION ALL SELECT series_id, 70, 'long-gc-pause', CASE WHEN ms >= 5000 THEN 'CRITICAL' ELSE 'WARNING' END,
    'Stop-the-world pause of ' || CAST(round(ms) AS BIGINT) || ' ms (cause ' || c || ')', 'high', '' FROM lp WHERE k = 1
  UNION ALL SELECT series_id, 71, 'frequent-safepoints', 'WARNING', 'Application stopped ' || format('{:,.1f}', pct) || '% of the time (' || n || ' pauses)', 'high', '' FROM sp WHERE pct >= 10 AND n >= 5
  UNION ALL SELECT series_id, 80, 'thread-leak', 'WARNING', 'Pool "' || pool || '" only grows: ' || n0 || ' to ' || n1, 'medium', '' FROM tl
  UNION ALL SELECT series_id, 90, 'pool-sizing', 'INFO', 'Pool "' || pool || '" is ' || CAST(round(pct) AS BIGINT)
    || CASE WHEN pct >= 90 AND b > 0 THEN '% busy with blocked work' ELSE '% busy at size ' || mx END, 'medium', '' FROM pu WHERE (pct >= 90 AND b > 0) OR (pct <= 10 AND mx >= 20)
  UNION ALL SELECT series_id, 100, rule_id, severity, matched || CASE rule_id WHEN 'connection-pool-exhaustion' THEN ' threads queue for a pooled connection'
    ELSE ' threads held up by a log appender''s lock' END, 'medium', '' FROM fired
  UNION ALL SELECT series_id, CASE platform WHEN 'WEBLOGIC' THEN 120 WHEN 'TOMCAT' THEN 130 ELSE 140 END,
    CASE platform WHEN 'WEBLOGIC' THEN 'weblogic-thread-starvation' WHEN 'TOMCAT' THEN 'tomcat-connector-exhaustion' ELSE 'websphere-webcontainer-saturation' END,
    CASE WHEN always OR mb >= 5 THEN 'CRITICAL' ELSE 'WARNING' END, CASE platform WHEN 'WEBLOGIC' THEN 'WebLogic queue ' WHEN 'TOMCAT' THEN 'Tomcat connector ' ELSE 'WebSphere pool ' END
      || grp || ': all ' || total || ' workers busy' || CASE WHEN always THEN ' in every dump' ELSE '' END, CASE WHEN always THEN 'high' ELSE 'medium' END, ''
    FROM sm JOIN pf USING (series_id) WHERE sat = 1 AND total >= 8 AND grp = CASE platform WHEN 'WEBLOGIC' THEN 'q' WHEN 'TOMCAT' THEN 'http-nio-8080' ELSE 'WebContainer' END)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, o, title, tie) AS rank,
  id, severity, title, confidence FROM f"""


@query("findings", snap(by_node=True, body=_FINDINGS))
def _(spark, sf):
    """Every detector over ten nodes, ranked."""
    return flat(_all_findings(spark, sf), "series_id", "rank", "id", "severity", "title", "confidence")


def _rule_findings(spark, sf):
    """Findings of the rules and the marked threads, whose rows SQL can also give."""
    c = _context(spark, sf, True)
    return D.rank_findings(D.run_detectors(c, ["rules", "weblogic-stuck", "weblogic-hogging"]))


_RANKED = _RULES + """
, m AS (SELECT series_id, name, mark FROM snap WHERE mark IN ('[STUCK] ', '[HOGGING] ') GROUP BY ALL),
f AS (SELECT series_id, CASE mark WHEN '[STUCK] ' THEN 'weblogic-stuck' ELSE 'weblogic-hogging' END AS id, CASE mark WHEN '[STUCK] ' THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
    'WebLogic marked ' || CAST(count(*) AS VARCHAR) || ' thread(s) ' || trim(mark) AS title, CASE mark WHEN '[STUCK] ' THEN 20 ELSE 21 END AS o FROM m GROUP BY series_id, mark
  UNION ALL SELECT series_id, rule_id, severity, CAST(matched AS VARCHAR) || CASE rule_id WHEN 'connection-pool-exhaustion' THEN ' threads queue for a pooled connection'
    ELSE ' threads held up by a log appender''s lock' END, 100 FROM fired),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, o, title) AS rank FROM f)
"""


@query("rank_findings", snap(by_node=True, body=_RANKED + "SELECT series_id, rank, id, severity, title FROM r"))
def _(spark, sf):
    return flat(_rule_findings(spark, sf), "series_id", "rank", "id", "severity", "title")


_REMEMBERED = _RANKED + """
, half AS (SELECT *, CASE WHEN dump_idx < 5 THEN 'early' ELSE 'late' END AS run FROM snap),
st AS (SELECT DISTINCT run || '/' || series_id AS id, h FROM (SELECT run, series_id, dump_idx, h FROM half GROUP BY ALL HAVING count(*) >= 2)),
an AS (SELECT run || '/' || series_id AS id, run, series_id, count(DISTINCT dump_idx) AS n FROM half GROUP BY ALL)
"""


def _remembered(spark, sf):
    """The early and the late dumps as two runs; the late one is recorded twice, as after a retry."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    t, d = snapshot(spark, sf, True)
    d, ranked = store(d), store(_rule_findings(spark, sf))
    H.remember(path, "early", d.filter("dump_idx < 5"), t.dump.filter("dump_idx < 5"), ranked, "one", at="2024-03-01 10:00:00")
    for _ in range(2):
        similar = H.remember(path, "late", d.filter("dump_idx >= 5"), t.dump.filter("dump_idx >= 5"), ranked, "two", at="2024-03-02 10:00:00")
    return H.read_history(spark, path), similar


@query("history_recorded", snap(by_node=True, body=_REMEMBERED + """
SELECT id, CASE run WHEN 'early' THEN 'one' ELSE 'two' END AS label, n AS dumps, (SELECT count(*) FROM st WHERE st.id = an.id) AS stacks,
  (SELECT count(*) FROM r WHERE r.series_id = an.series_id AND severity = 'CRITICAL') AS critical,
  (SELECT count(*) FROM r WHERE r.series_id = an.series_id AND severity = 'WARNING') AS warning,
  coalesce((SELECT '["' || string_agg(severity || ': ' || title, '","' ORDER BY rank) || '"]' FROM r WHERE r.series_id = an.series_id AND rank <= 10), '[]') AS top
FROM an"""))
def _(spark, sf):
    (analysis, stacks), _similar = _remembered(spark, sf)
    n = stacks.groupBy(F.col("analysis_id").alias("id")).agg(F.count("*").alias("stacks"))
    part = lambda p: F.get_json_object("summary", p)
    return flat(analysis.join(n, "id", "left"), "id", "label", dumps=part("$.dumps").cast("long"), stacks=F.coalesce("stacks", F.lit(0)),
                critical=part("$.severities.CRITICAL").cast("long"), warning=part("$.severities.WARNING").cast("long"), top=part("$.topFindings"))


@query("remembered_incidents", snap(by_node=True, body=_REMEMBERED + """
, c AS (SELECT id, count(*) AS n FROM st GROUP BY id),
sh AS (SELECT q.id AS query_id, p.id AS analysis_id, count(*) AS shared FROM st q JOIN st p ON p.h = q.h AND starts_with(q.id, 'late') AND starts_with(p.id, 'early') GROUP BY ALL)
SELECT query_id, analysis_id, shared, round(shared / (a.n + b.n - shared), 3) AS overlap FROM sh JOIN c a ON a.id = query_id JOIN c b ON b.id = analysis_id
WHERE shared / (a.n + b.n - shared) >= 0.3"""))
def _(spark, sf):
    return flat(_remembered(spark, sf)[1], "query_id", "analysis_id", "shared", "overlap")


@query("severity_gate", snap(by_node=True, body=_RANKED + """
SELECT series_id, count(*) FILTER (severity = 'CRITICAL') AS hits, CAST(count(*) FILTER (severity = 'CRITICAL') > 0 AS BIGINT) AS failed FROM r GROUP BY 1"""))
def _(spark, sf):
    return flat(D.severity_gate(_rule_findings(spark, sf)), "series_id", "hits", "failed")


@query("findings_summary", snap(by_node=True, body=_RANKED + """
SELECT series_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info,
  string_agg(id, ',' ORDER BY rank) AS ids FROM r GROUP BY 1"""))
def _(spark, sf):
    s = D.findings_summary(_rule_findings(spark, sf))
    return flat(s, "series_id", "critical", "warning", "info", ids=F.array_join(F.transform("top", lambda x: x["id"]), ","))


@query("summary_text", snap(by_node=True, body=_RANKED + """
SELECT series_id, CAST(count(*) FILTER (severity = 'CRITICAL') AS VARCHAR) || ' critical, ' || CAST(count(*) FILTER (severity = 'WARNING') AS VARCHAR) || ' warning, ' ||
  CAST(count(*) FILTER (severity = 'INFO') AS VARCHAR) || ' info' || chr(10) || string_agg('- [' || severity || '] ' || title, chr(10) ORDER BY rank) FILTER (rank <= 5) AS text FROM r GROUP BY 1"""))
def _(spark, sf):
    return D.summary_text(_rule_findings(spark, sf))
