"""Queries across dumps."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackscope import schema
from stackscope.operators import baseline as B
from stackscope.operators import fleet as FL
from stackscope.operators import locks as L
from stackscope.operators import quality as Q
from stackscope.operators import series as S
from stackscope.operators import single
from stackscope.operators import stuck as K
from stackscope.operators.derive import derive
from stackscope.operators.export import write_results
from stackscope.plans.analyze import release_drift
from stackscope.plans.catalog_locks import CLOSURE
from stackscope.plans.registry import flat, query
from stackscope.plans.snapshots import event_tables, read
from stackscope.plans.sqlbase import snap
from stackscope.session import shared_dir, store
from stackscope.sources.series import order_series
from stackscope.sources.tables import Tables, conform


def snapshot(spark, sf, by_node=False):
    t = event_tables(spark, sf, by_node)
    return t, derive(t.thread)


@query("order_series", """
WITH t AS (SELECT o_orderpriority AS series_id, o_orderkey AS k, CASE WHEN o_totalprice >= 50000 THEN o_orderdate END AS ts FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts NULLS LAST, k) - 1 AS dump_idx,
  row_number() OVER (PARTITION BY series_id ORDER BY k) - 1 AS i FROM t)
SELECT series_id, k, dump_idx, CAST(bool_or(dump_idx <> i) OVER (PARTITION BY series_id) AS BIGINT) AS reordered FROM r""")
def _(spark, sf):
    o = read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderkey").alias("k"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_orderdate")).alias("ts"))
    return flat(order_series(o, ["k"]), "series_id", "k", "dump_idx", "reordered")


@query("series_index", snap(by_node=True, body="""
SELECT series_id, key, arg_min(norm, dump_idx) AS display_name, min(dump_idx) AS first_dump, max(dump_idx) AS latest_dump, count(*) AS seen
FROM snap GROUP BY series_id, key"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    return flat(S.key_summary(S.series_index(d)), "series_id", "key", "display_name", "first_dump", "latest_dump", "seen")


@query("all_timelines", snap(body="SELECT dump_idx, key, state, norm AS display_name FROM snap"))
def _(spark, sf):
    _t, d = snapshot(spark, sf)
    return flat(S.all_timelines(S.series_index(d)), "dump_idx", "key", "state", "display_name")


RUNS = """
ok AS (SELECT *, dump_idx - row_number() OVER (PARTITION BY series_id, key, h ORDER BY dump_idx) AS isl
       FROM snap WHERE state IN ('RUNNABLE', 'BLOCKED')),
runs AS (SELECT series_id, key, h, isl, min(dump_idx) AS from_dump, max(dump_idx) AS to_dump, count(*) AS run_length,
    max(et) AS et, max(u) AS u, max(norm) AS norm, max(name) AS name, max(state) AS state,
    CAST(max(cpu) - min(cpu) AS DOUBLE) AS cpu_delta
  FROM ok GROUP BY ALL HAVING count(*) >= 3),
cand AS (SELECT r.*, CAST(date_diff('second', a.day, b.day) AS DOUBLE) AS wall_s FROM runs r
  JOIN days a ON a.series_id = r.series_id AND a.dump_idx = r.from_dump
  JOIN days b ON b.series_id = r.series_id AND b.dump_idx = r.to_dump)
"""


@query("stuck_candidates", snap(body="," + RUNS + """
SELECT key, norm AS name, name AS last_name, from_dump, to_dump, run_length, state AS states, h AS fp, cpu_delta AS cpu_delta_ms, wall_s,
  CAST(et = 'click' AS BIGINT) AS top_native FROM cand"""))
def _(spark, sf):
    t, d = snapshot(spark, sf)
    c = S.stuck_candidates(S.series_index(d), t.dump)
    return flat(c, "key", "name", "last_name", "from_dump", "to_dump", "run_length", "fp", "cpu_delta_ms", "wall_s",
                "top_native", states=F.array_join("states", ","))


VERDICTS = RUNS + "," + CLOSURE + """,
cont AS (SELECT series_id, dump_idx, slot, count(*) AS waiters FROM waits GROUP BY ALL),
v AS (SELECT c.*, ct.waiters, h.holder, coalesce(vi.transitive, 0) AS held, c.cpu_delta / (c.wall_s * 1000) AS ratio
  FROM cand c
  LEFT JOIN cont ct ON c.et = 'error' AND ct.series_id = c.series_id AND ct.dump_idx = c.to_dump AND ct.slot = c.u % 8
  LEFT JOIN holder h ON c.et = 'error' AND h.series_id = c.series_id AND h.dump_idx = c.to_dump AND h.slot = c.u % 8
  LEFT JOIN victims vi ON vi.series_id = c.series_id AND vi.dump_idx = c.to_dump AND vi.holder = c.name),
verdict AS (SELECT *, CASE
    WHEN et = 'error' THEN 'BLOCKED_CHAIN'
    WHEN ratio <= 0.05 AND cpu_delta < 100 AND et = 'click' THEN 'NATIVE_WAIT'
    WHEN ratio >= 0.70 THEN 'SPINNING' ELSE 'FROZEN' END AS kind FROM v),
judged AS (SELECT *, CASE kind
    WHEN 'BLOCKED_CHAIN' THEN CASE WHEN waiters >= 5 THEN 'CRITICAL' ELSE 'WARNING' END
    WHEN 'NATIVE_WAIT' THEN 'INFO'
    WHEN 'SPINNING' THEN CASE WHEN held > 0 THEN 'CRITICAL' ELSE 'WARNING' END ELSE 'WARNING' END AS severity,
  CASE kind WHEN 'BLOCKED_CHAIN' THEN CASE WHEN holder IS NOT NULL THEN 'high' ELSE 'medium' END
    WHEN 'FROZEN' THEN 'medium' ELSE 'high' END AS confidence,
  CASE kind WHEN 'BLOCKED_CHAIN' THEN waiters WHEN 'NATIVE_WAIT' THEN 0 ELSE held END AS victims FROM verdict)
"""


def verdicts(t, d, min_run=3):
    d = store(d)
    edges = L.waits_for(d)
    c = S.stuck_candidates(S.series_index(d), t.dump, min_run)
    return K.classify_stuck(c, L.contended_locks(d), L.transitive_victims(edges))


@query("classify_stuck", snap(body="," + VERDICTS + """
SELECT key, from_dump, to_dump, kind, severity, confidence, victims FROM judged"""))
def _(spark, sf):
    t, d = snapshot(spark, sf)
    return flat(verdicts(t, d), "key", "from_dump", "to_dump", "kind", "severity", "confidence", "victims")


HOLDERS = """
hk AS (SELECT series_id, dump_idx, u AS hu, key AS holder_key FROM snap),
pair AS (SELECT w.series_id, w.dump_idx, w.key AS waiter_key, w.name, h.holder, k.holder_key,
    'com.shop.Ledger' || CAST(w.slot AS VARCHAR) AS lock_class
  FROM waits w JOIN holder h USING (series_id, dump_idx, slot) JOIN hk k USING (series_id, dump_idx, hu)
  WHERE w.key <> k.holder_key),
pd AS (SELECT series_id, holder_key, lock_class, dump_idx, count(*) AS waiters FROM pair GROUP BY ALL),
isl AS (SELECT *, dump_idx - row_number() OVER (PARTITION BY series_id, holder_key, lock_class ORDER BY dump_idx) AS i FROM pd),
runl AS (SELECT series_id, holder_key, lock_class, max(n) AS longest_run FROM (
    SELECT series_id, holder_key, lock_class, i, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL HAVING max(n) >= 2),
kept AS (SELECT r.*, (SELECT count(*) FROM pd p WHERE p.series_id = r.series_id AND p.holder_key = r.holder_key AND p.lock_class = r.lock_class) AS dumps,
    (SELECT max(waiters) FROM pd p WHERE p.series_id = r.series_id AND p.holder_key = r.holder_key AND p.lock_class = r.lock_class) AS max_waiters,
    (SELECT count(DISTINCT waiter_key) FROM pair p WHERE p.series_id = r.series_id AND p.holder_key = r.holder_key AND p.lock_class = r.lock_class) AS starved_total,
    (SELECT arg_min(holder, dump_idx) FROM pair p WHERE p.series_id = r.series_id AND p.holder_key = r.holder_key AND p.lock_class = r.lock_class) AS holder
  FROM runl r)
"""


@query("persistent_lock_holders", snap(body="," + HOLDERS + """
SELECT holder_key, lock_class, longest_run, dumps, max_waiters, starved_total, holder FROM kept"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf)
    return flat(S.persistent_lock_holders(d), "holder_key", "lock_class", "longest_run", "dumps", "max_waiters",
                "starved_total", "holder")


@query("lock_holder_dumps", snap(body="," + HOLDERS + """
SELECT holder_key, lock_class, dump_idx, waiters, 1 AS addresses FROM pd"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf)
    return flat(S.lock_holder_dumps(d), "holder_key", "lock_class", "dump_idx", "waiters", "addresses")


@query("lock_holder_samples", snap(body="," + HOLDERS + """
, wk AS (SELECT series_id, holder_key, lock_class, waiter_key, min(name) AS name FROM pair GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, holder_key, lock_class ORDER BY name, waiter_key) AS k FROM wk)
SELECT holder_key, lock_class, string_agg(name, ',' ORDER BY k) AS sample_waiters FROM r JOIN runl USING (series_id, holder_key, lock_class) WHERE k <= 5 GROUP BY ALL"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf)
    return flat(S.persistent_lock_holders(d), "holder_key", "lock_class", sample_waiters=F.array_join("sample_waiters", ","))


@query("lock_holder_waiters", snap(body="," + HOLDERS + """
SELECT holder_key, lock_class, waiter_key, min(name) AS name, count(DISTINCT dump_idx) AS dumps, min(dump_idx) AS from_dump, max(dump_idx) AS to_dump
FROM pair JOIN runl USING (series_id, holder_key, lock_class) GROUP BY ALL"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf)
    return flat(S.lock_holder_waiters(d), "holder_key", "lock_class", "waiter_key", "name", "dumps", "from_dump", "to_dump")


@query("lock_holder_addresses", snap(body="," + HOLDERS + """
SELECT p.holder_key, p.lock_class, p.dump_idx, string_agg(DISTINCT '0x00000000e000000' || right(p.lock_class, 1), ',') AS addresses FROM pair p GROUP BY ALL"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf)
    return flat(S.lock_holder_dumps(d), "holder_key", "lock_class", "dump_idx", addresses=F.array_join("address_list", ","))


def order_threads(spark, sf):
    """Orders as threads: a series per priority, a dump per month, a pool per customer group."""
    k = F.col("o_orderkey")
    o = read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("day"), k.alias("thread_ord"),
        F.concat(F.lit("pool-"), (F.col("o_custkey") % 60).cast("string"), F.lit("-thread-"), k.cast("string")).alias("name"))
    dump = order_series(o.select("series_id", "day").distinct().withColumn("ts", F.col("day").cast("timestamp")), ["day"])
    t = o.join(dump.select("series_id", "day", "dump_idx"), ["series_id", "day"]).withColumn(
        "frames", F.array().cast(T.ArrayType(schema.FRAME))).withColumn(
        "locks", F.array().cast(T.ArrayType(schema.LOCK))).withColumn("java_id", F.col("thread_ord"))
    return conform(dump, schema.DUMP), derive(conform(t, schema.THREAD))


_ORDERS = """
WITH o AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS day, 'pool-' || CAST(o_custkey % 60 AS VARCHAR) AS pool FROM orders),
dd AS (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS dump_idx FROM (SELECT DISTINCT series_id, day FROM o)),
nd AS (SELECT series_id, count(*) AS n_dumps FROM dd GROUP BY 1),
grid AS (SELECT p.series_id, p.pool, d.dump_idx FROM (SELECT DISTINCT series_id, pool FROM o) p JOIN dd d USING (series_id)),
cnt AS (SELECT series_id, pool, dump_idx, count(*) AS c FROM o JOIN dd USING (series_id, day) GROUP BY ALL),
full_cnt AS (SELECT series_id, pool, dump_idx, coalesce(c, 0) AS n FROM grid LEFT JOIN cnt USING (series_id, pool, dump_idx))
"""


@query("pool_trend", _ORDERS + """
, st AS (SELECT *, lag(n) OVER (PARTITION BY series_id, pool ORDER BY dump_idx) AS p FROM full_cnt)
SELECT series_id, pool, max(n_dumps) AS n_dumps, max(n) AS peak, arg_min(n, dump_idx) AS first_count, arg_max(n, dump_idx) AS last_count,
  arg_max(n, dump_idx) - arg_min(n, dump_idx) AS growth,
  CAST(max(n_dumps) >= 3 AND coalesce(bool_and(n >= p), true) AND coalesce(bool_or(n > p), false)
    AND arg_max(n, dump_idx) - arg_min(n, dump_idx) >= 5 AS BIGINT) AS leak_suspect
FROM st JOIN nd USING (series_id) GROUP BY series_id, pool""")
def _(spark, sf):
    dump, t = order_threads(spark, sf)
    return flat(S.pool_trend(t, dump), "series_id", "pool", "n_dumps", "peak", "first_count", "last_count", "growth", "leak_suspect")


@query("pool_trend_counts", _ORDERS + "SELECT series_id, pool, dump_idx, n FROM full_cnt")
def _(spark, sf):
    dump, t = order_threads(spark, sf)
    return flat(S.pool_trend_counts(t, dump), "series_id", "pool", "dump_idx", "n")


@query("pool_trend_top", _ORDERS + """
, pk AS (SELECT series_id, pool, row_number() OVER (PARTITION BY series_id ORDER BY max(c) DESC, pool) AS r FROM cnt GROUP BY series_id, pool)
SELECT series_id, dump_idx, CASE WHEN r <= 8 THEN pool ELSE 'Other (' || CAST(k AS VARCHAR) || ' pools)' END AS line, CAST(sum(c) AS BIGINT) AS n
FROM cnt JOIN pk USING (series_id, pool) JOIN (SELECT series_id, count(*) FILTER (r > 8) AS k FROM pk GROUP BY 1) USING (series_id) GROUP BY ALL""")
def _(spark, sf):
    _d, t = order_threads(spark, sf)
    return flat(S.pool_trend_top(t), "series_id", "dump_idx", "line", "n")


@query("flagged_timelines", snap(body="," + VERDICTS + "," + HOLDERS + """
, fl AS (SELECT key, 0 AS o, 'stuck' AS flag FROM judged WHERE kind <> 'NATIVE_WAIT'
  UNION SELECT holder_key, 1, 'persistent-lock-holder' FROM kept
  UNION SELECT key, 3, 'weblogic-stuck-marker' FROM snap WHERE mark IN ('[STUCK] ', '[HOGGING] ')),
k AS (SELECT key, min(o) AS o, string_agg(flag, ',' ORDER BY o) AS flags FROM fl GROUP BY key),
r AS (SELECT k.*, row_number() OVER (ORDER BY k.o, s.f, k.key) AS rn FROM k
  JOIN (SELECT key, min(dump_idx) AS f FROM snap GROUP BY key) s USING (key))
SELECT dump_idx, key, state, norm AS display_name, flags FROM snap JOIN r USING (key) WHERE rn <= 150"""))
def _(spark, sf):
    t, d = snapshot(spark, sf)
    occ = S.series_index(d)
    flags = S.flag_rows(d, K.genuine(verdicts(t, d)), S.persistent_lock_holders(d), t.jvm_cycle)
    return flat(S.flagged_timelines(occ, flags), "dump_idx", "key", "state", "display_name", flags=F.array_join("flags", ","))


@query("cpu_delta", snap(body="""
SELECT key, CAST(arg_max(cpu, dump_idx) - arg_min(cpu, dump_idx) AS DOUBLE) AS delta_ms,
  CAST(1000 * date_diff('second', min(day), max(day)) AS DOUBLE) AS wall_ms,
  round(CAST(arg_max(cpu, dump_idx) - arg_min(cpu, dump_idx) AS DOUBLE) / (1000 * date_diff('second', min(day), max(day))), 6) AS ratio
FROM snap GROUP BY key HAVING count(*) > 1"""))
def _(spark, sf):
    t, d = snapshot(spark, sf)
    return flat(S.cpu_delta(S.series_index(d), t.dump), "key", "delta_ms", "wall_ms", ratio=F.round("ratio", 6))


@query("longest_runs", snap(body="""
SELECT state, key, max(n) AS run FROM (
  SELECT state, key, i, count(*) AS n FROM (
    SELECT state, key, dump_idx - row_number() OVER (PARTITION BY state, key ORDER BY dump_idx) AS i FROM snap) GROUP BY ALL)
GROUP BY state, key"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf)
    return flat(S.longest_runs(d.select("state", "key", "dump_idx"), ["state"]), "state", "key", "run")


_TOP = """
g AS (SELECT series_id, dump_idx, h, count(*) AS n, min(u) AS f, arg_min(r0, u) AS top_frame FROM snap GROUP BY ALL HAVING count(*) >= 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, dump_idx ORDER BY n DESC, f, h) AS rank FROM g) WHERE rank <= 15)
"""


@query("baseline_build", snap(by_node=True, body="," + _TOP + """
SELECT series_id, 'state' AS part, state AS item, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY series_id), 2) AS value FROM snap GROUP BY series_id, state
UNION ALL SELECT series_id, 'pool', pool, round(count(*) / max(n), 2) FROM snap JOIN n_dumps USING (series_id) GROUP BY series_id, pool
UNION ALL SELECT DISTINCT series_id, 'stack', h, 1.0 FROM g
UNION ALL SELECT series_id, 'avg_threads', '', round(count(*) / max(n), 2) FROM snap JOIN n_dumps USING (series_id) GROUP BY series_id"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    b = B.build(d, t.dump)
    row = lambda df, part, item, value: df.select("series_id", F.lit(part).alias("part"), item.alias("item"), value.alias("value"))
    return (row(b.state, "state", F.col("state"), F.col("percent"))
            .unionByName(row(b.pool, "pool", F.col("pool"), F.col("avg")))
            .unionByName(row(b.stack, "stack", F.col("stack_hash"), F.lit(1.0)))
            .unionByName(row(b.header, "avg_threads", F.lit(""), F.col("avg_threads"))))


def _halves(spark, sf):
    """Days before the 15th as the healthy series, the later ones as the incident."""
    t, d = snapshot(spark, sf, True)
    before = B.build(d.filter("dump_idx < 15"), t.dump.filter("dump_idx < 15"))
    return t, d.filter("dump_idx >= 15"), t.dump.filter("dump_idx >= 15"), before


_SHIFTS = """
, x AS (SELECT series_id, state, dump_idx >= 15 AS late, count(*) AS n FROM snap GROUP BY ALL),
p AS (SELECT series_id, state, late, round(100.0 * n / sum(n) OVER (PARTITION BY series_id, late), 2) AS pct FROM x)
SELECT series_id, state, coalesce(max(pct) FILTER (NOT late), 0) AS baseline_percent, coalesce(max(pct) FILTER (late), 0) AS incident_percent,
  round(coalesce(max(pct) FILTER (late), 0) - coalesce(max(pct) FILTER (NOT late), 0), 2) AS delta_points
FROM p GROUP BY series_id, state"""


@query("baseline_state_shifts", snap(by_node=True, body=_SHIFTS))
def _(spark, sf):
    _t, late, dump, before = _halves(spark, sf)
    return flat(B.state_shifts(B.build(late, dump).state, before.state), "series_id", "state", "baseline_percent",
                "incident_percent", "delta_points")


@query("baseline_pool_deltas", snap(by_node=True, body="""
, k AS (SELECT series_id, dump_idx >= 15 AS late, count(*) AS nd FROM days GROUP BY ALL),
x AS (SELECT series_id, pool, dump_idx >= 15 AS late, count(*) AS n FROM snap GROUP BY ALL),
p AS (SELECT series_id, pool, late, round(n / nd, 2) AS a FROM x JOIN k USING (series_id, late))
SELECT series_id, pool, coalesce(max(a) FILTER (NOT late), 0) AS baseline_avg, coalesce(max(a) FILTER (late), 0) AS incident_avg,
  round(coalesce(max(a) FILTER (late), 0) - coalesce(max(a) FILTER (NOT late), 0), 2) AS delta
FROM p GROUP BY series_id, pool"""))
def _(spark, sf):
    _t, late, dump, before = _halves(spark, sf)
    return flat(B.pool_deltas(B.build(late, dump).pool, before.pool), "series_id", "pool", "baseline_avg", "incident_avg", "delta")


@query("release_drift", snap(by_node=True, body=_SHIFTS))
def _(spark, sf):
    """The healthy half goes through a stored baseline; the other half is compared as a release is."""
    path = f"{shared_dir(spark)}/baseline-{uuid.uuid4().hex}"
    t, _late, dump, before = _halves(spark, sf)
    B.save(before, path)
    late = Tables(dump, t.thread.filter("dump_idx >= 15"), t.jvm_cycle, t.parse_issue)
    return flat(release_drift(late, B.load(spark, path))["state_shifts"], "series_id", "state", "baseline_percent", "incident_percent", "delta_points")


@query("results_as_json", snap(by_node=True, body="""
, c AS (SELECT series_id, dump_idx, state, count(*) AS n FROM snap GROUP BY ALL)
SELECT 'counts' AS tab, series_id, dump_idx, state, n FROM c
UNION ALL SELECT 'sizes', series_id, dump_idx, NULL, sum(n)::BIGINT FROM c GROUP BY series_id, dump_idx"""))
def _(spark, sf):
    """Result tables written as JSON, one dataset each and a folder for each series, and read again."""
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    _t, d = snapshot(spark, sf, True)
    write_results({"counts": single.state_counts(d), "sizes": single.state_distribution(d)}, path, "json")
    back = lambda name, cols: spark.read.schema(cols + ", series_id string").json(f"{path}/{name}")
    counts = back("counts", "dump_idx long, state string, n long").withColumn("tab", F.lit("counts"))
    sizes = back("sizes", "dump_idx long, total long").select(
        "dump_idx", F.lit(None).cast("string").alias("state"), F.col("total").alias("n"), "series_id", F.lit("sizes").alias("tab"))
    return flat(counts.unionByName(sizes), "tab", "series_id", "dump_idx", "state", "n")


@query("quality_of_orders", """
WITH d AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS ts FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ts, k) AS i, row_number() OVER (PARTITION BY c ORDER BY k) AS j, count(*) OVER (PARTITION BY c) AS n,
  date_diff('second', lag(ts) OVER (PARTITION BY c ORDER BY ts, k), ts) AS gap FROM d)
SELECT CAST(c AS VARCHAR) AS series_id, 'single-dump' AS code, 'WARNING' AS level, 1 AS notes FROM r WHERE n = 1
UNION ALL SELECT CAST(c AS VARCHAR), 'out-of-order', 'INFO', 1 FROM r GROUP BY c HAVING bool_or(i <> j)
UNION ALL SELECT CAST(c AS VARCHAR), 'gap', 'WARNING', count(*) FROM r WHERE gap > 60 GROUP BY c
UNION ALL SELECT CAST(c AS VARCHAR), 'no-synchronizers', 'WARNING', 1 FROM d GROUP BY c HAVING bool_and(c % 3 = 0)
UNION ALL SELECT CAST(c AS VARCHAR), 'mixed-jvms', 'WARNING', 1 FROM d GROUP BY c HAVING count(DISTINCT k % 2) > 1""")
def _(spark, sf):
    """Orders of a customer as a series given in the order of keys: lone dumps, wrong order, gaps, mixed banners."""
    d = read(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("series_id"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("VM "), (F.col("o_orderkey") % 2).cast("string")).alias("banner"), (F.col("o_custkey") % 3 != 0).alias("saw_sync"))
    empty = spark.createDataFrame([], "series_id string, key string, dump_idx int, elapsed_s double")
    notes = Q.quality_notes(store(order_series(d, ["k"])), empty, spark.createDataFrame([], schema.PARSE_ISSUE))
    return flat(notes.groupBy("series_id", "code", "level").agg(F.count("*").alias("notes")), "series_id", "code", "level", "notes")


@query("new_recurring_stacks", snap(by_node=True, body="," + _TOP + """
SELECT series_id, h AS stack_hash, max(n) AS max_count, count(*) AS dumps, min(dump_idx) AS first_dump, arg_min(top_frame, dump_idx) AS top_frame
FROM g WHERE dump_idx >= 5 AND (series_id, h) NOT IN (SELECT (series_id, h) FROM g WHERE dump_idx < 5) GROUP BY series_id, h"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    base = S.baseline_stack(d.filter("dump_idx < 5"))
    return flat(B.new_recurring_stacks(d.filter("dump_idx >= 5"), base), "series_id", "stack_hash", "max_count", "dumps",
                "first_dump", top_frame=F.get("stack", F.lit(0)))


@query("clock_skew", snap(by_node=True, body="""
, p AS (SELECT series_id, key, dump_idx, elapsed, lag(elapsed) OVER w AS pe, lag(dump_idx) OVER w AS pi FROM snap
  WINDOW w AS (PARTITION BY series_id, key ORDER BY dump_idx)),
x AS (SELECT series_id, dump_idx, elapsed - pe AS delta, row_number() OVER (PARTITION BY series_id, dump_idx ORDER BY elapsed - pe) AS r,
  count(*) OVER (PARTITION BY series_id, dump_idx) AS n FROM p WHERE pi = dump_idx - 1),
m AS (SELECT series_id, dump_idx, delta AS median FROM x WHERE n >= 3 AND r = n // 2 + 1),
d2 AS (SELECT series_id, dump_idx, CAST(date_diff('second', lag(day) OVER (PARTITION BY series_id ORDER BY dump_idx), day) AS DOUBLE) AS wall FROM days),
s AS (SELECT m.series_id, m.dump_idx, wall, median FROM m JOIN d2 USING (series_id, dump_idx)
  WHERE wall > 0 AND abs(median - wall) > 5 AND abs(median - wall) > 0.2 * wall)
SELECT series_id, min(dump_idx) AS dump_idx, arg_min(wall, dump_idx) AS wall, arg_min(median, dump_idx) AS median FROM s GROUP BY series_id"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    return flat(Q.clock_skew(S.series_index(d), t.dump), "series_id", "dump_idx", "wall", "median")


@query("quality_notes", snap(by_node=True, body="""
, skewed AS (SELECT DISTINCT series_id FROM snap WHERE u % 2 = 1),
iss AS (SELECT series_id, dump_idx, name, row_number() OVER (PARTITION BY series_id ORDER BY dump_idx, name) AS rn FROM snap WHERE et = 'error')
SELECT series_id, 'WARNING' AS level, 'no-synchronizers' AS code, count(*) AS n FROM n_dumps GROUP BY series_id
UNION ALL SELECT series_id, 'INFO', 'parse-issue', least(count(*), 5) FROM iss GROUP BY series_id
UNION ALL SELECT series_id, 'INFO', 'parse-issues-omitted', 1 FROM iss GROUP BY series_id HAVING count(*) > 5
UNION ALL SELECT series_id, 'WARNING', 'mixed-jvms', 1 FROM n_dumps
UNION ALL SELECT series_id, 'WARNING', 'gap', n - 1 FROM n_dumps WHERE n > 1
UNION ALL SELECT series_id, 'WARNING', 'single-dump', 1 FROM n_dumps WHERE n = 1
UNION ALL SELECT series_id, 'WARNING', 'clock-skew', 1 FROM skewed"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    dump = t.dump.withColumn("banner", F.concat(F.lit("VM "), (F.col("dump_idx") % 2).cast("string")))
    issues = d.filter("state = 'BLOCKED'").select("series_id", "dump_idx", F.lit("log").alias("where"), F.col("name").alias("message"))
    notes = Q.quality_notes(dump, S.series_index(d), issues)
    return flat(notes.groupBy("series_id", "level", "code").agg(F.count("*").alias("n")), "series_id", "level", "code", "n")


@query("dump_gaps", """
WITH d AS (SELECT DISTINCT o_orderpriority AS series_id, o_orderdate AS ts FROM orders),
r AS (SELECT *, row_number() OVER w - 1 AS dump_idx, date_diff('second', lag(ts) OVER w, ts) AS seconds FROM d WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, dump_idx, seconds FROM r WHERE seconds > 60""")
def _(spark, sf):
    d = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts")).distinct()
    return flat(Q.gaps(order_series(d, ["ts"])), "series_id", "dump_idx", "seconds")


@query("node_summary", snap(by_node=True, body="""
, l AS (SELECT series_id, max(dump_idx) AS dump_idx FROM days GROUP BY 1)
SELECT s.series_id, max(n) AS dumps, count(*) FILTER (s.dump_idx = l.dump_idx) AS threads,
  round(100.0 * count(*) FILTER (state = 'RUNNABLE') / count(*), 1) AS runnable_pct,
  round(100.0 * count(*) FILTER (state = 'BLOCKED') / count(*), 1) AS blocked_pct
FROM snap s JOIN l USING (series_id) JOIN n_dumps USING (series_id) GROUP BY s.series_id"""))
def _(spark, sf):
    t, d = snapshot(spark, sf, True)
    return flat(FL.node_summary(d, t.dump), "series_id", "dumps", "threads", "runnable_pct", "blocked_pct")


@query("node_top_stacks", snap(by_node=True, body="," + _TOP + """
, s AS (SELECT series_id, h, max(n) AS n, min(dump_idx * 1000 + rank) AS f FROM top GROUP BY ALL)
SELECT series_id, h AS stack_hash, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, f, h) AS rank FROM s) WHERE rank <= 5"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    return flat(FL.node_top_stacks(d), "series_id", "stack_hash", "n", "rank")


@query("node_pool_busy", snap(by_node=True, body="""
SELECT series_id, pool, round(100.0 * count(*) FILTER (cls = 'APPLICATION') / count(*), 6) AS busy_pct FROM snap GROUP BY ALL"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    return flat(S.node_pool_busy(d), "series_id", "pool", busy_pct=F.round("busy_pct", 6))


def _uneven(d):
    """Every thread stays; nodes n0, n1 and n3 show other states, loads and stacks than the rest, so that outliers exist."""
    node, state = F.col("series_id"), F.col("state")
    return d.withColumn("stack_hash", F.when((node == "n3") & (state == "BLOCKED"), F.lit("only-n3")).otherwise(F.col("stack_hash"))) \
        .withColumn("cls_kind", F.when(node == "n0", "APPLICATION").when(node == "n1", "IDLE").otherwise(F.col("cls_kind"))) \
        .withColumn("state", F.when((node == "n0") & state.isin("WAITING", "TIMED_WAITING"), "RUNNABLE")
                    .when(node == "n1", "WAITING").otherwise(state))


_UNEVEN = """
, un AS (SELECT * REPLACE (
  CASE WHEN series_id = 'n3' AND state = 'BLOCKED' THEN 'only-n3' ELSE h END AS h,
  CASE series_id WHEN 'n0' THEN 'APPLICATION' WHEN 'n1' THEN 'IDLE' ELSE cls END AS cls,
  CASE WHEN series_id = 'n0' AND state IN ('WAITING', 'TIMED_WAITING') THEN 'RUNNABLE' WHEN series_id = 'n1' THEN 'WAITING' ELSE state END AS state) FROM snap),
st AS (SELECT unnest(['NEW', 'RUNNABLE', 'BLOCKED', 'WAITING', 'TIMED_WAITING', 'TERMINATED', 'UNKNOWN']) AS state),
nt AS (SELECT series_id, count(*) AS n FROM un GROUP BY 1),
sh AS (SELECT nt.series_id, st.state, 100.0 * count(un.u) / max(nt.n) AS pct FROM nt, st LEFT JOIN un ON un.series_id = nt.series_id AND un.state = st.state GROUP BY ALL),
so AS (SELECT sh.series_id, sh.state, pct, med FROM sh JOIN (SELECT state, median(pct) AS med FROM sh GROUP BY 1) USING (state) WHERE abs(pct - med) > 20),
pb AS (SELECT series_id, pool, 100.0 * count(*) FILTER (cls = 'APPLICATION') / count(*) AS busy FROM un GROUP BY ALL),
po AS (SELECT pb.*, med FROM pb JOIN (SELECT pool, median(busy) AS med FROM pb GROUP BY 1 HAVING count(*) >= 2) USING (pool) WHERE abs(busy - med) > 30),
ug AS (SELECT series_id, dump_idx, h, count(*) AS n, arg_min(split_part(r0, '(', 1), u) AS w FROM un GROUP BY ALL HAVING count(*) >= 2),
uk AS (SELECT series_id, h, max(n) AS n, arg_min(w, dump_idx) AS w FROM ug GROUP BY ALL),
us AS (SELECT series_id, h, n, w FROM uk WHERE n >= 5 AND h IN (SELECT h FROM uk GROUP BY h HAVING count(*) = 1))
"""


@query("state_outliers", snap(by_node=True, body=_UNEVEN + """
SELECT series_id, state, round(pct, 6) AS percent, round(med, 6) AS median FROM so"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    return flat(FL.state_outliers(_uneven(d)), "series_id", "state", percent=F.round("percent", 6), median=F.round("median", 6))


@query("pool_outliers", snap(by_node=True, body=_UNEVEN + """
SELECT series_id, pool, round(busy, 6) AS busy_pct, round(med, 6) AS median FROM po"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    return flat(FL.pool_outliers(_uneven(d)), "series_id", "pool", busy_pct=F.round("busy_pct", 6), median=F.round("median", 6))


def document_nodes(spark, sf):
    """Documents as threads of four nodes (their language), the text's lines as frames."""
    raw = F.split("text", "\n")
    frames = F.transform(raw, lambda s: F.struct(
        s.alias("raw"), s.alias("cls"), F.lit("").alias("method"), F.lit("").alias("loc"), s.alias("sig"), F.lit(False).alias("native")))
    t = read(spark, sf, "documents").select(
        F.col("lang").alias("series_id"), F.lit(0).alias("dump_idx"), F.col("doc_id").alias("thread_ord"),
        F.col("source").alias("name"), F.col("doc_id").alias("java_id"), F.lit("RUNNABLE").alias("state"), frames.alias("frames"),
        F.array().cast(T.ArrayType(schema.LOCK)).alias("locks"))
    return derive(conform(t, schema.THREAD))


@query("unique_stack_outliers", """
WITH g AS (SELECT lang AS series_id, md5(text) AS stack_hash, count(*) AS n, min(doc_id) AS f, arg_min(split_part(text, chr(10), 1), doc_id) AS w
  FROM documents GROUP BY ALL HAVING count(*) >= 2)
SELECT series_id, stack_hash, n, regexp_replace(w, '\\(.*', '') AS "where" FROM g WHERE n >= 5
  AND stack_hash IN (SELECT stack_hash FROM g GROUP BY 1 HAVING count(*) = 1)""")
def _(spark, sf):
    return flat(FL.unique_stack_outliers(document_nodes(spark, sf)), "series_id", "stack_hash", "n", "where")


@query("fleet_outliers", snap(by_node=True, body=_UNEVEN + """
SELECT series_id AS node, 'state-distribution' AS kind, 'node ' || series_id || ' diverges: ' || CAST(CAST(round(pct) AS BIGINT) AS VARCHAR) ||
  '% of threads ' || state || ' (fleet median: ' || CAST(CAST(round(med) AS BIGINT) AS VARCHAR) || '%)' AS explanation FROM so
UNION ALL
SELECT series_id, 'pool-utilization', 'node ' || series_id || ' diverges: pool "' || pool || '" is ' || CAST(CAST(round(busy) AS BIGINT) AS VARCHAR) ||
  '% busy (fleet median: ' || CAST(CAST(round(med) AS BIGINT) AS VARCHAR) || '%)' FROM po
UNION ALL
SELECT series_id, 'unique-stack', 'node ' || series_id || ' diverges: ' || CAST(n AS VARCHAR) || ' threads share a stack in ' || w ||
  ' that no other node shows (fleet median: 0)' FROM us"""))
def _(spark, sf):
    _t, d = snapshot(spark, sf, True)
    return FL.outliers(_uneven(d))


@query("fleet_detail", snap(by_node=True, body="""
SELECT series_id, dump_idx, state, count(*) AS n FROM snap WHERE series_id = 'n3' GROUP BY ALL"""))
def _(spark, sf):
    from stackscope.operators.single import state_counts
    _t, d = snapshot(spark, sf, True)
    return flat(FL.fleet_detail(state_counts(d), "n3"), "series_id", "dump_idx", "state", "n")
