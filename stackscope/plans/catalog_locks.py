"""Lock queries: the event snapshot, and customers as one long chain of waits."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackscope import schema
from stackscope.operators import locks as L
from stackscope.operators.derive import derive
from stackscope.plans.catalog_single import threads
from stackscope.plans.registry import flat, query
from stackscope.plans.snapshots import read
from stackscope.plans.sqlbase import snap
from stackscope.sources.tables import conform

_WAITS = """
w AS (
  SELECT dump_idx, u, name, '0x00000000e000000' || CAST(u % 8 AS VARCHAR) AS address, 'com.shop.Ledger' || CAST(u % 8 AS VARCHAR) AS cls
  FROM snap WHERE et = 'error'
  UNION ALL
  SELECT dump_idx, u, name, '0x00000000f' || lpad(CAST(u AS VARCHAR), 7, '0'), 'java.lang.Object' FROM snap WHERE et = 'view'),
h AS (SELECT dump_idx, '0x00000000e000000' || CAST(slot AS VARCHAR) AS address, holder, hu,
        'com.shop.Ledger' || CAST(slot AS VARCHAR) AS cls FROM holder)
"""


@query("lock_holders", snap(body="," + _WAITS + "SELECT dump_idx, address, holder, hu AS holder_ord, cls AS hold_cls FROM h"))
def _(spark, sf):
    return flat(L.lock_holders(threads(spark, sf)), "dump_idx", "address", "holder", "holder_ord", "hold_cls")


@query("lock_waits", snap(body="," + _WAITS + "SELECT dump_idx, name, address, cls FROM w"))
def _(spark, sf):
    return flat(L.lock_wait(threads(spark, sf)), "dump_idx", "name", "address", "cls")


@query("contended_locks", snap(body="," + _WAITS + """
SELECT dump_idx, address, coalesce(h.cls, w.cls) AS lock_class, holder, w.n AS waiters,
  row_number() OVER (PARTITION BY dump_idx ORDER BY w.n DESC, w.f, address) AS rank
FROM (SELECT dump_idx, address, count(*) AS n, min(u) AS f, min(cls) AS cls FROM w GROUP BY ALL) w
LEFT JOIN h USING (dump_idx, address)"""))
def _(spark, sf):
    return flat(L.contended_locks(threads(spark, sf)), "dump_idx", "address", "lock_class", "holder", "waiters", "rank")


@query("waits_for", snap(body="""
SELECT dump_idx, waiter, holder, u AS waiter_ord, 'com.shop.Ledger' || CAST(slot AS VARCHAR) AS lock_class FROM edges"""))
def _(spark, sf):
    return flat(L.waits_for(threads(spark, sf)), "dump_idx", "waiter", "holder", "waiter_ord", "lock_class")


@query("direct_victims", snap(body="SELECT dump_idx, holder, count(*) AS direct FROM edges GROUP BY ALL"))
def _(spark, sf):
    return flat(L.direct_victims(L.waits_for(threads(spark, sf))), "dump_idx", "holder", "direct")


CLOSURE = """
reach AS (
  SELECT series_id, dump_idx, waiter AS node, holder AS anc FROM edges
  UNION
  SELECT r.series_id, r.dump_idx, r.node, e.holder FROM reach r
  JOIN edges e ON e.series_id = r.series_id AND e.dump_idx = r.dump_idx AND e.waiter = r.anc),
victims AS (SELECT series_id, dump_idx, anc AS holder, count(*) FILTER (node <> anc) AS transitive FROM reach GROUP BY ALL),
direct AS (SELECT series_id, dump_idx, holder, count(*) AS direct, min(u) AS first_ord FROM edges GROUP BY ALL)
"""


@query("top_blockers", snap(body="," + CLOSURE + """
SELECT dump_idx, holder, direct, transitive, row_number() OVER (PARTITION BY dump_idx ORDER BY transitive DESC, first_ord, holder) AS rank
FROM direct JOIN victims USING (series_id, dump_idx, holder)"""))
def _(spark, sf):
    return flat(L.top_blockers(L.waits_for(threads(spark, sf))), "dump_idx", "holder", "direct", "transitive", "rank")


def chain_threads(spark, sf):
    """Customers as threads of seven dumps. Each waits for the one at half its place in
    its dump; near every 97th place two wait for each other."""
    k = F.col("c_custkey")
    q, d = F.floor(k / 7), k % 7
    at = lambda i: (i * 7 + d).cast("string")
    c = read(spark, sf, "customer")
    known = c.select((k).alias("_h"))
    target = (F.when(q % 97 == 3, q + 1).when(q % 97 == 4, q - 1).when(q > 0, F.floor(q / 2)))
    base = c.withColumn("_h", target * 7 + d).join(known.withColumn("_ok", F.lit(True)), "_h", "left")
    lock = lambda kind, addr: F.struct(F.lit(kind).alias("kind"), addr.alias("address"),
                                       F.lit("com.shop.Account").alias("cls"), F.lit(0).alias("frame_idx"))
    wait = lock("WAITING_TO_LOCK", F.col("_h").cast("bigint").cast("string"))
    hold = lock("LOCKED_MONITOR", k.cast("string"))
    t = base.select(
        F.lit("all").alias("series_id"), d.alias("dump_idx"), k.alias("thread_ord"), F.col("c_name").alias("name"),
        k.alias("java_id"), k.cast("string").alias("tid_hex"), F.lit("BLOCKED").alias("state"),
        F.array().cast(T.ArrayType(schema.FRAME)).alias("frames"),
        F.when(F.col("_ok"), F.array(wait, hold)).otherwise(F.array(hold)).alias("locks"))
    return derive(conform(t, schema.THREAD))


CHAIN = """
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_name AS name, c_custkey % 7 AS dump_idx, c_custkey // 7 AS q FROM customer),
t AS (SELECT *, CASE WHEN q % 97 = 3 THEN q + 1 WHEN q % 97 = 4 THEN q - 1 WHEN q > 0 THEN q // 2 END * 7 + dump_idx AS hk FROM c),
edges AS (SELECT 'all' AS series_id, t.dump_idx, t.name AS waiter, h.name AS holder, t.k AS u, h.k AS hu
          FROM t JOIN c h ON h.k = t.hk),
"""


@query("transitive_victims", CHAIN + CLOSURE + """
SELECT dump_idx, holder, direct, transitive FROM direct JOIN victims USING (series_id, dump_idx, holder)""")
def _(spark, sf):
    return flat(L.transitive_victims(L.waits_for(chain_threads(spark, sf))), "dump_idx", "holder", "direct", "transitive")


def _jvm_report(spark, sf):
    """Every other deadlock, as the JVM would have told it."""
    k = F.col("c_custkey")
    q = F.floor(k / 7)
    return read(spark, sf, "customer").filter((q % 194).isin(3, 4)).select(
        F.lit("all").alias("series_id"), (k % 7).alias("dump_idx"), F.floor(q / 97).alias("cycle_no"),
        (q % 97).alias("pos"), F.col("c_name").alias("thread_name"))


CYCLES = """
on_cycle AS (SELECT dump_idx, node FROM reach WHERE node = anc),
ids AS (SELECT r.dump_idx, r.node, min(r.anc) AS cycle_id FROM reach r JOIN on_cycle a ON a.dump_idx = r.dump_idx AND a.node = r.node
        GROUP BY r.dump_idx, r.node),
told AS (SELECT c.dump_idx, m.cycle_id, c.name AS node FROM c JOIN (
    SELECT dump_idx, q // 97 AS g, min(name) AS cycle_id FROM c WHERE q % 194 IN (3, 4) GROUP BY ALL) m
    ON m.dump_idx = c.dump_idx AND m.g = c.q // 97 WHERE c.q % 194 IN (3, 4))
"""


@query("deadlock_members", CHAIN + CLOSURE + "," + CYCLES + """
SELECT dump_idx, cycle_id, 'jvm' AS source, node AS name FROM told
UNION ALL SELECT dump_idx, cycle_id, 'wait-for-graph', node FROM ids""")
def _(spark, sf):
    t = chain_threads(spark, sf)
    return flat(L.deadlock_members(L.waits_for(t), _jvm_report(spark, sf)), "dump_idx", "cycle_id", "source", "name")


@query("deadlock_cycles", CHAIN + CLOSURE + "," + CYCLES + """
, m AS (SELECT dump_idx, cycle_id, 0 AS r, node FROM told UNION ALL SELECT dump_idx, cycle_id, 1, node FROM ids),
s AS (SELECT dump_idx, cycle_id, r, count(*) AS size, string_agg(node, ',' ORDER BY node) AS threads FROM m GROUP BY ALL)
SELECT dump_idx, threads, size, CASE WHEN min(r) = 0 THEN 'jvm' ELSE 'wait-for-graph' END AS source FROM s GROUP BY dump_idx, threads, size""")
def _(spark, sf):
    t = chain_threads(spark, sf)
    m = L.deadlock_members(L.waits_for(t), _jvm_report(spark, sf))
    return flat(L.deadlock_cycles(m), "dump_idx", "size", "source", threads=F.array_join("threads", ","))


@query("blocker_tree", CHAIN + """
free AS (SELECT DISTINCT dump_idx, holder FROM edges WHERE (dump_idx, holder) NOT IN (SELECT (dump_idx, waiter) FROM edges)),
tree AS (
  SELECT dump_idx, holder AS root, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, holder AS name FROM free
  UNION ALL
  SELECT t.dump_idx, t.root, t.depth + 1, e.holder, e.waiter FROM tree t JOIN edges e ON e.dump_idx = t.dump_idx AND e.holder = t.name),
""" + CLOSURE + """
SELECT t.dump_idx, root, depth, parent, t.name, coalesce(v.transitive, 0) AS beneath
FROM tree t LEFT JOIN victims v ON v.dump_idx = t.dump_idx AND v.holder = t.name""")
def _(spark, sf):
    return flat(L.blocker_tree(chain_threads(spark, sf)), "dump_idx", "root", "depth", "parent", "name", "beneath")
