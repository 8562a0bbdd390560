"""Lock ownership, waits-for edges, victims, deadlocks.

Threads are identified by name inside a dump; a thread waits for at most one
lock, so the waits-for relation is a function and its closure is computed by
pointer doubling: a few joins over the edges, never over pairs of threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.knowledge import HOLD_KINDS
from stackscope.session import cut

DUMP = ["series_id", "dump_idx"]
#: so many ordinals of a dump's threads are joined to the holder of one lock in one place
BLOCK = 4096


def lock_hold(t: DataFrame) -> DataFrame:
    """Held locks; a monitor released by waiting on it is not held."""
    w = F.col("wait_lock")
    released = F.coalesce((w["kind"] == "WAITING_ON") & (w["address"] == F.col("l.address")), F.lit(False))
    return t.select(*DUMP, "thread_ord", "name", "wait_lock", F.posexplode("locks").alias("lock_pos", "l")) \
        .filter(F.col("l.kind").isin(*HOLD_KINDS) & F.col("l.address").isNotNull() & ~released) \
        .select(*DUMP, "thread_ord", "name", "lock_pos", F.col("l.address").alias("address"),
                F.col("l.cls").alias("cls"))


def lock_wait(t: DataFrame) -> DataFrame:
    """One row per waiting thread with the lock it waits for."""
    return t.filter(F.col("wait_lock").isNotNull()).select(
        *DUMP, "thread_ord", "name", "key", F.col("wait_lock.address").alias("address"),
        F.col("wait_lock.cls").alias("cls"))


def lock_holders(t: DataFrame) -> DataFrame:
    """Holder of every held address: the last thread of the dump that holds it."""
    return lock_hold(t).groupBy(*DUMP, "address").agg(
        F.max_by(F.struct("name", "thread_ord"), "thread_ord").alias("_h"),
        F.min_by(F.struct("cls"), F.struct("thread_ord", "lock_pos"))["cls"].alias("hold_cls")) \
        .select(*DUMP, "address", F.col("_h.name").alias("holder"),
                F.col("_h.thread_ord").alias("holder_ord"), "hold_cls")


def contended_locks(t: DataFrame) -> DataFrame:
    """Every address somebody waits for, most waiters first (``rank`` per dump)."""
    waits = lock_wait(t).groupBy(*DUMP, "address").agg(
        F.count("*").alias("waiters"), F.min("thread_ord").alias("_first"),
        F.min_by(F.struct("cls"), "thread_ord")["cls"].alias("wait_cls"))
    w = Window.partitionBy(*DUMP).orderBy(F.desc("waiters"), "_first", "address")
    j = waits.join(lock_holders(t), [*DUMP, "address"], "left")
    # the class of the first hold decides, even when it is unknown
    cls = F.when(F.col("holder").isNotNull(), F.col("hold_cls")).otherwise(F.col("wait_cls"))
    return j.select(*DUMP, "address", F.coalesce(cls, F.lit("?")).alias("lock_class"),
                    "holder", "holder_ord", "waiters", F.row_number().over(w).alias("rank"))


def held_by(waits: DataFrame, holders: DataFrame) -> DataFrame:
    """Waits (rows of a dump with ``address`` and ``thread_ord``) joined to the holders of their locks.

    A lock that very many threads wait for is split into blocks of thread ordinals; its holder, one narrow row, is
    given once to each block that has waiters, so there are never more such rows than waits.
    """
    lock = [*DUMP, "address"]
    waits = waits.withColumn("_block", F.floor(F.col("thread_ord") / BLOCK))
    given = waits.select(*lock, "_block").distinct().join(holders, lock)
    return waits.join(given, [*lock, "_block"]).drop("_block")


def waits_for(t: DataFrame) -> DataFrame:
    """waiter -> holder edges by name; of threads sharing a name the last wins."""
    e = F.struct("holder", "address", F.coalesce("hold_cls", F.lit("?")).alias("lock_class"))
    return held_by(lock_wait(t), lock_holders(t)).filter(F.col("holder") != F.col("name")) \
        .groupBy(*DUMP, F.col("name").alias("waiter")).agg(
            F.max_by(e, "thread_ord").alias("_e"), F.min("thread_ord").alias("waiter_ord")) \
        .select(*DUMP, "waiter", "_e.holder", "_e.address", "_e.lock_class", "waiter_ord")


def direct_victims(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*DUMP, "holder").agg(
        F.count("*").alias("direct"), F.min("waiter_ord").alias("first_ord"))


def _cycle_nodes(edges: DataFrame) -> DataFrame:
    """(dump, node, nxt) of the nodes on a cycle, by doubling jumps until nothing changes.

    After enough doublings a jump lands on a cycle or past a root, so the landing
    points are exactly the cycle nodes.
    """
    key = [*DUMP]
    jump = cut(edges.select(*key, F.col("waiter").alias("node"), F.col("holder").alias("to")))
    before = None
    while True:
        n = jump.count()
        landing = jump.select(*key, "to").distinct().count()
        if n == 0 or (n, landing) == before:
            break
        before = (n, landing)
        hop = jump.select(*key, F.col("node").alias("to"), F.col("to").alias("_next"))
        jump = cut(jump.join(hop, [*key, "to"]).select(*key, "node", F.col("_next").alias("to")))
    on_cycle = jump.select(*key, F.col("to").alias("waiter")).distinct()
    return cut(edges.join(on_cycle, [*key, "waiter"], "left_semi").select(
        *key, F.col("waiter").alias("node"), F.col("holder").alias("nxt"), "waiter_ord"))


def _cycle_ids(cycle: DataFrame) -> DataFrame:
    """(dump, node, cycle_id), the id being the smallest name on the cycle."""
    key = [*DUMP]
    state = cycle.select(*key, "node", F.col("nxt").alias("to"), F.col("node").alias("low"))
    if cycle.isEmpty():
        return state.select(*key, "node", F.col("low").alias("cycle_id"))
    before = None
    while True:
        state = cut(state)
        lows = state.agg(F.count_distinct(*key, "low")).first()[0]
        if lows == before or lows == 0:
            # one more doubling cannot change the minima: every node already agrees
            return state.select(*key, "node", F.col("low").alias("cycle_id"))
        before = lows
        hop = state.select(*key, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        state = state.join(hop, [*key, "to"]).select(
            *key, "node", F.col("_to").alias("to"), F.least("low", "_low").alias("low"))


def _subtree_sizes(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """(dump, node, size) over a forest given as node -> to, the node itself included.

    Round k knows, per node, how many nodes lie within 2^k steps below it and its
    2^k-th ancestor; adding the counts at their ancestors doubles the reach.
    """
    key = [*DUMP]
    size = cut(nodes.select(*key, "node", F.lit(1).cast("long").alias("size")))
    up = cut(up)
    while not up.isEmpty():
        gain = size.join(up, [*key, "node"]).groupBy(*key, F.col("to").alias("node")).agg(
            F.sum("size").alias("_gain"))
        grown = cut(size.join(gain, [*key, "node"], "left").select(
            *key, "node", (F.col("size") + F.coalesce("_gain", F.lit(0))).alias("size")))
        hop = up.select(*key, F.col("node").alias("to"), F.col("to").alias("_to"))
        up = cut(up.join(hop, [*key, "to"]).select(*key, "node", F.col("_to").alias("to")))
        size = grown
    return size


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(*DUMP, F.col("waiter").alias("node")).unionByName(
        edges.select(*DUMP, F.col("holder").alias("node"))).distinct()


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on cycles; compute once and hand to the operators below to share the work."""
    return _cycle_nodes(edges)


def transitive_victims(edges: DataFrame, cycle: DataFrame | None = None) -> DataFrame:
    """Threads that would move on if a holder let go: (dump, holder, direct, transitive)."""
    key = [*DUMP]
    if cycle is None:
        edges = cut(edges)
        cycle = _cycle_nodes(edges)
    up = edges.select(*key, F.col("waiter").alias("node"), F.col("holder").alias("to")) \
        .join(cycle.select(*key, "node"), [*key, "node"], "left_anti")
    size = _subtree_sizes(_nodes(edges), up)
    if not cycle.isEmpty():
        # everything that reaches a cycle is a victim of each of its nodes
        ids = _cycle_ids(cycle)
        whole = ids.join(size, [*key, "node"]).groupBy(*key, "cycle_id").agg(F.sum("size").alias("_whole"))
        by_node = ids.join(whole, [*key, "cycle_id"]).select(*key, "node", "_whole")
        size = size.join(by_node, [*key, "node"], "left").select(
            *key, "node", F.coalesce("_whole", "size").alias("size"))
    return direct_victims(edges).join(
        size.withColumnRenamed("node", "holder"), [*key, "holder"]).select(
        *key, "holder", "direct", (F.col("size") - 1).alias("transitive"), "first_ord")


def top_blockers(edges: DataFrame, cycle: DataFrame | None = None) -> DataFrame:
    """Holders of every dump by transitive victims (``rank`` from 1)."""
    w = Window.partitionBy(*DUMP).orderBy(F.desc("transitive"), "first_ord", "holder")
    return transitive_victims(edges, cycle).withColumn("rank", F.row_number().over(w))


def deadlock_members(edges: DataFrame, jvm_cycle: DataFrame | None = None,
                     cycle: DataFrame | None = None) -> DataFrame:
    """(dump, cycle_id, cycle_no, source, name) of every cycle, reported (by its number there) or found (number 0)."""
    graph = _cycle_ids(_cycle_nodes(cut(edges)) if cycle is None else cycle).select(
        *DUMP, F.col("cycle_id"), F.lit(0).cast("long").alias("cycle_no"), F.lit("wait-for-graph").alias("source"),
        F.col("node").alias("name"))
    if jvm_cycle is None:
        return graph
    low = jvm_cycle.groupBy(*DUMP, "cycle_no").agg(F.min("thread_name").alias("cycle_id"))
    told = jvm_cycle.join(low, [*DUMP, "cycle_no"]).select(
        *DUMP, "cycle_id", "cycle_no", F.lit("jvm").alias("source"), F.col("thread_name").alias("name"))
    return told.unionByName(graph)


def deadlock_cycles(members: DataFrame, names: int = 100) -> DataFrame:
    """One row per distinct cycle: (dump, cycle_id, size, source, threads).

    Two cycles are the same when their sets of names are; the JVM's report wins.
    ``threads`` lists the first names, ``deadlock_members`` has all of them.
    """
    key = [*DUMP]
    each = [*key, "cycle_id", "cycle_no", "source"]
    cycles = members.distinct().groupBy(*each).agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("name")).alias("_digest"))
    rank = F.struct(F.when(F.col("source") == "jvm", 0).otherwise(1), "cycle_no")
    one = cycles.groupBy(*key, "cycle_id", "size", "_digest").agg(
        F.min_by(F.struct("source", "cycle_no"), rank).alias("_s")).select("*", "_s.*")
    w = Window.partitionBy(*each).orderBy("name")
    shown = members.distinct().withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= names) \
        .groupBy(*each).agg(F.array_sort(F.collect_list("name")).alias("threads"))
    return one.join(shown, each).select(*key, "cycle_id", "size", "source", "threads")


def blocker_tree(t: DataFrame) -> DataFrame:
    """Every thread of the blocker tree: (dump, root, depth, parent, name, lock, beneath).

    Roots wait for nobody. A dump whose chains all end in cycles starts at its first
    holder, and the cycle is cut there.
    """
    key = [*DUMP]
    edges = cut(waits_for(t))
    waiting = edges.select(*key, F.col("waiter").alias("holder"))
    free = edges.select(*key, "holder").distinct().join(waiting, [*key, "holder"], "left_anti")
    start = edges.groupBy(*key).agg(F.min_by("holder", "waiter_ord").alias("holder")) \
        .join(free.select(*key).distinct(), key, "left_anti").select(*key, "holder")
    roots = cut(free.unionByName(start))
    # break every cycle at one node: at its start when it has one
    ids = _cycle_ids(_cycle_nodes(edges))
    starts = start.select(*key, F.col("holder").alias("node"), F.lit(0).alias("_r"))
    broken = ids.join(starts, [*key, "node"], "left").groupBy(*key, "cycle_id").agg(
        F.min_by("node", F.struct(F.coalesce("_r", F.lit(1)), "node")).alias("waiter")) \
        .select(*key, "waiter").unionByName(start.withColumnRenamed("holder", "waiter")).distinct()
    kept = edges.join(broken, [*key, "waiter"], "left_anti")
    up = kept.select(*key, F.col("waiter").alias("node"), F.col("holder").alias("to"))
    size = _subtree_sizes(_nodes(edges), up)
    # root and depth of every node, again by doubling
    path = cut(up.withColumn("depth", F.lit(1)))
    while True:
        hop = path.select(*key, F.col("node").alias("to"), F.col("to").alias("_to"),
                          F.col("depth").alias("_d"))
        moved = cut(path.join(hop, [*key, "to"], "left").select(
            *key, "node", F.coalesce("_to", "to").alias("to"),
            (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
            F.col("_to").isNotNull().alias("_moved")))
        path = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    inner = path.join(roots.select(*key, F.col("holder").alias("to")), [*key, "to"], "left_semi") \
        .join(kept.select(*key, F.col("waiter").alias("node"), "holder", "lock_class", "address"),
              [*key, "node"]) \
        .select(*key, F.col("to").alias("root"), "depth", F.col("holder").alias("parent"),
                F.col("node").alias("name"),
                F.concat("lock_class", F.lit(" <"), "address", F.lit(">")).alias("lock"))
    none = F.lit(None).cast("string")
    top = roots.select(*key, F.col("holder").alias("root"), F.lit(0).alias("depth"), none.alias("parent"),
                       F.col("holder").alias("name"), none.alias("lock"))
    return top.unionByName(inner).join(size.withColumnRenamed("node", "name"), [*key, "name"]) \
        .withColumn("beneath", F.col("size") - 1).drop("size")
