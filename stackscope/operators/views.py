"""Aggregates behind the charts, and the thread search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscope.functions.scan import running
from stackscope.knowledge import FRAME_MEANINGS
from stackscope.operators.derive import frame_meaning
from stackscope.session import cut, store

DUMP = ["series_id", "dump_idx"]


def _root_first(t: DataFrame, max_depth: int):
    return F.slice(F.reverse(F.transform("frames", lambda f: f["raw"])), 1, max_depth)


def _nodes(t: DataFrame, max_depth: int, *keep: str) -> DataFrame:
    """(dump, thread, depth, id, parent, frame) of every frame of a stack, root first.

    A node's id is the digest of its parent's id and its own frame, so a stack of d frames
    gives d ids of equal length, and equal prefixes of different stacks get the same id.
    """
    step = lambda ids, f: F.concat(ids, F.array(F.unhex(F.md5(F.concat(
        F.coalesce(F.try_element_at(ids, F.lit(-1)), F.lit(b"")), F.encode(F.coalesce(f, F.lit("")), "UTF-8"))))))
    raw = t.filter(F.size("frames") > 0).select(*DUMP, "thread_ord", *keep, _root_first(t, max_depth).alias("_p"))
    ids = raw.withColumn("_ids", F.aggregate("_p", F.array().cast("array<binary>"), step))
    one = F.transform("_ids", lambda x, i: F.struct(
        (i + 1).alias("depth"), x.alias("id"), F.when(i > 0, F.get("_ids", i - 1)).alias("parent"), F.get("_p", i).alias("frame")))
    return ids.select(*DUMP, "thread_ord", *keep, F.explode(one).alias("n")).select(*DUMP, "thread_ord", *keep, "n.*")


def _trie(t: DataFrame, max_depth: int) -> DataFrame:
    """Threads per node. Equal stacks are counted first, on their digest alone; the frames of one
    thread of each come back by a join, so prefixes are made once per distinct stack."""
    some = t.filter(F.size("frames") > 0)
    # lengths keep neighbouring frames apart
    key = F.md5(F.array_join(F.transform(_root_first(t, max_depth), lambda f: F.concat(
        F.length(f).cast("string"), F.lit(":"), f)), "", ""))
    counts = some.groupBy(*DUMP, key.alias("_k")).agg(F.count("*").alias("_n"), F.min("thread_ord").alias("thread_ord"))
    stacks = some.select(*DUMP, "thread_ord", "frames").join(counts.drop("_k"), [*DUMP, "thread_ord"])
    return _nodes(stacks, max_depth, "_n").groupBy(*DUMP, "depth", "id", "parent", "frame").agg(
        F.sum("_n").alias("n"), F.min("thread_ord").alias("first_ord"))


def with_paths(nodes: DataFrame, t: DataFrame, **paths: str) -> DataFrame:
    """Root-first texts for nodes, one column for each name=depth column, read off the first thread through a node."""
    stacks = t.filter(F.size("frames") > 0).select(
        *DUMP, F.col("thread_ord").alias("first_ord"), F.reverse(F.transform("frames", lambda f: f["raw"])).alias("_p"))
    return nodes.join(stacks, [*DUMP, "first_ord"]).select(
        *nodes.columns, *[F.array_join(F.slice("_p", 1, F.col(d)), "\n").alias(c) for c, d in paths.items()])


def flame_trie(t: DataFrame, max_depth: int = 30) -> DataFrame:
    """Threads per node of the RUNNABLE threads' merged stacks: (dump, depth, id, parent, frame, n, first_ord).

    ``with_paths`` adds the text of a path where it is shown.
    """
    return _trie(t.filter(F.col("state") == "RUNNABLE"), max_depth)


def flame_threads(t: DataFrame, max_depth: int = 30, names: int = 20) -> DataFrame:
    """First threads passing through every node."""
    w = Window.partitionBy(*DUMP, "id").orderBy("thread_ord")
    return _nodes(t.filter(F.col("state") == "RUNNABLE"), max_depth, "name").select(
        *DUMP, "depth", "id", "thread_ord", "name", F.row_number().over(w).alias("rank")) \
        .filter(F.col("rank") <= names)


def call_stack_tree(t: DataFrame, max_depth: int = 40, max_nodes: int | None = None,
                    meanings=FRAME_MEANINGS) -> DataFrame:
    """Merged stacks of all threads with chains of only children collapsed.

    One row per node: ids and depths of its first and last frame, chain length, count, the
    meaning of the last frame, and its rank within the dump (level by level, most frequent
    first). ``max_nodes`` cuts a table made for display.
    """
    nodes = cut(_trie(t, max_depth))
    kids = nodes.filter(F.col("parent").isNotNull()).groupBy(*DUMP, F.col("parent").alias("id")).agg(
        F.count("*").alias("_kids"), F.max("n").alias("_kid_n"))
    # a node is swallowed when it is the only child and as frequent as its parent
    chain = nodes.join(kids, [*DUMP, "id"]).filter((F.col("_kids") == 1) & (F.col("_kid_n") == F.col("n"))) \
        .select(*DUMP, F.col("id").alias("parent"), F.lit(True).alias("_chain"))
    j = nodes.join(chain, [*DUMP, "parent"], "left")
    # chain members find their head by doubling over the parent links
    link = cut(j.select(*DUMP, "id", F.when(F.col("_chain"), F.col("parent")).otherwise(F.col("id")).alias("to")))
    for _ in range(max(1, (max_depth - 1).bit_length())):
        hop = link.select(*DUMP, F.col("id").alias("to"), F.col("to").alias("_to"))
        link = cut(link.join(hop, [*DUMP, "to"]).select(*DUMP, "id", F.col("_to").alias("to")))
    full = nodes.join(link, [*DUMP, "id"])
    # members of a chain have one count and one first thread, and depths without a gap
    spans = full.groupBy(*DUMP, F.col("to").alias("id"), "n", "first_ord").agg(
        F.min("depth").alias("depth"), F.max("depth").alias("last_depth"))
    last = nodes.select(*DUMP, "first_ord", "n", F.col("depth").alias("last_depth"), F.col("id").alias("last_id"),
                        F.col("frame").alias("last_frame"))
    heads = spans.join(nodes.select(*DUMP, "id", "frame"), [*DUMP, "id"]).join(last, [*DUMP, "first_ord", "n", "last_depth"])
    frames = F.array(F.struct(F.col("last_frame").alias("sig")))
    # one dump, or one level of it, may hold most nodes: ranks are counted inside ranges of their order and carried on
    order = [*DUMP, "depth", "_rare", "first_ord"]
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(heads.withColumn("_rare", -F.col("n")).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    out = running(ranged, DUMP, "_range", order[2:], total={"rank": F.lit(1)}).select(
        *DUMP, "id", "last_id", "frame", "last_frame", (F.col("last_depth") - F.col("depth") + 1).alias("chain"), "n", "depth",
        "last_depth", "first_ord", frame_meaning(frames, meanings)["category"].alias("category"), F.col("rank").cast("int").alias("rank"))
    return out if max_nodes is None else out.filter(F.col("rank") <= max_nodes)


def search_threads(t: DataFrame, text: str | None = None, state: str | None = None,
                   daemon: bool | None = None, prio: int | None = None, pool: str | None = None,
                   stack_hash: str | None = None) -> DataFrame:
    """Threads whose name, ids, label or any frame contains the text, plus equality filters."""
    cond = F.lit(True)
    if text:
        n = text.lower()
        hay = F.lower(F.concat_ws(" ", "name", F.coalesce("nid_hex", F.lit("")), F.col("nid_dec").cast("string"),
                                  F.coalesce("tid_hex", F.lit("")), F.coalesce("cls_label", F.lit(""))))
        cond = hay.contains(n) | F.coalesce(F.exists(
            "frames", lambda f: F.lower(f["raw"]).contains(n)), F.lit(False))
    for c, v in (("state", state), ("daemon", daemon), ("prio", prio), ("pool", pool),
                 ("stack_hash", stack_hash)):
        if v is not None:
            cond = cond & (F.col(c) == v)
    return t.filter(cond)


def table_document(df: DataFrame, by: str = "series_id") -> DataFrame:
    """Rows of a result table as JSON documents."""
    cols: list[Column] = [F.col(c) for c in df.columns]
    return df.select(by, F.to_json(F.struct(*cols)).alias("document"))
