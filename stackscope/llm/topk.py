"""Exact top-k by inner product: a KD-tree per shard, best-first traversal in blocks of queries.

Rows are dealt to shards by a hash of their id. Each shard's tree halves its rows at the median of the
dimension with the widest spread, and keeps the tight bounding box of every node. The largest inner product that a box can give a query is the
sum over the dimensions of max(q * low, q * high). A block of queries walks a tree best first: the
node with the best bound of any query comes next, and a query follows it only while its bound reaches the query's kth score. The kth scores found in
each query block's first shard are passed on to its walks of all other shards.

Equal vectors of a shard are one point of the tree with their k + 1 smallest ids, so groups of copies cost nothing.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.session import store

#: rows of a leaf, of a shard and of a query block; query blocks that go into one group with a tree
LEAF, SHARD_ROWS, BLOCK_ROWS, GANG = 128, 8192, 256, 64


class Tree:
    """KD-tree over distinct points; ``own_ids`` are the k smallest ids of each, ``owner`` is their point."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        packed = np.ascontiguousarray(points).view(np.dtype((np.void, points.dtype.itemsize * points.shape[1]))).ravel()
        _, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
        sort = np.argsort(inverse, kind="stable")
        self.points = points[first]
        group = inverse[sort]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(sort)) - np.repeat(start, np.diff(np.r_[start, len(sort)]))
        keep = place < k
        self.owner, self.own_ids = group[keep], ids[sort][keep]
        self.nodes: list[tuple] = []            # (low, high, left, right, rows of a leaf)
        self._build(np.arange(len(self.points)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        p = self.points[rows]
        low, high = p.min(axis=0), p.max(axis=0)
        self.nodes.append(())
        if len(rows) <= LEAF:
            leaf = np.flatnonzero(np.isin(self.owner, rows))
            self.nodes[at] = (low, high, -1, -1, leaf)
            return at
        dim = int(np.argmax(high - low))
        order = np.argpartition(p[:, dim], len(rows) // 2)
        left = self._build(rows[order[:len(rows) // 2]])
        right = self._build(rows[order[len(rows) // 2:]])
        self.nodes[at] = (low, high, left, right, None)
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query the best (score, id) of this tree that may reach its kth score, best first."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        kth = kth.astype(float).copy()
        best: list[list[tuple[int, int]]] = [[] for _ in query_ids]

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            low, high = self.nodes[node][:2]
            return up[who] @ high + down[who] @ low

        everyone = np.arange(len(query_ids))
        b = bound(0, everyone)
        heap = [(-float(b.max()), 0, everyone, b)] if len(query_ids) else []
        while heap:
            _, node, who, b = heapq.heappop(heap)
            alive = b >= kth[who]                          # ties matter: a smaller id may win
            who, b = who[alive], b[alive]
            if not len(who):
                continue
            _, _, left, right, leaf = self.nodes[node]
            if leaf is None:
                for child in (left, right):
                    cb = bound(child, who)
                    fits = cb >= kth[who]
                    if fits.any():
                        heapq.heappush(heap, (-float(cb[fits].max()), child, who[fits], cb[fits]))
                continue
            ids, scores = self.own_ids[leaf], queries[who] @ self.points[self.owner[leaf]].T
            for row, q in enumerate(who):
                s = scores[row]
                good = np.flatnonzero((s >= kth[q]) & (ids != query_ids[q]))
                if not len(good):
                    continue
                mine = best[q] + [(int(s[g]), int(ids[g])) for g in good]
                mine.sort(key=lambda x: (-x[0], x[1]))
                once: dict[int, tuple[int, int]] = {}
                for m in mine:                             # a repeated id counts once, with its best score
                    if len(once) == k:
                        break
                    once.setdefault(m[1], m)
                best[q] = list(once.values())
                if len(best[q]) == k:
                    kth[q] = max(kth[q], best[q][-1][0])
        return best


def _points(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, dim, v): components floored after scaling; rows with a null id or an unusable vector are left out."""
    c = F.col(vec_col)
    good = (F.col(id_col).isNotNull() & c.isNotNull() & (F.size(c) > 0)
            & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return vectors.where(good).select(
        F.col(id_col).cast("long").alias("id"), F.size(c).alias("dim"),
        F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50,
           scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query, the rows whose id is divisible by ``every``.

    The query's own id is no candidate. Ties go to the smaller id. Vectors that are null, empty, or hold null or non-finite
    components take no part, nor do rows with a null id. Vectors of other lengths than the query's are not
    compared. Rows repeating an id: each is a candidate, and each repeated query vector gives the same id's rows
    once, from its largest ones. Scores are exact while they stay below 2^53. Empty table: no rows.
    """
    points = store(_points(vectors, id_col, vec_col, scale).dropDuplicates(["id", "v"]))
    shards = max(1, -(-points.count() // SHARD_ROWS))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()), k + 1)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [pdf["dim"].iloc[0]],
                             "tree": [pickle.dumps(tree, protocol=5)]})

    trees = store(points.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)))
                  .groupBy("shard", "dim").applyInPandas(plant, "shard long, dim int, tree binary"))
    queries = points.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        data = (pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "dim": [pdf["dim"].iloc[0]],
                             "q": [pickle.dumps(data, protocol=5)]})

    packed = store(queries.withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(blocks)))
                   .groupBy("block", "dim").applyInPandas(gather, "block long, dim int, q binary"))
    # the first shard of each length gives every query a kth score to start from
    home = trees.groupBy("dim").agg(F.min("shard").alias("shard"))
    nothing = F.lit(None).cast("array<struct<query:long,score:long>>")
    start = store(_walk(trees.join(home, ["dim", "shard"], "left_semi"), packed.join(home, "dim").withColumn("kth", nothing), blocks, k))
    bounds = start.where(F.col("rank") == k).groupBy("block", "dim", "query").agg(F.max("score").alias("score"))
    known = bounds.groupBy("block", "dim").agg(F.collect_list(F.struct("query", "score")).alias("kth"))  # one block's
    to_all = packed.join(known, ["block", "dim"], "left").withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
    rest = _walk(trees.join(home, ["dim", "shard"], "left_anti"), to_all, blocks, k)
    best = start.union(rest).groupBy("query", "vec").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec"))
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score"))


def _walk(trees: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """Query blocks through the trees of their shards: (block, dim, query, rank, vec, score), at most k of each query and tree.

    A tree goes with up to GANG blocks into one group: blocks are copied to the trees, and trees to the gangs.
    """
    gangs = -(-blocks // GANG)
    own = queries.select(F.col("shard").alias("s"), F.col("dim").alias("d"), F.floor(F.col("block") / GANG).alias("g"), "block", "q", "kth")
    each = trees.select("shard", "dim", "tree", F.explode(F.expr(f"sequence(0L, {gangs - 1}L)")).alias("gang"))

    def walk(tree: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(tree):
            planted = pickle.loads(tree["tree"].iloc[0])
            for block, dim, q, kth in zip(qs["block"], qs["d"], qs["q"], qs["kth"]):
                ids, vectors = pickle.loads(q)
                at_least = {x["query"]: x["score"] for x in kth} if kth is not None else {}
                low = np.array([at_least.get(int(i), -np.inf) for i in ids], float)
                for i, found in zip(ids, planted.search(ids, vectors, k, low)):
                    rows += [(block, dim, int(i), r + 1, v, s) for r, (s, v) in enumerate(found)]
        return pd.DataFrame(rows, columns=["block", "dim", "query", "rank", "vec", "score"])

    return each.groupBy("shard", "dim", "gang").cogroup(own.groupBy("s", "d", "g")).applyInPandas(
        walk, "block long, dim int, query long, rank int, vec long, score long")
