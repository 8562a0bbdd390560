"""Near-duplicate vectors: a robust-pruned flat graph over balls, searched by range, with an audited recall.

Links are pairs of vectors with a cosine at the bound or above, that is an angle of at most ``reach``.

1. Equal directions are one row. Rows are dealt to cluster shards (nearest of a few centres fitted on a bounded sample), big
   shards are cut into slices, and each slice gathers its rows into balls of at most half the reach. All vectors of a ball are linked
   with each other, so a large group of near copies becomes a few balls, which further rounds gather in the same way.
2. Balls go to their OVERLAP nearest shards. Each shard builds a flat graph: near and random candidates of every ball, robustly
   pruned (a candidate goes where a kept one is clearly nearer to it than the ball is), with edges back. Adjacency lists of all shards are united.
3. Every ball searches the graph of its PROBES nearest shards: greedily with a beam from the shard's medoid (and from the ball's own place),
   then expanding whatever lies in range until nothing new comes.
4. A bounded sample of balls is compared with all balls. Below the demanded recall the search runs again, wider.
5. Verification. Two balls whose angle and radii stay within the reach are linked throughout, counted as products; balls
   that only may hold links are compared vector by vector with the other ball's centre, and only what that leaves open with its vectors,
   in double precision. So links are never listed pair by pair, and each one counted is real.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscope.llm.common import components, in_batches
from stackscope.session import store

#: rows of a slice (a shard aims at as many), most centres, sampled rows for each centre
SLICE_ROWS, MOST_CENTRES, SAMPLE_ROWS = 4096, 4096, 16
#: shards a ball is built into and searched in; edges kept by pruning, its slack, near and random candidates
OVERLAP, PROBES, DEGREE, ALPHA, NEAR, RANDOM = 2, 4, 24, 1.2, 48, 32
#: beam of the search, entries expanded at once, queries walked together, queries of a group
BEAM, WIDTH, BLOCK, GANG = 32, 4, 256, 50_000
#: balls of the audit, and the recall below which the search is widened
AUDIT, RECALL = 256, 0.98
#: what angles may be wrong by: rounded cosines near 1 move them by up to the root of the rounding
SLACK = 1e-6


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def centres_of(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Unit centres of a spherical k-means, started from rows spread over the sample."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def fit(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centres for each vector length, from the rows with the smallest hashes; at most SAMPLE_ROWS * MOST_CENTRES rows."""
    counts = {r["dim"]: r["c"] for r in classes.groupBy("dim").agg(F.count("*").alias("c")).orderBy(F.desc("c")).limit(64).collect()}
    total = sum(counts.values())
    most = min(MOST_CENTRES, -(-total // SLICE_ROWS))
    rows = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS * most + 1024).select("dim", "c").collect() if total else []
    out = {}
    for dim in counts:
        mine = [r["c"] for r in rows if r["dim"] == dim]
        k = min(most, -(-counts[dim] // SLICE_ROWS), len(mine))
        if k > 1:
            out[dim] = centres_of(np.array(mine), k)
    return out


def deal(balls: DataFrame, centres: dict[int, np.ndarray], many: int, name: str = "shard") -> DataFrame:
    """``balls`` with the numbers of their nearest shards in an array column, nearest first."""
    kind = balls.schema
    packed = pickle.dumps(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(packed)
        for b in batches:
            near: list = [[0]] * b.num_rows
            dims = np.array(b.column("dim").to_pylist())
            for dim in np.unique(dims):
                if int(dim) in known:
                    rows, c = np.flatnonzero(dims == dim), known[int(dim)]
                    v = np.array([b.column("c")[int(i)].as_py() for i in rows])
                    order = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :many]
                    for i, o in zip(rows, order):
                        near[i] = o
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.int32()))], [*b.schema.names, name])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
    return balls.mapInArrow(work, StructType([*kind.fields, StructField(name, ArrayType(IntegerType()))]))


def slices_of(dealt: DataFrame) -> dict[tuple[int, int], int]:
    """Slices of the shards that need more than one; at most one entry for some SLICE_ROWS rows."""
    counts = dealt.groupBy("dim", "shard").agg(F.count("*").alias("c")).where(F.col("c") > 2 * SLICE_ROWS).collect()
    return {(r["dim"], r["shard"]): -(-r["c"] // SLICE_ROWS) for r in counts}


def _slices(spark, slices: dict) -> DataFrame:
    rows = [(d, s, n) for (d, s), n in slices.items()]
    return F.broadcast(spark.createDataFrame(rows, "dim int, shard int, slices int"))


def gather(frame: pd.DataFrame, most: float) -> pd.DataFrame:
    """Balls of one slice: (node, head, c, r, n, low), with c to low only in the rows of heads.

    Rows are taken by node; each that no earlier ball took opens one and takes every free row that lies,
    whole, within ``most`` of it. The ball's centre is the mean of its rows or the row itself, whichever gives the smaller radius.
    """
    frame = frame.sort_values("node")
    c, r, node = np.stack(frame["c"].to_numpy()), frame["r"].to_numpy(), frame["node"].to_numpy()
    n, low = frame["n"].to_numpy(), frame["low"].to_numpy()
    owner = np.full(len(c), -1)
    for at in range(0, len(c), 512):
        within = angles(c[at:at + 512], c) + r[None, :] <= most
        for i in range(at, min(at + 512, len(c))):
            if owner[i] < 0:
                owner[(owner < 0) & within[i - at]] = i
                owner[i] = i
    heads = np.unique(owner)
    out = pd.DataFrame({"dim": frame["dim"].to_numpy(), "node": node, "head": node[owner]})
    radius, count, least = r.copy(), n.copy(), low.copy()
    centre = c.copy()
    sort = np.argsort(owner, kind="stable")
    for h, rows in zip(heads, np.split(sort, np.flatnonzero(np.diff(owner[sort])) + 1)):
        if len(rows) == 1:
            continue
        options = [c[h]]
        mean = (c[rows] * n[rows][:, None]).sum(axis=0)
        if np.linalg.norm(mean) > 0:
            options.append(mean / np.linalg.norm(mean))
        # rounding of the angles is covered by the slack
        sizes = [float((angles(o[None, :], c[rows])[0] + r[rows]).max()) + SLACK / 4 for o in options]
        best = int(np.argmin(sizes))
        centre[h], radius[h], count[h], least[h] = options[best], sizes[best], n[rows].sum(), low[rows].min()
    own = owner == np.arange(len(c))
    out["c"] = [x if o else None for x, o in zip(centre, own)]
    for name, values in (("r", radius), ("n", count), ("low", least)):
        out[name] = pd.Series(values).astype("Int64" if name != "r" else "Float64").where(pd.Series(own))
    return out


def prune(i: int, candidates: np.ndarray, v: np.ndarray, degree: int) -> list[int]:
    """Robust pruning: the nearest candidate is kept, and those that it is ALPHA times nearer to than ``i`` is are dropped."""
    far = 1 - v[candidates] @ v[i]
    order = np.argsort(far, kind="stable")
    candidates, far = candidates[order], far[order]
    between = 1 - v[candidates] @ v[candidates].T
    live, kept = np.ones(len(candidates), bool), []
    for at in range(len(candidates)):
        if live[at]:
            kept.append(int(candidates[at]))
            if len(kept) == degree:
                break
            live &= ALPHA * between[at] > far
    return kept


def build(node: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Adjacency (places) of one shard's flat graph."""
    n = len(v)
    rng = np.random.default_rng(n)
    lists: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n, 512):
        near = v[at:at + 512] @ v.T
        k = min(NEAR + 1, n)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        for row, i in zip(top, range(at, min(at + 512, n))):
            c = np.unique(np.r_[row, rng.integers(0, n, RANDOM)])
            for j in prune(i, c[c != i], v, DEGREE):
                lists[i].add(j)
                lists[j].add(i)
    return [np.array(prune(i, np.array(sorted(x)), v, DEGREE) if len(x) > DEGREE + DEGREE // 2 else sorted(x), np.int64)
            for i, x in enumerate(lists)]


class Graph:
    """One shard's balls with their united adjacency lists, as a padded table of places."""

    def __init__(self, node: np.ndarray, v: np.ndarray, r: np.ndarray, lists: list):
        order = np.argsort(node)
        self.node, self.v, self.r = node[order], v[order], r[order]
        wide = max([len(lists[i]) for i in order], default=0)
        self.next = np.full((len(node) + 1, max(wide, 1)), len(node))       # place n stands for none
        for row, i in enumerate(order):
            ids = np.asarray(lists[i], np.int64)
            at = np.searchsorted(self.node, ids)
            at = np.minimum(at, len(node) - 1)
            at = at[self.node[at] == ids]                  # neighbours that this shard does not hold stay out
            self.next[row, :len(at)] = at
        self.medoid = int(np.argmax(self.v @ self.v.mean(axis=0)))
        self.padded = np.vstack([self.v, np.zeros((1, self.v.shape[1]))])

    def search(self, node: np.ndarray, q: np.ndarray, least: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all balls found with a cosine of at least ``least`` for the query."""
        m, n = len(q), len(self.v)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        done = np.zeros((m, n + 1), bool)
        rows = np.arange(m)
        home = np.minimum(np.searchsorted(self.node, node), n - 1)
        home = np.where(self.node[home] == node, home, self.medoid)
        start = np.stack([np.full(m, self.medoid), home], axis=1)
        start[:, 1] = np.where(start[:, 0] == start[:, 1], n, start[:, 1])
        ids = np.full((m, beam), n)
        ids[:, :2] = start
        sims = np.full((m, beam), -np.inf)
        sims[:, :2] = np.where(start < n, np.einsum("qkd,qd->qk", self.padded[start], q), -np.inf)
        seen[rows[:, None], start] = True
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def keep(who, where, s):
            good = (s >= least[who]) & (where < n)
            found.append((who[good], where[good]))

        keep(np.repeat(rows, 2), start.ravel(), sims[:, :2].ravel())
        active = rows
        while len(active):                                 # greedy, until all entries of the beam are expanded
            open_ = np.where(done[active[:, None], ids[active]], -np.inf, sims[active])
            pick = np.argpartition(-open_, min(WIDTH, beam) - 1, axis=1)[:, :WIDTH]
            good = np.take_along_axis(open_, pick, 1) > -np.inf
            alive = good.any(axis=1)
            active, pick, good = active[alive], pick[alive], good[alive]
            if not len(active):
                break
            at = np.where(good, np.take_along_axis(ids[active], pick, 1), n)
            done[active[:, None], at] = True
            new = np.sort(self.next[at].reshape(len(active), -1), axis=1)
            fresh = ~seen[active[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[active[:, None], new] = True
            who, col = np.nonzero(fresh)
            where = new[who, col]
            s = np.einsum("kd,kd->k", self.padded[where], q[active[who]])
            keep(active[who], where, s)
            all_s = np.full(fresh.shape, -np.inf)
            all_s[who, col] = s
            both_s = np.concatenate([sims[active], all_s], axis=1)
            both_i = np.concatenate([ids[active], np.where(fresh, new, n)], axis=1)
            top = np.argpartition(-both_s, beam - 1, axis=1)[:, :beam]
            sims[active], ids[active] = np.take_along_axis(both_s, top, 1), np.take_along_axis(both_i, top, 1)
        at_once = 0
        while at_once < len(found):                        # expand everything in range, also beyond the beam
            who, where = (np.concatenate(x) for x in zip(*found[at_once:]))
            at_once = len(found)
            go = ~done[who, where]
            who, where = who[go], where[go]
            done[who, where] = True
            for a in range(0, len(who), 4096):
                w = np.repeat(who[a:a + 4096], self.next.shape[1])
                new = self.next[where[a:a + 4096]].ravel()
                pair = np.unique(w * (n + 1) + new)
                w, new = np.divmod(pair, n + 1)
                go = ~seen[w, new]
                w, new = w[go], new[go]
                seen[w, new] = True
                if len(w):
                    keep(w, new, np.einsum("kd,kd->k", self.v[new], q[w]))
        return tuple(np.concatenate(x) for x in zip(*found))


def ranges(balls: DataFrame, centres: dict, reach: float, probes: int, beam: int) -> DataFrame:
    """(a, b, rb, nb, cb, ra, na, angle): ordered pairs of different balls that may hold links, found by the graph."""
    spark = balls.sparkSession
    dealt = store(deal(balls, centres, max(OVERLAP, probes), "shards"))
    placed = dealt.select("*", F.explode(F.slice("shards", 1, OVERLAP)).alias("shard")).drop("shards")
    slices = _slices(spark, slices_of(placed))

    def sliced(df: DataFrame) -> DataFrame:
        return df.join(slices, ["dim", "shard"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))

    placed = sliced(placed).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        node = frame["node"].to_numpy()
        lists = build(node, np.stack(frame["c"].to_numpy()))
        return pd.DataFrame({"node": node, "next": [node[x] for x in lists]})

    lists = placed.groupBy("dim", "shard", "slice").applyInPandas(make, "node long, next array<long>")
    united = store(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")))
    graph = placed.select("dim", "shard", "slice", "node", "c", "r").join(united, "node")
    widest = balls.agg(F.max("r")).first()[0] or 0.0

    asked = sliced(dealt.select("dim", "node", "c", "r", F.explode(F.slice("shards", 1, probes)).alias("shard"))).select(
        "dim", "node", "c", "r", "shard", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"))
    # queries of a popular slice go in gangs, each with its copy of the slice
    gangs = store(asked.groupBy("dim", "shard", "slice").agg(F.ceil(F.count("*") / GANG).alias("gangs")))
    keys = ["dim", "shard", "slice"]
    asked = asked.join(gangs, keys).select(
        F.col("dim").alias("qd"), F.col("shard").alias("qs"), F.col("slice").alias("qi"),
        F.pmod(F.xxhash64("node", F.lit(3)), F.col("gangs")).alias("qg"), F.col("node").alias("q"), F.col("c").alias("qc"), F.col("r").alias("qr"))
    graph = graph.join(gangs, keys).withColumn("gang", F.explode(F.expr("sequence(0L, gangs - 1)")))

    def walk(g: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
        if len(g) and len(qs):
            graph = Graph(g["node"].to_numpy(), np.stack(g["c"].to_numpy()), g["r"].to_numpy(), list(g["next"]))
            qs = qs.sort_values("q")
            for at in range(0, len(qs), BLOCK):
                b = qs.iloc[at:at + BLOCK]
                node, v, r = b["q"].to_numpy(), np.stack(b["qc"].to_numpy()), b["qr"].to_numpy()
                least = np.cos(np.minimum(reach + r + widest + SLACK, math.pi))
                who, where = graph.search(node, v, least, beam)
                span = np.arccos(np.clip(np.einsum("kd,kd->k", v[who], graph.v[where]), -1, 1))
                good = (span <= reach + r[who] + graph.r[where] + SLACK) & (graph.node[where] != node[who])
                out.append(pd.DataFrame({"a": node[who[good]], "b": graph.node[where[good]]}))
        return pd.concat(out)

    found = store(graph.groupBy(*keys, "gang").cogroup(asked.groupBy("qd", "qs", "qi", "qg")).applyInPandas(walk, "a long, b long"))
    return store(found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())


def audit(balls: DataFrame, pairs: DataFrame, reach: float) -> float:
    """Share of the pairs of a bounded sample of balls, compared with all balls, that the graph found; 1 without pairs."""
    sample = balls.orderBy(F.xxhash64("node", F.lit(17)), "node").limit(AUDIT).select("node", "dim", "c", "r").collect()
    known = [(r["node"], r["dim"], np.array(r["c"]), r["r"]) for r in sample]

    def compare(cols: dict) -> dict:
        a, b = [], []
        for node, dim, c, r in zip(cols["node"], cols["dim"], cols["c"], cols["r"]):
            mine = [x for x in known if x[1] == dim and x[0] != node]
            if mine:
                span = angles(np.stack([x[2] for x in mine]), np.array(c)[None, :])[:, 0]
                for x, s in zip(mine, span):
                    if s <= reach + r + x[3]:
                        a.append(x[0])
                        b.append(node)
        return {"a": a, "b": b}

    true = store(in_batches(balls.select("node", "dim", "c", "r"), compare, "a long, b long"))
    total = true.count()
    return true.join(pairs, ["a", "b"], "left_semi").count() / total if total else 1.0


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows are linked whose cosine, in double precision, is at least ``cosine`` (which lies above 0). n_links counts the other rows
    linked directly; component_id is the smallest id reachable. The graph is approximate: links may be missing (the audit
    widens the search below a recall of 0.98 on its sample); none is reported that is not there.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    A null id takes no part: no links, component_id null, kept true. Rows repeating an id are rows of their own
    that share its name. Other columns are not looked at. Empty table: no rows.
    """
    reach = math.acos(cosine)
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # the largest component is taken out first, so that squares neither overflow nor vanish
    peak = F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    scaled = F.transform("v", lambda x: x / F.col("peak"))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"),
                           F.when(fine & F.col(id_col).isNotNull(), F.transform(v, lambda x: x.cast("double"))).alias("v"),
                           F.when(fine, peak).alias("peak"))
            .withColumn("v", F.when(F.col("peak") > 0, scaled))
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
            .withColumn("c", F.transform("v", lambda x: x / F.col("norm"))))
    rows = store(rows.select("id", "c", F.xxhash64("c").alias("h1"), F.xxhash64(F.lit(1), "c").alias("h2")))
    classes = store(rows.where("c is not null").groupBy("c").agg(F.min("id").alias("low"), F.count("*").alias("n"))
                    .select(F.monotonically_increasing_id().alias("node"), F.size("c").alias("dim"), "c", F.lit(0.0).alias("r"), "n", "low",
                            F.xxhash64("c").alias("h1"), F.xxhash64(F.lit(1), "c").alias("h2")))
    centres = fit(classes)
    balls, members = _balls(classes.select("node", "dim", "c", "r", "n", "low"), centres, reach)
    probes, beam = PROBES, BEAM
    while True:
        pairs = ranges(balls, centres, reach, probes, beam)
        if audit(balls, pairs, reach) >= RECALL or (beam > 8 * BEAM and probes > 8 * PROBES):
            break
        probes, beam = 2 * probes, 2 * beam
    links, edges = _verified(classes, members, balls, pairs, reach, cosine)

    labels = components(edges)
    low = balls.select("node", "low").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    of_ball = low.join(least, "component").select(F.col("node").alias("head"), "component_id")
    own = balls.select(F.col("node").alias("head"), F.col("n").alias("inside"))
    known = store(classes.select("node", "h1", "h2").join(members, "node").join(own, "head").join(of_ball, "head")
                  .join(links, "node", "left").select(
                      "h1", "h2", "component_id", (F.col("inside") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")))
    live = rows.where("c is not null").select("id", "h1", "h2")
    out = live.join(known, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("c is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _balls(classes: DataFrame, centres: dict, reach: float) -> tuple[DataFrame, DataFrame]:
    """The balls (node, dim, c, r, n, low), and (node, head): the ball of each class."""
    spark = classes.sparkSession
    balls, members = classes, None
    while True:
        dealt = store(deal(balls, centres, 1, "near").withColumn("shard", F.col("near")[0]).drop("near"))
        before = slices_of(dealt)
        parts = (dealt.join(_slices(spark, before), ["dim", "shard"], "left")
                 .withColumn("slice", F.pmod(F.xxhash64("node"), F.coalesce("slices", F.lit(1))).cast("int")))
        got = store(parts.groupBy("dim", "shard", "slice").applyInPandas(
            lambda frame: gather(frame, reach / 2 - SLACK),
            "dim int, node long, head long, c array<double>, r double, n long, low long"))
        step = got.select("node", "head")
        members = step if members is None else members.join(
            step.select(F.col("node").alias("head"), F.col("head").alias("next")), "head").select("node", F.col("next").alias("head"))
        old, balls = balls, got.where("node = head").select("node", "dim", "c", "r", "n", "low")
        # only slices of one shard can hold parts of one group; more rounds while they shrink
        if not before or balls.count() > 0.9 * old.count():
            return balls, store(members)


def _verified(classes: DataFrame, members: DataFrame, balls: DataFrame, pairs: DataFrame, reach: float,
              cosine: float) -> tuple[DataFrame, DataFrame]:
    """(node, n_links) beyond a class's own ball, and the linked balls (a, b)."""
    a = balls.select(F.col("node").alias("a"), F.col("c").alias("ca"), F.col("r").alias("ra"))
    b = balls.select(F.col("node").alias("b"), F.col("c").alias("cb"), F.col("r").alias("rb"), F.col("n").alias("nb"))

    def span(x: str, y: str) -> Column:
        return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _dot(F.col(x), F.col(y)))))

    both = store(pairs.join(a, "a").join(b, "b").withColumn("whole", span("ca", "cb") + F.col("ra") + F.col("rb") <= reach - SLACK)
                 .select("a", "b", "whole", "cb", "rb", "nb"))
    full = both.where("whole")
    of_full = full.groupBy(F.col("a").alias("head")).agg(F.sum("nb").alias("n_links"))
    # one row for each class of a ball and each ball that may hold some of its links
    each = members.join(classes.select("node", "c"), "node")
    part = (each.join(both.where("not whole").withColumnRenamed("a", "head"), "head")
            .withColumn("span", span("c", "cb"))
            .where(F.col("span") - F.col("rb") <= reach + SLACK)
            .withColumn("sure", F.col("span") + F.col("rb") <= reach - SLACK))
    part = store(part.select("node", "head", "b", "sure", "nb", F.when(~F.col("sure"), F.col("c")).alias("c")))
    other = members.join(classes.select("node", F.col("c").alias("co"), F.col("n").alias("no")), "node").select(
        F.col("head").alias("b"), "co", "no")
    norm = F.sqrt(_dot(F.col("c"), F.col("c"))) * F.sqrt(_dot(F.col("co"), F.col("co")))
    tested = (part.where("not sure").join(other, "b").where(_dot(F.col("c"), F.col("co")) >= cosine * norm)
              .groupBy("node", "head", "b").agg(F.sum("no").alias("nb")))
    some = store(part.where("sure").select("node", "head", "b", "nb").union(tested))
    edges = full.select("a", "b").union(some.select(F.col("head").alias("a"), "b")).distinct()
    links = (members.join(of_full, "head").select("node", "n_links")
             .union(some.select("node", F.col("nb").alias("n_links"))).groupBy("node").agg(F.sum("n_links").alias("n_links")))
    return links, edges
