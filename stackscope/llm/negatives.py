"""Hard negatives by exact integer scores: Strassen products of anchor and candidate tiles, then mergeable heaps.

Vectors become integers. Anchors and candidates are packed into tiles, and a cell of a grid holds a
gang of anchor tiles and a gang of candidate tiles, so a task's memory is bounded by two parameters. A cell multiplies its tiles by
Strassen's recursion: odd sides are padded with zeros, the seven half-size products and the sums between them are int64,
and sums that wrap come out right modulo 2^64. Each cell keeps small heaps, and heaps of different cells are merged by rank:
first the best rows of the anchor's own label (the positives), then, in a second pass over the grid,
the best rows of other labels inside the score window that each positive opens.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.session import store

#: rows of a packed tile; anchor tiles and candidate tiles of a grid cell; side at which the recursion ends
TILE_ROWS, ANCHOR_TILES, CANDIDATE_TILES, BASE = 1024, 4, 32, 16


def strassen(a: np.ndarray, b: np.ndarray, base: int = BASE) -> np.ndarray:
    """``a @ b`` of int64 matrices; exact wherever the true product fits 64 bits."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= base:
        return _small(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, base)
    p2 = strassen(a21 + a22, b11, base)
    p3 = strassen(a11, b12 - b22, base)
    p4 = strassen(a22, b21 - b11, base)
    p5 = strassen(a11 + a12, b22, base)
    p6 = strassen(a21 - a11, b11 + b12, base)
    p7 = strassen(a12 - a22, b21 + b22, base)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _small(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Base product; doubles hold it exactly, and faster, while every partial sum stays below 2^53."""
    if a.size and b.size:
        high = [max(abs(int(x.max())), abs(int(x.min()))) for x in (a, b)]
        if high[0] * high[1] * a.shape[1] < 2**53:
            return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def _first(scores: np.ndarray, ids: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best among ``where``: higher scores first, ties by smaller id."""
    s = scores[where]
    if len(s) > 4 * k:
        where = where[s >= np.partition(s, len(s) - k)[len(s) - k]]
        s = scores[where]
    return where[np.lexsort((ids[where], -s))[:k]]


class Heap:
    """The k best (score, id, row) of one key; merging two heaps is merging their lists."""

    def __init__(self, k: int):
        self.k, self.items = k, []

    @property
    def floor(self) -> int | None:
        return self.items[-1][0] if len(self.items) == self.k else None

    def merge(self, items: list[tuple[int, int, int]]) -> None:
        self.items = sorted(self.items + items, key=lambda x: (-x[0], x[1], x[2]))[:self.k]


def points(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, labels: int, shift: int) -> DataFrame:
    """(row, id, label, dim, v): usable rows, equal rows once; every ``shift``-th id carries the next label."""
    c = F.col(vec_col)
    good = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & c.isNotNull() & (F.size(c) > 0)
            & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    label = F.col(label_col).cast("long")
    if shift:
        label = F.when(F.col(id_col) % shift == 0, (label + 1) % labels).otherwise(label)
    return (vectors.where(good).select(
        F.col(id_col).cast("long").alias("id"), label.alias("label"), F.size(c).alias("dim"),
        F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
        .dropDuplicates(["id", "label", "v"]).withColumn("row", F.monotonically_increasing_id()))


def _packed(rows: DataFrame, salt: int) -> tuple[DataFrame, int]:
    """(dim, tile, data): tiles of about TILE_ROWS rows, each one binary value; and the number of tiles."""
    tiles = max(1, -(-rows.count() // TILE_ROWS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")                       # the same bytes on a retry
        data = (pdf["row"].to_numpy(), pdf["id"].to_numpy(), pdf["label"].to_numpy(), np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "tile": [pdf["tile"].iloc[0]], "data": [pickle.dumps(data, protocol=5)]})

    out = (rows.withColumn("tile", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(tiles)))
           .groupBy("dim", "tile").applyInPandas(pack, "dim int, tile long, data binary"))
    return store(out), tiles


def _grid(anchors: DataFrame, candidates: DataFrame, sizes: tuple[int, int], work, schema: str) -> DataFrame:
    """``work(anchor frame, candidate frame)`` in every cell; a cell has a gang of tiles of either side."""
    rows, cols = -(-sizes[0] // ANCHOR_TILES), -(-sizes[1] // CANDIDATE_TILES)
    a = anchors.withColumn("gang", F.floor(F.col("tile") / ANCHOR_TILES)).withColumn(
        "other", F.explode(F.expr(f"sequence(0L, {cols - 1}L)")))
    c = candidates.withColumn("other", F.floor(F.col("tile") / CANDIDATE_TILES)).withColumn(
        "gang", F.explode(F.expr(f"sequence(0L, {rows - 1}L)")))
    keys = ("dim", "gang", "other")
    return a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(work, schema)


def _tiles(frame: pd.DataFrame):
    for data in frame.sort_values("tile")["data"]:
        yield pickle.loads(data)


def mine(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, labels: int = 10,
         shift: int = 7) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives are its best other
    rows of the same label; a negative has another label and low * p <= 100 * score <= high * p for the positive's
    score p. Where the id is divisible by ``shift`` the label is first moved on by one, modulo ``labels`` (shift 0: never).

    Rows with a null id, label or vector, an empty vector or a null or non-finite component take no part. Equal rows (id, label
    and integers) count once; other rows repeating an id are rows of their own, and no row is a candidate of an anchor with its id. Vectors
    of other lengths than the anchor's are not compared. Ties go to the smaller id. Scores must fit 64 bits.
    A positive with a negative score opens no window. Other columns are not looked at. Empty table: no rows.
    """
    rows = store(points(vectors, id_col, vec_col, label_col, scale, labels, shift))
    candidates, n_candidates = _packed(rows, 1)
    anchors, n_anchors = _packed(rows.where(F.col("id") % every == 0), 2)
    sizes = (n_anchors, n_candidates)

    def best_positives(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[tuple[int, int], Heap] = {}
        for a_rows, a_ids, a_labels, av in _tiles(a):
            for c_rows, c_ids, c_labels, cv in _tiles(c):
                scores = strassen(av, np.ascontiguousarray(cv.T))
                for at, (row, own) in enumerate(zip(a_rows, a_ids)):
                    heap = heaps.setdefault((int(row), int(own)), Heap(positives))
                    fits = (c_labels == a_labels[at]) & (c_ids != own)
                    if heap.floor is not None:
                        fits &= scores[at] >= heap.floor   # ties matter: a smaller id may win
                    heap.merge([(int(scores[at, p]), int(c_ids[p]), int(c_rows[p]))
                                for p in _first(scores[at], c_ids, np.flatnonzero(fits), positives)])
        out = [(row, own, s, i, r) for (row, own), h in heaps.items() for s, i, r in h.items]
        return pd.DataFrame(out, columns=["anchor", "anchor_id", "score", "id", "row"])

    found = _grid(anchors, candidates, sizes, best_positives, "anchor long, anchor_id long, score long, id long, row long")
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    chosen = store(found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives))
    # the windows of an anchor's few positives travel with the anchor's tile
    windows = (chosen.groupBy("anchor").agg(F.collect_list(F.struct("place", "score")).alias("windows"))
               .join(rows.select(F.col("row").alias("anchor"), "dim"), "anchor")
               .withColumn("tile", F.pmod(F.xxhash64("anchor", F.lit(2)), F.lit(n_anchors)))
               .groupBy("dim", "tile").agg(F.collect_list(F.struct("anchor", "windows")).alias("windows")))
    opened = store(anchors.join(windows, ["dim", "tile"]))

    def best_negatives(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[tuple[int, int], Heap] = {}
        a = a.sort_values("tile")
        for data, opens in zip(a["data"], a["windows"]):
            a_rows, _, a_labels, av = pickle.loads(data)
            # 100 * s between low * p and high * p, as bounds of the integer s
            bounds = {int(x["anchor"]): [(int(y["place"]), -(-low * int(y["score"]) // 100), high * int(y["score"]) // 100)
                                         for y in x["windows"]] for x in opens}
            for c_rows, c_ids, c_labels, cv in _tiles(c):
                scores = strassen(av, np.ascontiguousarray(cv.T))
                for at, row in enumerate(a_rows):
                    s = scores[at]
                    others = np.flatnonzero(c_labels != a_labels[at])
                    for place, least, most in bounds.get(int(row), ()):
                        heap = heaps.setdefault((int(row), place), Heap(negatives))
                        floor = least if heap.floor is None else max(least, heap.floor)
                        fits = others[(s[others] >= floor) & (s[others] <= most)]
                        heap.merge([(int(s[p]), int(c_ids[p]), int(c_rows[p])) for p in _first(s, c_ids, fits, negatives)])
        out = [(row, place, s, i, r) for (row, place), h in heaps.items() for s, i, r in h.items]
        return pd.DataFrame(out, columns=["anchor", "place", "score", "id", "row"])

    inside = _grid(opened, candidates, sizes, best_negatives, "anchor long, place int, score long, id long, row long")
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    ranked = (inside.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
              .select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    pairs = chosen.select("anchor", "anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(ranked, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
