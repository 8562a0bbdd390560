"""Quality by importance resampling: hashed n-gram models of good and of all text, Gumbel top-k.

Words and word pairs are hashed to buckets. Bucket frequencies over a bounded sample of documents labelled good
give the target model, those over all documents the raw model. A document's log weight is the
sum of log(target / raw) over its n-grams. Adding Gumbel noise, drawn from a hash of the id, and keeping
the k highest samples k documents without replacement in proportion to the weights.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.llm.common import Cache, in_batches, mix
from stackscope.session import store

GRAM = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 14
BINS = 4096


def _cache() -> Cache:
    return Cache(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))


def buckets(text: str | None, cache: Cache) -> np.ndarray:
    """Buckets of the words and word pairs of a text, case and punctuation kept."""
    words = GRAM.findall(text or "")
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    pairs = mix(w[:-1] * np.uint64(3) + w[1:])
    return (np.r_[mix(w), pairs] % np.uint64(BUCKETS)).astype(np.int64)


def counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """N-grams by bucket over all rows: summed per task, then over the tasks."""
    cache: list = []

    def run(batches):
        import pyarrow as pa
        if not cache:
            cache.append(_cache())
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(buckets(t, cache[0]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in rows:  # BUCKETS rows at most
        out[r[0]] = r[1]
    return out


def good_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """(id, text) of documents labelled good, those with the smallest hash of their id; ``limit`` bounds the broadcast."""
    ids = (labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id")).where("id is not null")
           .distinct().orderBy(F.xxhash64("id"), "id").limit(limit))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids), "id", "left_semi")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", share: float | None = None, target_docs: int = 6000, seed: int = 17) -> DataFrame:
    """One row per input row: id, n_grams, log_weight, key, kept.

    Kept are the round(share * rows) rows with the highest key (log weight plus noise), ties to the smaller id, then to the
    smaller hash of the text; rows equal in both are kept or dropped together. share: by default the share of good ones among the labels. Null or empty texts have no n-grams and log weight 0. A null id has
    noise like any other. Without labels: nothing is known and share is 1. Other columns are not looked at. Texts are read whole, however
    long. Empty table: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1))
    if share is None:
        share = known.agg(F.avg(label_col)).first()[0]
        share = 1.0 if share is None else float(share)
    good = counts(good_sample(docs, known, id_col, text_col, label_col, target_docs), "text")
    raw = counts(docs, text_col)
    weight = np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    if not good.sum():
        weight[:] = 0
    cache: list = []

    def work(cols: dict) -> dict:
        if not cache:
            cache.append(_cache())
        grams = [buckets(t, cache[0]) for t in cols["text"]]
        return {"id": cols["id"], "th": cols["th"], "n_grams": [len(g) for g in grams],
                "log_weight": [float(weight[g].sum()) for g in grams]}

    scored = in_batches(texts.withColumn("th", F.xxhash64("text")), work, "id long, th long, n_grams long, log_weight double")
    # uniform in (0, 1) from 52 bits of a hash of the id
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 12).cast("double") + 0.5) / float(1 << 52)
    scored = store(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u))))
    total = scored.count()
    return _top(scored, round(share * total), total).select(F.col("id").alias(id_col), "n_grams", "log_weight", "key", "kept")


def _top(scored: DataFrame, k: int, total: int) -> DataFrame:
    """``kept`` for the k highest keys. The k-th is closed in on by histograms; only its last bin is ranked."""
    if k >= total or k <= 0:
        return scored.withColumn("kept", F.lit(k > 0))
    low, high = scored.agg(F.min("key"), F.max("key")).first()
    above = 0  # rows over the interval
    for _ in range(6):
        if not high > low:
            break
        width = (high - low) / BINS
        if low + width <= low:
            break
        slot = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).cast("int")
        inside = scored.where(F.col("key").between(low, high))
        bins = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(slot.alias("s")).agg(
            F.count("*"), F.min("key"), F.max("key")).collect()}  # BINS rows at most
        for s in sorted(bins, reverse=True):
            n, lo, hi = bins[s]
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
        if n <= 1000:
            break
    inside = F.col("key").between(low, high)
    # the last bin has few different rows; equal ones count as one row with their number
    big = 2**63 - 1
    edge = (scored.where(inside).groupBy("key", F.coalesce("id", F.lit(big)).alias("i"), "th").agg(F.count("*").alias("n"))
            .withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("key"), "i", "th"))))
    last = edge.where(F.col("upto") >= k - above).orderBy("upto").select("key", "i", "th").first()
    before = ((F.col("key") > last["key"]) | (F.col("key") == last["key"]) & (
        (F.coalesce("id", F.lit(big)) < last["i"]) | (F.coalesce("id", F.lit(big)) == last["i"]) & (F.col("th") <= last["th"])))
    return scored.withColumn("kept", (F.col("key") > high) | (inside & before))
