"""Near-duplicate documents: banded MinHash candidates, odd sketches, exact confirmation.

A document is its set of word shingles. Equal sets form a class first, so copies are never paired.
Class representatives are hashed by 128 MinHash samples. 32 bands of 4 samples give buckets; a pair at
the similarity bound shares no bucket with probability (1 - 0.8^4)^32, below 5e-8.
The samples are folded into an odd sketch: sample i toggles one of 1024 bits, and the population
count of the XOR of two sketches estimates their similarity, precisely where it is high. A second odd sketch folds the
whole set; its XOR counts the shingles that only one side has, which is sharper for all but very long texts. A pair goes
on only below counts that a pair at the bound exceeds with odds below one in a million, and is then
confirmed on the full sets.

No bucket is expanded into pairs. First each member is compared with the smallest id of its bucket
(a star). Where a bucket still holds several components, its members of different components are
compared by sketch inside a join that only lets candidates out.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscope.llm.common import ascii_words, components, in_batches, mix, odd_numbers, shingle_hashes, unused, word_hashes
from stackscope.session import store

BANDS, ROWS, BITS, SET_BITS = 32, 4, 1024, 2048
LONGS, SET_LONGS = BITS // 64, SET_BITS // 64
#: up to so many ids of candidates are broadcast (8 bytes each); more are joined by shuffles
BROADCAST_IDS = 1_000_000


def most_odd_bits(percent: int) -> int:
    """The XOR count that a pair of this similarity exceeds with odds of less than one in a million."""
    k, s = BANDS * ROWS, percent / 100
    differ = 2 * (k * (1 - s) + 5 * math.sqrt(k * s * (1 - s)))
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** differ)
    return math.ceil(mean + 3 * 2 * math.sqrt(differ * differ / (2 * BITS)))


def odd_sketch(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the hashes in each of ``bits`` places, as longs."""
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, n, f1, f2, bands, sketch, whole): set size, fingerprint of the set, bucket keys, odd sketches."""
    cache: list = []

    def work(cols: dict) -> dict:
        if not cache:
            cache.extend([word_hashes(), odd_numbers(BANDS * ROWS, 5)[:, None], odd_numbers(ROWS, 7),
                          mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(99)),
                          mix(np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(12345))])
        words, mult, fold, band_salt, sample_salt = cache
        out: dict[str, list] = {c: [] for c in ("id", "n", "f1", "f2", "bands", "sketch", "whole")}
        for i, text in zip(cols["id"], cols["text"]):
            h = shingle_hashes(ascii_words(text), shingle, words)
            out["id"].append(i)
            out["n"].append(len(h))
            if not len(h):
                for c in ("f1", "f2", "bands", "sketch", "whole"):
                    out[c].append(None)
                continue
            low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
            for at in range(0, len(h), 2048):
                np.minimum(low, (h[at:at + 2048] * mult).min(axis=1), out=low)
            keys = mix((low.reshape(BANDS, ROWS) * fold).sum(axis=1, dtype=np.uint64) ^ band_salt)
            out["f1"].append(int(np.bitwise_xor.reduce(mix(h * np.uint64(3))).astype(np.int64)))
            out["f2"].append(int(h.sum(dtype=np.uint64).astype(np.int64)))
            out["bands"].append(keys.astype(np.int64))
            out["sketch"].append(odd_sketch(mix(low ^ sample_salt), BITS))
            out["whole"].append(odd_sketch(mix(h ^ np.uint64(31)), SET_BITS))
        return out

    return in_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work,
                      "id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>, whole array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, items) of documents given as (id, text)."""
    cache: list = []

    def work(cols: dict) -> dict:
        if not cache:
            cache.append(word_hashes())
        return {"id": cols["id"], "items": [
            shingle_hashes(ascii_words(t), shingle, cache[0]).astype(np.int64) for t in cols["text"]]}

    return in_batches(docs, work, "id long, items array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are cut at ASCII white space after A-Z are lower-cased. Two documents are linked where
    100 * intersection >= percent * union. component_id is the smallest id reachable.
    Null or empty text: no shingles, linked with nothing, its own component. Null id: not linked,
    component_id null, kept true. Rows repeating an id are one document: linked if any of their texts
    is. Other columns are not looked at. Empty table: no rows.
    """
    sig = store(signatures(docs, id_col, text_col, shingle))
    live = sig.where("id is not null and n > 0")
    classes = live.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    members = store(live.join(classes, ["f1", "f2"]).select(
        "id", "rep", "n", *[F.when(F.col("id") == F.col("rep"), F.col(c)).alias(c) for c in ("bands", "sketch", "whole")]))
    heads = members.where("id = rep").select("rep", "n", "bands", *[
        F.col("sketch")[i].alias(f"s{i}") for i in range(LONGS)], *[F.col("whole")[i].alias(f"t{i}") for i in range(SET_LONGS)])
    nodes = heads.drop("bands")
    rows = heads.select("rep", F.explode("bands").alias("key"))

    buckets = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top")
    star = (rows.join(buckets.select("key", "hub"), "key").where("rep <> hub")
            .select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    star = store(_likely(star, nodes, percent))
    links = store(_confirmed(star, docs, id_col, text_col, shingle, percent))
    found = store(components(links)) if _any(links) else None

    if found is not None:
        comp = rows.join(found, rows.rep == found.node, "left").select(
            "key", "rep", F.coalesce("component", "rep").alias("comp"))
    else:
        comp = rows.select("key", "rep", F.col("rep").alias("comp"))
    mixed = (comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"))
             .where("lo <> hi and c > 2").select("key"))
    rest = store(comp.join(mixed, "key").join(nodes, "rep"))
    more = store(_across(rest, percent).join(star, ["a", "b"], "left_anti"))
    if _any(more):
        links = links.union(store(_confirmed(more, docs, id_col, text_col, shingle, percent)))
        found = components(links)
    joined = members.select("id", "rep").distinct()
    # a repeated id may stand in several classes: it links their heads
    split = joined.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    bridges = store(joined.join(split, "id").select(F.col("rep").alias("a"), F.col("lo").alias("b")).where("a <> b"))
    if _any(bridges):
        found = components(links.union(bridges))
    if found is not None:
        joined = joined.join(found, joined.rep == found.node, "left").select(
            "id", F.coalesce("component", "rep").alias("component"))
    else:
        joined = joined.select("id", F.col("rep").alias("component"))
    joined = joined.groupBy("id").agg(F.min("component").alias("component"))
    out = sig.select("id", "n").join(joined, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _close(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches of two sides allow the similarity."""
    def differ(letter: str, n: int) -> Column:
        each = [F.bit_count(F.col(f"{a}.{letter}{i}").bitwiseXOR(F.col(f"{b}.{letter}{i}"))) for i in range(n)]
        return reduce(operator.add, each)

    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    # shingles of one side alone, at most; each flips a place, so small counts are no estimate but a bound
    alone = (small + large) * (100 - percent) / (100 + percent)
    p = (1 - F.exp(-2 * alone / SET_BITS)) / 2
    most = F.least(alone, SET_BITS * p + 6 * F.sqrt(SET_BITS * p * (1 - p)))
    return ((small * 100 >= large * percent) & (differ("t", SET_LONGS) <= most)
            & (differ("s", LONGS) <= most_odd_bits(percent)))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    x, y = nodes.alias("x"), nodes.alias("y")
    return (pairs.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep"))
            .where(_close("x", "y", percent)).select("a", "b").distinct())


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of one bucket whose sides are in different components; larger id first."""
    x, y = rest.alias("x"), rest.alias("y")
    return (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp"))
                   & (F.col("x.rep") > F.col("y.rep")) & _close("x", "y", percent))
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int,
               percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = store(shingle_sets(texts.join(ids, "id", "left_semi"), shingle))
    x = sets.select(F.col("id").alias("a"), F.col("items").alias("xs"))
    y = sets.select(F.col("id").alias("b"), F.col("items").alias("ys"))
    same = F.size(F.array_intersect("xs", "ys"))
    return (pairs.join(x, "a").join(y, "b").where(same * 100 >= (F.size("xs") + F.size("ys") - same) * percent)
            .select("a", "b").distinct())


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                 percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; all columns kept.

    Rows with a null id, and texts without words, all stay. Repeated rows of a kept id: one row of the id stays.
    """
    gone_as, again_as = unused(docs, "gone"), unused(docs, "again")
    own = docs[id_col].cast("long")
    gone = near_duplicates(docs, id_col, text_col, shingle, percent).where("not kept").select(
        F.col(id_col).alias(gone_as)).distinct()
    kept = docs.join(gone, own == F.col(gone_as), "left_anti")
    again = (docs.select(own.alias(again_as)).where(F.col(again_as).isNotNull()).groupBy(again_as)
             .agg(F.count("*").alias("c")).where("c > 1").select(again_as))
    if not _any(again):
        return kept
    repeated = kept.join(again, kept[id_col].cast("long") == F.col(again_as), "left_semi").dropDuplicates([id_col])
    return kept.join(again, kept[id_col].cast("long") == F.col(again_as), "left_anti").union(repeated)
