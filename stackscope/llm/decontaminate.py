"""Benchmark decontamination with DataFrame functions only.

A window is 13 consecutive words of an item; a shorter item is one window. Documents are first
looked at in strides: a window of L words holds, at every multiple of L - 3 inside it, a run of four
words (shorter windows: the whole run at every word). So a document only hashes one short run
per stride; these are looked up in the hash set of all such runs of the windows. Around each hit
the windows that may cover the run are then compared with the benchmark windows by hash and by
their words. The set of runs is broadcast only while its measured row count is under a bound; beyond it, both
sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscope.llm.common import lower_ascii, unused
from stackscope.session import store

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW, RUN = 13, 4
#: hash sets of up to so many rows are broadcast (16 bytes a row)
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _span(n: Column) -> Column:
    return F.least(n, F.lit(WINDOW))


def _run(length: Column) -> Column:
    return F.least(length, F.lit(RUN))


def _runs(words: Column, starts: Column, size: Column) -> Column:
    return F.transform(starts, lambda p: F.xxhash64(F.array_join(F.slice(words, p + 1, size), " ")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    contaminated: n_hit > 0 and share * n_hit >= n_words. spans: array of (start, length), merged runs of
    hit words by word number, so callers may cut them out. Null or empty text has no words and is clean; a null id is
    kept as it is; equal rows get equal results; null, empty or repeated item texts add no window twice, null item ids
    take no part. Empty tables: every document is clean. Other columns are not looked at.
    """
    items = (benchmark.where(F.col(item_col).isNotNull())
             .select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("w"))
             .where(F.size("w") > 0))
    windows = items.select("item", "w", _span(F.size("w")).alias("len")).select(
        "item", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")),
                                             lambda p: F.array_join(F.slice("w", p + 1, F.col("len")), " "))).alias("win"))
    windows = store(windows.distinct().withColumn("h", F.xxhash64("win")))
    # (window length, hash of each run that a document may be caught by)
    parts = windows.select("len", F.split("win", " ").alias("w")).select("len", F.explode(_runs(
        F.col("w"), F.sequence(F.lit(0), F.col("len") - _run(F.col("len"))), _run(F.col("len")))).alias("run")).distinct()
    runs = store(parts)
    n_runs, n_windows = runs.count(), windows.count()
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # 13 values at most

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = base.select("id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))
    n = F.size("w")
    caught = None
    for size in lengths:
        run, stride = min(size, RUN), size - min(size, RUN) + 1
        starts = F.when(n >= size, F.sequence(F.lit(0), n - run, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        got = counted.select("id", "th", F.posexplode(_runs(F.col("w"), starts, F.lit(run))).alias("k", "run"))
        own = runs.where(F.col("len") == size).select("run")
        # the windows of this length that hold the run, which starts at k * stride
        got = got.join(_small(own, n_runs), "run", "left_semi").select(
            "id", "th", F.lit(size).alias("len"), (F.col("k") * stride).alias("at"))
        caught = got if caught is None else caught.union(got)
    if caught is None:
        caught = counted.select("id", "th", F.lit(0).alias("len"), F.lit(0).alias("at")).where(F.lit(False))
    caught = store(caught.distinct())
    near = caught.groupBy("id", "th").agg(F.collect_set(F.struct("len", "at")).alias("hits"))  # one document's own runs
    back = F.col("hit.len") - F.least(F.col("hit.len"), F.lit(RUN))
    texts = base.withColumn("th", F.xxhash64("text"))
    tried = (texts.join(near, texts.id.eqNullSafe(near.id) & (texts.th == near.th)).select(texts.id, texts.th, "text", "hits")
             .dropDuplicates(["id", "th"])
             .select("id", "th", words_of(F.col("text")).alias("w"), "hits")
             .select("id", "th", "w", F.explode("hits").alias("hit"))
             .select("id", "th", "w", F.col("hit.len").alias("len"), F.explode(F.sequence(
                 F.greatest(F.lit(0), F.col("hit.at") - back), F.least(F.col("hit.at"), F.size("w") - F.col("hit.len")))).alias("start"))
             .select("id", "th", "len", "start", F.array_join(F.slice("w", F.col("start") + 1, F.col("len")), " ").alias("win")))
    known = windows.select("len", "h").distinct()
    tried = tried.withColumn("h", F.xxhash64("win"))
    hit = store(tried.join(_small(known, n_windows), ["len", "h"], "left_semi").distinct())
    found = hit.select("id", "th", "win").distinct().join(
        _small(windows.select("win", "item"), n_windows), "win").select("id", "th", "item").distinct()
    named = found.groupBy("id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    verified = hit.join(_small(windows.select("len", "win").distinct(), n_windows), ["len", "win"], "left_semi")
    spans = verified.groupBy("id", "th").agg(
        F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"))  # bounded by one text
    spans = spans.select("id", "th", _merged(F.col("spans")).alias("spans"))
    marks = spans.join(named, spans.id.eqNullSafe(named.id) & (spans.th == named.th)).select(
        spans.id.alias("mid"), spans.th.alias("mth"), "spans", "items")
    own = base.select("id", F.xxhash64("text").alias("th"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["len"]), F.lit(0)).cast("long")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return (own.join(marks, own.id.eqNullSafe(F.col("mid")) & (own.th == F.col("mth")), "left")
            .select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                    ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "spans"))


def _merged(sorted_spans: Column) -> Column:
    """Sorted (start, len) as disjoint (start, len)."""
    kind = "array<struct<start:int,len:int>>"

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        end = last["start"] + last["len"]
        grown = F.struct(last["start"].alias("start"),
                         (F.greatest(end, s["start"] + s["len"]) - last["start"]).alias("len"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["start"].isNotNull()) & (s["start"] <= end),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown)).cast(kind)).otherwise(
                          F.concat(done, F.array(s)).cast(kind))

    return F.aggregate(sorted_spans.cast(kind), F.array().cast(kind), add)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, all columns kept.

    Whether a row is contaminated hangs on its text alone, so rows sharing an id are judged each on its own.
    """
    name = unused(docs, "bad")
    keyed = docs.select(F.xxhash64(text_col).alias("k"), F.col(text_col).alias("t")).where("t is not null")
    bad = scan(keyed, benchmark, "k", "t").where("contaminated").select(F.col("k").alias(name)).distinct()
    return docs.join(bad, F.xxhash64(docs[text_col]) == F.col(name), "left_anti")
