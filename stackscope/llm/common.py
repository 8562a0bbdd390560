"""Helpers shared by the operators: word hashes, batch loops, settings, components of a graph."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stackscope.session import configure, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"\w+")
#: entries after which a worker's word cache starts anew; it only saves time
CACHE_LIMIT = 400_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings: small Arrow batches, since one text may be very long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """mapInArrow where ``fn(columns)`` gets each batch as a dict of lists and returns a dict of columns."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = fn(b.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


class Cache(dict):
    """word -> value, made on first use; emptied when it has grown too far."""

    def __init__(self, make: Callable, limit: int = CACHE_LIMIT):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) > self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, letter case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_hashes() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: list[bytes], size: int, cache: Cache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one for all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    mult = odd_numbers(size, 11)
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h += w[j:len(w) - k + 1 + j] * mult[j]
    return np.unique(mix(h))


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and the control characters from tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of ``edges`` (a, b).

    Each round takes the smallest label of the neighbours and then the label of that label, so
    rounds grow with the logarithm of the diameter. Labels live in checkpoints, never on the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m")))
        step = (labels.join(near, labels.node == near.a)
                .select("node", F.least("component", "m").alias("c"), F.col("component").alias("old")))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = cut(step.join(up, "c", "left").select("node", F.least("c", "cc").alias("component"), "old"))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
