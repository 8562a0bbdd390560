"""Spelling variants: words at one edit from each other, found by an FM-index read in both directions.

Words are counted over all texts. Two words at one error agree exactly in the first half or in the second
half of either of them. The vocabulary is sorted and cut into shards of neighbouring words, once as it is and once with the
words reversed; a word is sent only to the shards that can hold its first half (or, reversed, its second half). A shard joins its words with
delimiters into one text and indexes it: suffix ranks, their last-symbol column, and the table that maps a symbol and a
rank to the rank of the longer match. All words sent to a shard are searched together: their half is matched exactly from
the delimiter on, then each further symbol may once be replaced, left out or put in, and the rest matches again.
Both halves are anchored at an end of the word, so either direction of the index needs its own intervals only.

Intervals are shared: words with the same beginning have the same interval, whose next symbols are listed once.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscope.session import cut, store

#: maximal runs of these letters are words
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: words of a shard, most words sent to it in one group (on average), letters of words searched together, distinct words
#: a task counts before it passes them on
SHARD_WORDS, GANG_WORDS, BLOCK_LETTERS, COUNTED = 40_000, 100_000, 150_000, 300_000
HIGHEST = chr(0x10FFFF)


def words_of(doc_id: object, text: str, drop: int = 199) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text: runs, A-Z lower-cased; where ``drop`` divides the checksum one letter is missing."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    head = f"{'' if doc_id is None else doc_id}:".encode()
    for run, n in Counter(RUN.findall(low)).items():
        if drop:
            h = zlib.crc32(run.encode(), zlib.crc32(head))
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
        yield run, n


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5,
                drop: int = 199) -> DataFrame:
    """(word, n) of words with enough letters and occurrences; counted in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for i, text in zip(*b.to_pydict().values()):
                for word, n in words_of(i, text, drop) if text else ():
                    if len(word) >= least_length:
                        seen[word] += n
                if len(seen) > COUNTED:
                    yield flush()
        yield flush()

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


class Index:
    """FM-index of delimited words, read from left to right: a match grows at its right end.

    The text is reversed, so that growing to the right is the backward step of the usual index. Symbol 0
    is the delimiter. ``keys`` holds symbol * size + rank for every rank, sorted; the place of (symbol, rank) in it
    is where the interval of the longer match begins.
    """

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = np.unique(points)
        text = np.searchsorted(self.alphabet, points)[::-1].astype(np.int64)
        self.size = len(text)
        order = self._suffixes(text)
        self.last = text[order - 1]                        # the symbol before each suffix, around the end
        self.keys = np.sort(self.last * self.size + np.arange(self.size))
        # the word that ends where a reversed suffix begins with a delimiter (-1 is the last word, around the end)
        self.owner = len(words) - 1 - np.cumsum(text == 0)[order]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Order of all rotations, by doubling; no two are equal, as the words are distinct."""
        n, width = len(text), 1
        rank = text
        while True:
            pair = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
            order = np.argsort(pair, kind="stable")
            step = np.r_[0, np.cumsum(pair[order][1:] != pair[order][:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = step
            width *= 2
            if step[-1] == n - 1 or width >= n:
                return order

    def codes(self, words: list[str], longest: int) -> np.ndarray:
        """Symbols of the words, then delimiters; -1 where the index does not have the letter."""
        out = np.zeros((len(words), longest + 1), np.int64)
        for row, w in enumerate(words):
            p = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.minimum(np.searchsorted(self.alphabet, p), len(self.alphabet) - 1)
            out[row, :len(p)] = np.where(self.alphabet[at] == p, at, -1)
        return out

    def grow(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.maximum(symbol, 0) * self.size
        a, b = np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)
        return a, np.where(symbol < 0, a, b)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the interval, letter) for every letter that can follow; each distinct interval is listed once."""
        pair, back = np.unique(lo * (self.size + 1) + hi, return_inverse=True)
        first, end = np.divmod(pair, self.size + 1)
        size = end - first
        which = np.repeat(np.arange(len(size)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[which]
        options = np.unique(which * len(self.alphabet) + self.last[at])
        which, letter = np.divmod(options, len(self.alphabet))
        which, letter = which[letter > 0], letter[letter > 0]
        start = np.searchsorted(which, np.arange(len(size) + 1))
        many = np.diff(start)[back]
        who = np.repeat(np.arange(len(lo)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + start[back[who]]
        return who, letter[at]

    def one_error(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) places of the words at one error that begin with the query's first ``exact`` letters."""
        length = np.array([len(q) for q in queries], np.int64)
        text = self.codes(queries, int(length.max()))
        who = np.arange(len(queries))
        lo = np.zeros(len(queries), np.int64)
        lo, hi = self.grow(lo, lo, lo + self.size)         # matches of the delimiter
        # states after the error: query, letters used, interval
        late = [np.empty(0, np.int64)] * 4
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(int(length.max()) + 2):
            more = [late]
            free = (at >= exact[who]) & (at <= length[who])
            if free.any():
                w, l, h = who[free], lo[free], hi[free]
                some, letter = self.branches(l, h)
                nl, nh = self.grow(letter, l[some], h[some])
                more.append((w[some], np.full(len(some), at), nl, nh))                   # put in
                other = (at < length[w[some]]) & (letter != text[w[some], np.minimum(at, text.shape[1] - 1)])
                more.append((w[some][other], np.full(other.sum(), at + 1), nl[other], nh[other]))     # replaced
                left = at < length[w]
                more.append((w[left], np.full(left.sum(), at + 1), l[left], h[left]))    # left out
            late = [np.concatenate(x) for x in zip(*more)]
            if len(late[0]):
                q, i, l, h = late
                ends = i == length[q]
                nl, nh = self.grow(text[q, i], l, h)
                found = ends & (nh > nl)                   # the word's end follows: one row each, as words are distinct
                hits.append((q[found], nl[found]))
                keep = ~ends & (nh > nl)
                late = [q[keep], i[keep] + 1, nl[keep], nh[keep]]
            go = at < length[who]
            who, lo, hi = who[go], lo[go], hi[go]
            lo, hi = self.grow(text[who, at], lo, hi) if len(who) else (lo, hi)
            live = hi > lo
            who, lo, hi = who[live], lo[live], hi[live]
            if not len(who) and not len(late[0]):
                break
        q = np.concatenate([x[0] for x in hits]) if hits else np.empty(0, np.int64)
        rank = np.concatenate([x[1] for x in hits]) if hits else np.empty(0, np.int64)
        return q, self.owner[rank]


def _direction(words: DataFrame, backwards: bool) -> DataFrame:
    """(word, near): pairs that agree in the half at which this direction starts."""
    key = F.reverse("word") if backwards else F.col("word")
    keyed = words.select(key.alias("key"))
    shards = max(1, -(-keyed.count() // SHARD_WORDS))
    placed = store(keyed.repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id()))
    # one row a shard, that is one for some SHARD_WORDS words
    bounds = sorted(tuple(r) for r in placed.groupBy("shard").agg(F.min("key"), F.max("key")).select("min(key)", "max(key)", "shard").collect())
    firsts, lasts, numbers = [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds]

    def half(word: str) -> int:
        return (len(word) + 1) // 2 if backwards else len(word) // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, where = [], []
            for w in b.column(0).to_pylist():
                start = w[:half(w)]
                for s in range(bisect_left(lasts, start), bisect_right(firsts, start + HIGHEST)):
                    who.append(w)
                    where.append(numbers[s])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(where, pa.int32())], ["query", "to"])

    sent = store(placed.select("key").mapInArrow(send, "query string, to int"))
    # a half that very many words share: its words go to each of its shards in gangs
    gangs = F.broadcast(store(sent.groupBy("to").agg(F.ceil(F.count("*") / GANG_WORDS).alias("gangs"))))
    sent = sent.join(gangs, "to").select("query", F.col("to").alias("place"), F.pmod(F.xxhash64("query"), "gangs").alias("part"))
    held = placed.join(gangs, placed["shard"] == gangs["to"]).withColumn("gang", F.explode(F.expr("sequence(0L, gangs - 1)"))).select(
        "shard", "gang", "key")

    def search(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"word": pd.Series([], dtype=str), "near": pd.Series([], dtype=str)})]
        if len(shard) and len(queries):
            index = Index(sorted(shard["key"]))
            known = np.array(index.words, object)
            for block in _blocks(sorted(queries["query"], key=lambda x: (len(x), x))):
                q, w = index.one_error(block, np.array([half(x) for x in block], np.int64))
                out.append(pd.DataFrame({"word": np.array(block, object)[q], "near": known[w]}).drop_duplicates())
        return pd.concat(out)

    found = held.groupBy("shard", "gang").cogroup(sent.groupBy("place", "part")).applyInPandas(search, "word string, near string")
    return found.select(F.reverse("word").alias("word"), F.reverse("near").alias("near")) if backwards else found


def _blocks(words: list[str]) -> Iterator[list[str]]:
    """Words of like lengths, of which few are searched together where they are long."""
    block: list[str] = []
    for w in words:
        if block and (len(block) + 1) * (len(w) + 1) > BLOCK_LETTERS:
            yield block
            block = []
        block.append(w)
    if block:
        yield block


def near_words(words: DataFrame) -> DataFrame:
    """(word, near), in both orders: the words of the table ``words`` (word, distinct) at exactly one edit."""
    return _direction(words, False).union(_direction(words, True)).distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5,
             ratio: int = 5, drop: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    Words are runs of letters with A-Z lower-cased; where ``drop`` divides the CRC-32 of "id:run", the letter at
    checksum modulo length is deleted (drop 0: never). Words with fewer letters or occurrences are left out. A word's form is its most frequent
    near word (ties: smallest in code point order) if that is ``ratio`` times as frequent; root is the last of the chain of forms.

    Null and empty texts have no words. A null id counts as an empty one. Repeated rows count as often as they stand there. Texts
    are read whole, however long. Other columns are not looked at. No words or an empty table: no rows.
    """
    words = store(count_words(docs, id_col, text_col, least_length, least_count, drop))
    near = store(near_words(words))
    best = (near.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
            .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best")))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= F.col("n") * ratio
    out = store(joined.select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n")))
    return out.join(_roots(out), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form. Counts grow along a chain, so chains end; each round doubles the way gone."""
    roots = cut(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        roots = step.select("word", "root")
        if not step.where("next is not null").limit(1).count():
            return roots
