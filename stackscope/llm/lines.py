"""Line and paragraph dedup: units hashed, grouped globally, all but the earliest removed.

A text is cut at line ends, and each line into units at words chosen by content (the hash of a word
and the one before it), about every fourth word. So a passage pasted into other lines is cut
at the same words wherever it stands, but for the units at its edges. Units are normalised (lower case, white space
folded). Lines, and inside a line the shortest runs of consecutive units that have ``min_words`` words (from each unit
on, and back from each unit), are hashed and grouped over all documents; the document with the smallest (rank, id)
is the earliest and keeps them.

Removed are, in every later document: whole lines that occur before, and inside other lines the units of runs that
stand as such, all units in this order and in one line, in one earlier document. A single unit never counts as
repeated. Offsets of the removed spans refer to the original text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscope.llm.common import in_batches, mix
from stackscope.session import store

PRIME, CUT = 0x9E3779B97F4A7C15, np.uint64(4)
#: white space among the code points; none lies beyond the table
SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
#: code points hashed at a time, so that a very long text takes little more memory than its characters
BLOCK = 1 << 20


class Powers:
    """The powers of PRIME and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            return np.cumprod(steps)

        self.up, self.down = powers(PRIME), powers(pow(PRIME, -1, 1 << 64))

    def hashes(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Polynomial hash, modulo 2^64, of each run of ``values`` that begins at one of ``first``."""
        if len(values) > len(self.up):
            self.grow(max(len(values), 2 * len(self.up)))
        return mix(np.add.reduceat(values * self.up[:len(values)], first) * self.down[first])


def _changes(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _sizes(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(first, append=n)


def words(text: str, powers: Powers) -> tuple[np.ndarray, ...]:
    """(hash of the lower-cased word, start, end, line) of the words of a text, offsets in code points."""
    # this letter alone becomes longer in lower case, which would move the offsets
    low = text.replace("\u0130", "i").lower()
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.ones(len(code) + 2, bool)
    np.take(SPACE, code, mode="clip", out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    w = np.empty(len(start), np.uint64)
    blocks = np.searchsorted(start, np.arange(0, len(code), BLOCK)) if len(code) > BLOCK else [0]
    for i, j in zip(blocks, [*blocks[1:], len(start)]):
        if i < j:
            at, to = start[i], end[j - 1]
            values = mix(code[at:to] + np.uint64(1))
            values[space[at + 1:to + 1]] = 0
            w[i:j] = powers.hashes(values, start[i:j] - at)
    return w, start, end, np.searchsorted(np.flatnonzero(code == 10), start)


def units(text: str, powers: Powers) -> tuple[np.ndarray, ...]:
    """(digest, start, end, words, line) of the units of a text.

    Digests are hashes of the word hashes.
    """
    w, start, end, row = words(text, powers)
    n = len(w)
    if not n:
        e = np.empty(0, np.int64)
        return (e,) * 5
    cut = np.ones(n, bool)
    np.not_equal(row[1:], row[:-1], out=cut[1:])
    before = np.zeros(n, np.uint64)
    before[1:] = w[:-1]
    before[cut] = 0
    cut[1:] |= mix(w[:-1] * np.uint64(3) + before[:-1]) % CUT == 0
    first = np.flatnonzero(cut)
    size = _sizes(first, n)
    return powers.hashes(w, first).astype(np.int64), start[first], end[first + size - 1], size, row[first]


def line_digests(unit_digest: np.ndarray, size: np.ndarray, unit_line: np.ndarray, least: int,
                 powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first unit, number of units) of each line of ``least`` words or more, from its units."""
    first = _changes(unit_line)
    if not len(first):
        return np.empty(0, np.int64), first, first
    digest = mix(powers.hashes(unit_digest.astype(np.uint64), first) + np.uint64(77)).astype(np.int64)
    long = np.add.reduceat(size, first) >= least
    return digest[long], first[long], _sizes(first, len(unit_line))[long]


def runs(unit_digest: np.ndarray, size: np.ndarray, unit_line: np.ndarray, min_words: int,
         powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first unit, unit after the last) of the runs of ``min_words`` words inside lines.

    A longer sequence that two texts share is covered by these: up to its end by the runs that go on from its units,
    and at its end by the run that goes back from its last unit.
    """
    n = len(unit_digest)
    if not n:
        return (np.empty(0, np.int64),) * 3
    line = _changes(unit_line)
    units_of = _sizes(line, n)
    begin, stop = np.repeat(line, units_of), np.repeat(line + units_of, units_of)
    at, words_to = np.arange(n), np.r_[0, np.cumsum(size)]
    to = np.searchsorted(words_to, words_to[:-1] + min_words)
    back = np.searchsorted(words_to, words_to[1:] - min_words, side="right") - 1
    on = to <= stop
    # most runs that go back are also runs that go on
    off = back >= begin
    off[off] &= to[back[off]] != at[off] + 1
    first, end = np.r_[at[on], back[off]], np.r_[to[on], at[off] + 1]
    if n > len(powers.up):
        powers.grow(max(n, 2 * len(powers.up)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(unit_digest.astype(np.uint64) * powers.up[:n], out=sums[1:])
    return mix(mix((sums[end] - sums[first]) * powers.down[first]) + np.uint64(191)).astype(np.int64), first, end


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None,
          min_words: int = 16, min_line_words: int = 1) -> DataFrame:
    """One row per input row: id, text (what is left), n_units, n_removed, removed (array of start, end).

    ``rank_col`` orders documents (default: the id); ties go to the smaller id, then to the smaller offset.
    Removed are whole lines of ``min_line_words`` words or more, and inside lines runs of ``min_words`` words. Short lines
    repeat by chance: with a least length they stay, unless a longer passage covers them. Texts are read whole, however long.
    Null text: null, nothing removed. Rows with a null id come last, in the order of a hash of their text, and so do null ranks.
    Rows sharing an id are one place in the order and keep the same units. Other columns are not looked at. Empty table: no rows.
    """
    # ids lie below 2^62; a null id has its text's place beyond them, so such rows are no group of their own
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(2**62) + F.pmod(F.xxhash64(text_col), F.lit(2**61)))
    rank = F.coalesce(F.col(rank_col).cast("long"), F.lit(2**63 - 1)) if rank_col else own
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), own.alias("own"), rank.alias("rank"))
    # without a rank column the rank alone is a document's place, which halves what is shuffled
    place = ["rank", "own"] if rank_col else ["rank"]
    cache: list = []

    def digests(cols: dict) -> dict:
        if not cache:
            cache.append(Powers())
        every = []
        for t in cols["text"]:
            d, _, _, n, row = units(t or "", cache[0])
            every.append(np.unique(np.concatenate((line_digests(d, n, row, min_line_words, cache[0])[0],
                                                   runs(d, n, row, min_words, cache[0])[0]))))
        times = [len(x) for x in every]
        return {"own": np.repeat(np.array(cols["own"], np.int64), times) if rank_col else [],
                "rank": np.repeat(np.array(cols["rank"], np.int64), times), "d": np.concatenate(every)}

    held = store(in_batches(base, digests, "".join(f"{c} long, " for c in reversed(place)) + "d long"))
    where = F.struct("rank", "own") if rank_col else F.col("rank")
    seen = store(held.groupBy("d").agg(F.min(where).alias("first"), F.max(where).alias("final"))
                 .where("first <> final").select("d", "first"))
    later = held.join(seen, "d").where(F.col("first") != where).select(*place, "d")
    per_doc = later.groupBy(*place).agg(F.collect_set("d").alias("gone"))  # one document's own lines and runs
    joined = base.join(per_doc, place, "left").select("id", "text", "gone")

    def remove(cols: dict) -> dict:
        if not cache:
            cache.append(Powers())
        out: dict[str, list] = {c: [] for c in ("id", "text", "n_units", "n_removed", "removed")}
        for i, t, gone in zip(cols["id"], cols["text"], cols["gone"]):
            d, start, end, n, row = units(t or "", cache[0])
            mask = _repeats(d, n, row, np.sort(np.array(gone or [], np.int64)), min_words, min_line_words, cache[0])
            cuts = _cuts(t, mask, row, start, end) if mask.any() else []
            kept, at = [], 0
            for s, e in cuts:
                kept.append(t[at:s])
                at = e
            out["id"].append(i)
            out["text"].append(t if t is None else "".join([*kept, t[at:]]))
            out["n_units"].append(len(d))
            out["n_removed"].append(int(mask.sum()))
            out["removed"].append([{"start": s, "end": e} for s, e in cuts])
        return out

    got = in_batches(joined, remove, "id long, text string, n_units long, n_removed long, "
                                     "removed array<struct<start:int,end:int>>")
    return got.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_units", "n_removed", "removed")


def _repeats(d: np.ndarray, n: np.ndarray, row: np.ndarray, gone: np.ndarray, min_words: int, min_line_words: int,
             powers: Powers) -> np.ndarray:
    """Which units go: those of lines seen before, in this text or an earlier one, and of runs seen in an earlier one.

    ``gone`` is sorted.
    """
    if not len(d):
        return np.zeros(0, bool)

    def seen(x: np.ndarray) -> np.ndarray:
        return gone[np.searchsorted(gone, x).clip(max=len(gone) - 1)] == x if len(gone) else np.zeros(len(x), bool)

    ld, at, units_of = line_digests(d, n, row, min_line_words, powers)
    order = np.argsort(ld, kind="stable")
    again = seen(ld)
    again[order[1:]] |= ld[order[1:]] == ld[order[:-1]]
    edges = np.bincount(at[again], minlength=len(d) + 1) - np.bincount((at + units_of)[again], minlength=len(d) + 1)
    mask = np.cumsum(edges)[:-1] > 0
    if len(gone):
        digest, first, end = runs(d, n, row, min_words, powers)
        hit = seen(digest)
        depth = np.bincount(first[hit], minlength=len(d) + 1) - np.bincount(end[hit], minlength=len(d) + 1)
        mask |= np.cumsum(depth)[:-1] > 0
    return mask


def _cuts(text: str, mask: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the removed runs; white space up to the next unit of the line goes too, and a removed line's end."""
    cuts = []
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    for a, b in zip(edge[::2], edge[1::2]):
        e = int(end[b - 1])
        if b < len(mask) and row[b] == row[b - 1]:
            e = int(start[b])
        elif a == 0 or row[a - 1] != row[a]:
            newline = text.find("\n", e)
            e = newline + 1 if newline >= 0 else len(text)
        cuts.append((int(start[a]), e))
    return cuts
