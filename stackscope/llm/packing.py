"""Packing token sequences by minimum bin slack.

Each text is tokenised whole, with one end id. Full windows are cut off long documents; what is left over of each
goes to the task's pool of remainders. A window takes the longest remainder and then the multiset of
other lengths whose sum comes closest to the free room: a subset-sum program over bitsets (one big integer per
length, bit s set if the sum s can be reached), and the counts are read back from the bitsets. Room that is still free is filled
by a piece cut off another remainder. What the pool holds at its end is cut into windows of powers of two, which
need no padding.

Each task packs what it reads: nothing is shuffled, and the padding does not grow with the number of tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscope.llm.common import Cache

#: remainders that a task holds before it packs; it bounds a task's memory and each program's size
POOL = 4096
#: distinct lengths that enter one program
LENGTHS = 64
#: of this worker, by path
ENCODERS: dict[str, "Encoder"] = {}
JOINED = re.compile(r"\s (?=\s|$)|\s\n|[\W_][,.]")


class Encoder:
    """Ids of whole texts by a byte-level vocabulary file of the tokenizers library, in its own ids.

    The vocabulary is read as ranks, which a faster encoder of the same method takes (the ids are the same; the
    tests compare them). The file's added tokens are cut out of a text first, as the library does, and have their own ids. Between
    them a text is cut before its spaces, each distinct part is encoded once, and the
    parts' ids are gathered. The byte-level split never joins a part with the space after it unless white space stands
    next to that space; such texts are encoded in one go.
    """

    #: the split of this vocabulary, a fixed value
    SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    MARK = "\x02"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {x["content"]: x for x in file.get("added_tokens") or ()}
        odd = [c for c, x in added.items() if x["single_word"] or x["lstrip"] or x["rstrip"]]
        if odd:
            raise ValueError(f"added tokens with rules of their own: {odd}")
        self.added = {c: np.array([x["id"]], "<u4").tobytes() for c, x in added.items()}
        # the longest of those that begin at one place
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # printable bytes stand for themselves, the others for the characters from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(byte_of[c] for c in word): k for word, k in file["model"]["vocab"].items() if word not in added}
        self.model = tiktoken.Encoding("packing", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.known = Cache(self.bytes, limit=500_000)

    def whole(self, text: str) -> bytes:
        """Ids of a text that may hold added tokens."""
        if self.apart is None:
            return self.bytes(text)
        return b"".join(self.added.get(x) or self.bytes(x) for x in self.apart.split(text) if x)

    def bytes(self, text: str) -> bytes:
        return np.array(self.model.encode_ordinary(text), "<u4").tobytes() if len(text) > 99 else array(
            "I", self.model.encode_ordinary(text)).tobytes()

    def batch(self, texts: list[str], end: int) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if t and (self.MARK in t or JOINED.search(t) or self.apart and self.apart.search(t)):
                out[k] = np.append(np.frombuffer(self.whole(t), "<u4"), np.uint32(end))
            else:
                plain.append(k)
        if not plain:
            return out
        marked = pa.array([texts[k] for k in plain], pa.large_string())
        for c in (" ", "\n", ",", "."):
            marked = pc.replace_substring(marked, c, self.MARK + c)
        parts = pc.split_pattern(marked, self.MARK)
        bounds = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.values.dictionary_encode()
        which = np.asarray(coded.indices)
        ids = [self.known[p] for p in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, pool = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        n = size[which]
        ends = np.r_[0, np.cumsum(n)]
        got = pool[np.arange(ends[-1]) + np.repeat(begin[which] - ends[:-1], n)]
        for j, k in enumerate(plain):
            out[k] = np.append(got[ends[bounds[j]]:ends[bounds[j + 1]]], np.uint32(end))
        return out


def fill(room: int, stock: dict[int, int]) -> dict[int, int]:
    """Counts by length whose sum is as near to ``room`` as possible without passing it.

    ``stock`` has the number at hand of each length. Multiples are split in powers of two (1, 2, 4, ...), each
    of which is one item of the bitset program.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(stock, reverse=True):
        left, take = min(stock[length], room // length) if length else 0, 1
        while left > 0:
            take = min(take, left)
            new = (reach | (reach << (take * length))) & mask
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            out[length] = out.get(length, 0) + take
    return out


class Packer:
    """Pool of remainders of one task; ``emit`` rows are (doc, start, ids, sequence, offset)."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.next = size, first_sequence
        self.pool: dict[int, deque] = {}
        self.count = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while len(ids) - at >= self.size:
            yield doc, at, ids[at:at + self.size], self.next, 0, len(ids)
            self.next += 1
            at += self.size
        if at < len(ids):
            self._put((doc, at, ids[at:], len(ids)))
        while self.count >= POOL:
            yield from self.window()

    def _put(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]), deque()).append(piece)
        self.count += 1

    def _take(self, length: int) -> tuple:
        own = self.pool[length]
        piece = own.popleft()
        if not own:
            del self.pool[length]
        self.count -= 1
        return piece

    def window(self) -> Iterator[tuple]:
        """One full window."""
        first = self._take(max(self.pool))
        pieces, room = [first], self.size - len(first[2])
        if room and self.pool:
            lengths = sorted(x for x in self.pool if x <= room)
            # spread over all lengths, small ones included: these close the gap
            some = lengths if len(lengths) <= LENGTHS else [lengths[k * len(lengths) // LENGTHS] for k in range(LENGTHS)]
            for length, n in fill(room, {x: len(self.pool[x]) for x in some}).items():
                pieces += [self._take(length) for _ in range(n)]
                room -= n * length
        while room and self.pool:
            doc, at, ids, total = self._take(max(self.pool))
            pieces.append((doc, at, ids[:room], total))
            if len(ids) > room:
                self._put((doc, at + room, ids[room:], total))
            room -= min(room, len(ids))
        yield from self._laid(pieces)

    def _laid(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, at, ids, total in pieces:
            yield doc, at, ids, self.next, offset, total
            offset += len(ids)
        self.next += 1

    def rest(self) -> Iterator[tuple]:
        while sum(k * len(v) for k, v in self.pool.items()) >= self.size:
            yield from self.window()
        left = deque(p for k in sorted(self.pool, reverse=True) for p in self.pool[k])
        self.pool, self.count = {}, 0
        total = sum(len(p[2]) for p in left)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            pieces = []
            while room:
                doc, at, ids, n = left.popleft()
                pieces.append((doc, at, ids[:room], n))
                if len(ids) > room:
                    left.appendleft((doc, at + room, ids[room:], n))
                room -= min(room, len(ids))
            yield from self._laid(pieces)


def _grouped(batches: Iterator[pa.RecordBatch], chars: int = 6_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of several batches together, as long as they are short."""
    ids, texts, n = [], [], 0
    for b in batches:
        ids += b.column(0).to_pylist()
        more = [t or "" for t in b.column(1).to_pylist()]
        texts += more
        n += sum(map(len, more))
        if n >= chars:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
KIND = pa.schema([(c, pa.int64()) for c in FIELDS] + [("ids", pa.list_(pa.int32()))])


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``ids`` on demand.

    tokenizer: path of a public vocabulary, there on every executor. Sequences are unique over the
    table and gapless inside. Null or empty text: the end id alone. Null ids stay null; equal rows are packed each on its own.
    Empty table: no rows. Other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in ENCODERS:
            ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder, packer = ENCODERS[tokenizer], Packer(size, TaskContext.get().partitionId() << 40)
        names = [*FIELDS, "ids"] if with_ids else list(FIELDS)
        kind = pa.schema([KIND.field(c) for c in names])

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = {c: [] for c in names}
            for doc, at, ids, sequence, offset, total in found:
                for c, v in zip(FIELDS, (doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)):
                    cols[c].append(v)
                if with_ids:
                    cols["ids"].append(ids.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(cols[c], KIND.field(c).type) for c in names], schema=kind)

        for held, texts in _grouped(batches):
            found: list[tuple] = []
            for doc, ids in zip(held, encoder.batch(texts, end)):
                found += packer.add(doc, ids)
            yield rows(found)
        yield rows(list(packer.rest()))

    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, SCHEMA + (", ids array<int>" if with_ids else ""))
    return got.withColumnRenamed("id", id_col)
