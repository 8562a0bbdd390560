"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Tokens are labelled from the document labels: in the documents marked toxic, a token is offending if its word, or its
first four to six letters, is much commoner in toxic than in clean documents of the sample. A chain with the states
clean and toxic is trained on these tokens: each token's features are its word, prefixes, suffix
and both neighbours, hashed. Forward-backward marginals give a probability for each token; their sum and
maximum go through a logistic curve, fitted on the sample, to the document score.

Only ratios between the two states are carried along a chain. A step is a fractional linear map of the ratio, so
long texts are walked in segments side by side, exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscope.llm.common import CACHE_LIMIT, WORD, Cache, in_batches

DIM = 1 << 18
FLOOR, CEIL = 1e-30, 1e30


@dataclass
class Params:
    """Bounds of the training sample, and the training's settings."""
    per_class: int = 1200           # documents of each label, those with the smallest hash of their id
    max_chars: int = 12_000         # longer documents are not taken as training material
    ratio: float = 12.0             # how much commoner in toxic documents a cue must be
    sure: float = 4.5               # standard deviations by which it must be
    rounds: int = 40
    rate: float = 0.3
    ridge: float = 1e-6
    clean_weight: float = 6.0       # of a clean document against a toxic one in the curve; the sample has as many of both


def _slot(kind: int, value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"), kind) % DIM


def _features(word: str) -> tuple[list[int], int, int]:
    """(slots of the token's own features, slot as the word before another, slot as the word after another)."""
    w = word.lower()
    own = [_slot(1, w), _slot(3, w[:3]), _slot(4, w[:4]), _slot(5, w[:5]), _slot(6, w[:6]), _slot(7, w[-3:])]
    return own, _slot(8, w), _slot(9, w)


@dataclass
class Chain:
    """The trained model."""
    weight: np.ndarray
    move: np.ndarray                # ratios of the steps 0->1, 1->0, 1->1 to 0->0
    curve: np.ndarray               # of the document score: constant, log sum, maximum
    constant: float = -2.0          # score of every token before its features
    words: Cache = field(default=None)

    def __post_init__(self):
        self._clear()

    def __reduce__(self):
        return Chain, (self.weight, self.move, self.curve, self.constant)

    def _clear(self) -> None:
        self.words = Cache(self._look)
        self.values = self.weight.tolist()
        self.table: list[tuple[float, float, float]] = []   # a word's score by itself, to the left and to the right of another

    def _look(self, word: str) -> int:
        own, left, right = _features(word)
        w = self.values
        self.table.append((sum(w[k] for k in own) + self.constant, w[left], w[right]))
        return len(self.table) - 1

    def emissions(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(score of each token of all documents in a row, tokens of each document)."""
        if len(self.table) > CACHE_LIMIT:
            self._clear()
        ids = np.array([self.words[w] for d in docs for w in d], np.int64)
        lengths = np.array([len(d) for d in docs], np.int64)
        return combine(ids, lengths, *np.array(self.table).reshape(-1, 3).T), lengths

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Of each token of each document, the probability of being offending."""
        out: list = []
        for part in _parts(docs):
            s, lengths = self.emissions(part)
            r, q, _ = sweep(s, lengths, self.move)
            p = r * q
            out += np.split(p / (1 + p), np.cumsum(lengths)[:-1])
        return out

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        z = np.array([[1.0, *summary(p)] for p in marginals]).reshape(-1, 3) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _parts(docs: list[list[str]], tokens: int = 1_000_000):
    """Documents in groups of about a million tokens."""
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= tokens:
            yield held
            held, n = [], 0
    if held:
        yield held


def summary(p: np.ndarray) -> tuple[float, float]:
    return (float(np.log1p(p.sum())), float(p.max())) if len(p) else (0.0, 0.0)


def _ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and of the last tokens of the documents that have any."""
    ends = np.cumsum(lengths)
    some = lengths > 0
    return (ends - lengths)[some], ends[some] - 1


def combine(ids: np.ndarray, lengths: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    s = own[ids] if len(ids) else np.zeros(0)
    if len(ids) > 1:
        first, last = _ends(lengths)
        before, after = left[ids], right[ids]
        before[last] = 0
        after[first] = 0
        s[1:] += before[:-1]
        s[:-1] += after[1:]
    return s


#: tokens of a segment; segments of all chains are walked side by side
SEGMENT = 64


def _walk(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Values of x -> (a x + b) / (c x + d) along chains, from 1; arrays are (SEGMENT, all segments).

    A composition of such maps is a product of 2 x 2 matrices: each segment's product is made first, then the values at
    the segments' starts, then all values inside.
    """
    pa, pb, pc, pd = np.ones(a.shape[1]), np.zeros(a.shape[1]), np.zeros(a.shape[1]), np.ones(a.shape[1])
    for t in range(len(a)):
        pa, pb, pc, pd = a[t] * pa + b[t] * pc, a[t] * pb + b[t] * pd, c[t] * pa + d[t] * pc, c[t] * pb + d[t] * pd
        if t % 8 == 7:
            top = np.maximum(np.maximum(pa, pb), np.maximum(pc, pd))
            pa, pb, pc, pd = pa / top, pb / top, pc / top, pd / top
    x = np.ones(a.shape[1])
    order = np.argsort(-segments, kind="stable")
    first, many = (np.cumsum(segments) - segments)[order], segments[order]
    for j in range(1, int(many[0]) if len(many) else 0):
        at = first[:np.searchsorted(-many, -j, side="left")] + j
        x[at] = np.clip((pa[at - 1] * x[at - 1] + pb[at - 1]) / (pc[at - 1] * x[at - 1] + pd[at - 1]), FLOOR, CEIL)
    out = np.empty_like(a)
    for t in range(len(a)):
        x = np.clip((a[t] * x + b[t]) / (c[t] * x + d[t]), FLOOR, CEIL)
        out[t] = x
    return out


def sweep(s: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward ratio, backward ratio, e^score) of each token; ratios are of the state toxic to the state clean."""
    e = np.exp(np.clip(s, -30, 30))
    lengths = lengths[lengths > 0]
    segments = -(-lengths // SEGMENT)
    n = int(segments.sum())
    # place of each token in the padded rows
    spot = np.arange(len(s)) + np.repeat((np.cumsum(segments) - segments) * SEGMENT - (np.cumsum(lengths) - lengths), lengths)
    first, last = _ends(lengths)
    m01, m10, m11 = move

    def laid(v: np.ndarray | float, rest: float) -> np.ndarray:
        out = np.full(n * SEGMENT, rest)
        out[spot] = v
        return out.reshape(n, SEGMENT)

    def changed(v: np.ndarray | float, at: np.ndarray, to: np.ndarray | float) -> np.ndarray:
        v = np.full(len(s), v) if np.ndim(v) == 0 else v.copy()
        v[at] = to
        return v

    one = np.ones(len(s))
    ahead = laid(changed(m11 * e, first, 0.0), 1.0), laid(changed(m01 * e, first, e[first]), 0.0), laid(
        changed(m10, first, 0.0), 0.0), laid(one, 1.0)
    r = _walk(*(np.ascontiguousarray(x.T) for x in ahead), segments)
    x = np.r_[e[1:], 1.0] if len(e) else e
    back = laid(changed(m11 * x, last, 0.0), 1.0), laid(changed(m10, last, 1.0), 0.0), laid(
        changed(m01 * x, last, 0.0), 0.0), laid(one, 1.0)
    # backwards: segments and places both turned round
    q = _walk(*(np.ascontiguousarray(y[::-1, ::-1].T) for y in back), segments[::-1])
    return r.T.ravel()[spot], q.T[::-1, ::-1].ravel()[spot], e


def posteriors(emit: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    lengths = np.array([len(x) for x in emit])
    r, q, _ = sweep(np.concatenate(emit), lengths, move)
    p = r * q
    return np.split(p / (1 + p), np.cumsum(lengths)[:-1])


def cues(toxic: list[np.ndarray], clean: list[np.ndarray], words: list[str], p: Params) -> np.ndarray:
    """Which words are cues, or begin like one: much commoner in toxic documents; documents are arrays of word numbers.

    Each counts by the different words before and after it, the fewer of both, so copies of one document make no cue.
    """
    n = len(words)
    starts: dict[str, int] = {}
    begin = np.array([[starts.setdefault(w[:k], len(starts)) if len(w) > k else -1 for k in (4, 5, 6)] for w in words])

    def count(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        before = [np.zeros(0, np.int64), *(d[1:] * n + d[:-1] for d in docs)]
        after = [np.zeros(0, np.int64), *(d[:-1] * n + d[1:] for d in docs)]
        sides = []
        for pairs in (before, after):
            own = np.unique(np.concatenate(pairs)) // n
            by_start = np.zeros(len(starts))
            for column in begin.T:
                at = column[own]
                by_start += np.bincount(at[at >= 0], minlength=len(starts))
            sides.append((np.bincount(own, minlength=n), by_start))
        return tuple(np.minimum(x, y) for x, y in zip(*sides))

    scale = max(1, sum(map(len, toxic))) / max(1, sum(map(len, clean)))

    def common(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (t >= p.ratio * (c + 0.5) * scale) & (t - c * scale >= p.sure * np.sqrt(t + c * scale * scale + 1))

    word, start = (common(t, c) for t, c in zip(count(toxic), count(clean)))
    return word | (np.append(start, False)[begin]).any(axis=1)


def train(texts: list[str], toxic: list[int], p: Params | None = None) -> Chain:
    """The chain from labelled texts, by full-batch Adagrad on the likelihood of the token labels."""
    p = p or Params()
    vocab: dict[str, int] = {}
    coded = [np.array([vocab.setdefault(w, len(vocab)) for w in WORD.findall((t or "").lower())], np.int64) for t in texts]
    keep = [k for k, d in enumerate(coded) if len(d)]
    coded, marks = [coded[k] for k in keep], np.array([toxic[k] for k in keep], int)
    model = Chain(np.zeros(DIM), np.array([0.02, 1.0, 0.1]), np.array([-2.0, 1.0, 1.0]))
    if not coded or marks.min() == marks.max():
        return Chain(model.weight, model.move, np.array([0.0 if not coded else (4.0 if marks[0] else -4.0), 0.0, 0.0]))
    words = list(vocab)
    bad, n_words = cues([d for d, y in zip(coded, marks) if y], [d for d, y in zip(coded, marks) if not y], words, p), len(words)
    feats = [_features(w) for w in words]
    own, left, right = np.array([f[0] for f in feats]), np.array([f[1] for f in feats]), np.array([f[2] for f in feats])
    del feats
    # every third document is kept for the curve, since the chain knows the others too well
    part = [k for k in range(len(coded)) if k % 3]
    ids, lengths = np.concatenate([coded[k] for k in part]), np.array([len(coded[k]) for k in part])
    truth = bad[ids] * np.repeat(marks[part], lengths).astype(float)
    first, _ = _ends(lengths)
    inner = np.ones(len(ids), bool)
    inner[first] = False
    now = np.flatnonzero(inner)                            # tokens that have one before them
    want = np.array([((1 - truth[now - 1]) * truth[now]).sum(), (truth[now - 1] * (1 - truth[now])).sum(),
                     (truth[now - 1] * truth[now]).sum()])
    log_move, weight = np.log(model.move), np.zeros(DIM)
    weight_sq, move_sq = np.full(DIM, 1e-10), np.full(3, 1e-10)
    for _ in range(p.rounds):
        s = combine(ids, lengths, weight[own].sum(axis=1) + model.constant, weight[left], weight[right])
        m01, m10, m11 = np.exp(log_move)
        r, q, e = sweep(s, lengths, np.exp(log_move))
        gap = truth - r * q / (1 + r * q)
        g = np.bincount(own.ravel(), np.repeat(np.bincount(ids, gap, n_words), own.shape[1]), DIM)
        g += np.bincount(left, np.bincount(ids[now - 1], gap[now], n_words), DIM)
        g += np.bincount(right, np.bincount(ids[now], gap[now - 1], n_words), DIM)
        a, b = r[now - 1], e[now] * q[now]
        parts = np.stack([m01 * b, m10 * a, m11 * a * b])
        move_g = (want - (parts / (1 + parts.sum(axis=0))).sum(axis=1)) / len(ids)
        g = g / len(ids) - p.ridge * weight
        weight_sq += g * g
        weight += p.rate * g / np.sqrt(weight_sq)
        move_sq += move_g * move_g
        log_move = np.clip(log_move + 0.1 * move_g / np.sqrt(move_sq), -8, 8)
    chain = Chain(weight, np.exp(log_move), np.zeros(3), model.constant)
    rest = [k for k in range(len(coded)) if k % 3 == 0]
    s = combine(np.concatenate([coded[k] for k in rest]), np.array([len(coded[k]) for k in rest]),
                weight[own].sum(axis=1) + model.constant, weight[left], weight[right])
    found = posteriors(np.split(s, np.cumsum([len(coded[k]) for k in rest])[:-1]), np.exp(log_move))
    x = np.array([[1.0, *summary(v)] for v in found]).reshape(-1, 3)
    y = marks[rest].astype(float)
    chain.curve = _logistic(x, y, np.where(y == 1, 1.0, p.clean_weight))
    return chain


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (share * (y - p)) - ridge * w)
    return w


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, p: Params) -> tuple[list, list]:
    """Texts and labels of the bounded training sample; held-out ids (crc32 divisible by 5) are never in it."""
    own = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
           .select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where(~held_out("i"))
           .distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(
        F.length("t").between(1, p.max_chars))
    got_t, got_y = [], []
    for y in (0, 1):
        # at most 2 * per_class rows, so the broadcast is bounded
        ids = F.broadcast(own.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(2 * p.per_class))
        rows = texts.join(ids, "i").dropDuplicates(["i"]).orderBy(F.xxhash64("i"), "i").limit(p.per_class).collect()
        got_t += [r["t"] for r in rows]
        got_y += [y] * len(rows)
    return got_t, got_y


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        params: Params | None = None) -> Chain:
    p = params or Params()
    return train(*sample(docs, labels, id_col, text_col, label_col, p), p)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, spans (start, end, p of each offending token).

    Null or empty texts get the score of a text without tokens. A null id is kept and not held out. Equal
    texts get equal scores. Only the text is an input of the score; other columns are not looked at.
    """
    def work(cols: dict) -> dict:
        found = [list(WORD.finditer(t or "")) for t in cols["text"]]
        p = chain.marginals([[m.group() for m in f] for f in found])
        s = chain.scores(p)
        return {"id": cols["id"], "score": s, "predicted": (s >= 0.5).astype(int), "spans": [
            [{"start": f[k].start(), "end": f[k].end(), "p": float(v[k])} for k in np.flatnonzero(v >= 0.5)]
            for f, v in zip(found, p)]}

    got = in_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work,
                     "id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")
    return got.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"),
                      "score", "predicted", "spans")


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns kept. Null texts stay."""
    @F.pandas_udf("boolean")
    def clean(text):
        import pandas as pd
        p = chain.marginals([WORD.findall(t or "") for t in text])
        return pd.Series(chain.scores(p) < 0.5)

    return docs.where(clean(F.col(text_col)) | F.col(text_col).isNull())
