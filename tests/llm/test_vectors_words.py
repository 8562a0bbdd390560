"""The vector graph, hard negatives and spelling variants against plain versions of their contracts."""

import collections
import math
import pathlib
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from stackscope.llm import negatives, spelling, vectorgraph

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test data")
NAN, INF = float("nan"), float("inf")
KIND = "vec_id long, embedding array<double>, label int"


def family(rng, many, wide=8):
    """Unit vectors; a third are near copies of one, others near copies of theirs, some exact or scaled copies."""
    base = rng.normal(size=(many, wide))
    hot = rng.normal(size=wide)
    base[::3] = hot + rng.normal(size=base[::3].shape) * 0.12
    base[1::6] = base[4 % many] + rng.normal(size=base[1::6].shape) * 0.25
    base[7] = base[10]
    base[13] = 3 * base[10]
    return base


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v], int(rng.integers(0, 10))) for i, v in enumerate(family(rng, 240))]
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * 8, 1), (703, [1.0, None] + [0.0] * 6, 1), (704, [NAN] + [0.0] * 7, 2),
             (705, [INF] + [0.0] * 7, 2), (706, [1.0, 2.0], 2), (707, [1.0, 2.0], 3), (708, [1e-200] * 8, 3), (709, [1e200] * 8, 3),
             (None, [1.0] * 8, 3), (None, None, None), (800, [1.0] * 8, None), (800, [1.0] * 8, 4), (801, [1.0] * 8, 4)]
    df = spark.createDataFrame(rows, KIND)
    # names that clash with the operators' own columns
    for name in ("id", "c", "n", "node", "head", "row", "v", "score", "dim", "shard"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3), rows


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows, bound=0.9):
    live = [(k, i, np.array(v) / max(abs(x) for x in v)) for k, (i, v, _) in enumerate(rows) if i is not None and usable(v)]
    links, parent = collections.Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (k, _, a) in enumerate(live):
        for m, _, b in live[:x]:
            if len(a) == len(b) and a @ b >= bound * np.linalg.norm(a) * np.linalg.norm(b):
                links[k] += 1
                links[m] += 1
                parent[max(root(k), root(m))] = min(root(k), root(m))
    group = collections.defaultdict(list)
    for k, i, _ in live:
        group[root(k)].append(i)
    low = {k: min(group[root(k)]) for k, _, _ in live}
    return sorted(((-1 if i is None else i), links[k], low.get(k, i if i is not None else -1),
                   i is None or low.get(k, i) == i) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("rows_a_slice", [4096, 24])
def test_vector_graph(vectors, monkeypatch, rows_a_slice):
    """Small slices: several shards, hot ones cut into slices, groups gathered over two rounds, gangs of queries."""
    monkeypatch.setattr(vectorgraph, "SLICE_ROWS", rows_a_slice)
    monkeypatch.setattr(vectorgraph, "GANG", 100 if rows_a_slice < 100 else 50_000)
    df, rows = vectors
    got = vectorgraph.near_duplicates(df).collect()
    want = brute_links(rows)
    assert sum(x[1] for x in want) > 2000
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in got)
    # none below the bound; the graph may lose links only where the data are cut up
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    if rows_a_slice > 1000:
        assert got == want
    else:
        assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def test_vector_graph_balls_and_pruning():
    """A ball's vectors are all linked; its radius covers them; pruning keeps the nearest and few."""
    import pandas as pd
    rng = np.random.default_rng(4)
    v = family(rng, 300)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = np.unique(v, axis=0)
    n = len(v)
    reach = math.acos(0.9)
    out = vectorgraph.gather(pd.DataFrame({"dim": 8, "node": np.arange(n), "c": list(v), "r": 0.0, "n": 1, "low": np.arange(n)}), reach / 2)
    heads = out[out["node"] == out["head"]].set_index("node")
    assert len(heads) < n and heads["n"].sum() == n
    for node, head in zip(out["node"], out["head"]):
        assert vectorgraph.angles(v[node][None], np.array(heads.loc[head, "c"])[None])[0, 0] <= heads.loc[head, "r"] + 1e-6 <= reach / 2 + 2e-6
    lists = vectorgraph.build(np.arange(n), v)
    assert max(map(len, lists)) <= 1.5 * vectorgraph.DEGREE
    near = np.argsort(-(v @ v.T), axis=1)[:, 1]
    assert np.mean([near[i] in x for i, x in enumerate(lists)]) > 0.95
    graph = vectorgraph.Graph(np.arange(n), v, np.zeros(n), lists)
    who, where = graph.search(-1 - np.arange(n), v, np.full(n, 0.9), 32)      # from the medoid alone
    true = v @ v.T >= 0.9
    assert true[who, where].all() and len(who) >= 0.97 * true.sum() and len(set(zip(who, where))) == len(who)


def test_vector_graph_recall_is_audited(spark, vectors):
    """An audit of emptied results says so."""
    df = spark.createDataFrame([(i, 2, [math.cos(a), math.sin(a)], 0.0) for i, a in enumerate((0.0, 0.1, 0.2, 2.0))],
                               "node long, dim int, c array<double>, r double")
    none = spark.createDataFrame([], "a long, b long")
    some = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "a long, b long")
    assert vectorgraph.audit(df, none, 0.45) == 0 and vectorgraph.audit(df, some, 0.45) == 0.5
    assert vectorgraph.audit(df.where("node = 3"), none, 0.45) == 1


def test_strassen():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (17, 33, 65), (64, 64, 64), (130, 7, 90), (100, 64, 257), (37, 50, 41)):
        a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
        assert (negatives.strassen(a, b, 4) == a @ b).all()
    big = rng.integers(-2**30, 2**30, (40, 36)), rng.integers(-2**27, 2**27, (36, 50))       # beyond what doubles hold
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in big[1].T] for r in big[0]]
    assert negatives.strassen(*big, 4).tolist() == want
    assert negatives.strassen(np.zeros((0, 5), np.int64), np.zeros((5, 3), np.int64)).shape == (0, 3)


def brute_negatives(rows, every):
    pts = sorted({(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows
                  if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, lab, v in pts:
        if i % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w)), j, l2) for j, l2, w in pts if j != i and len(w) == len(v))
        for p, j, _ in [x for x in s if x[2] == lab][:5]:
            ok = [x for x in s if x[2] != lab and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(ok)]
    return sorted(out)


@pytest.mark.parametrize("tile", [1024, 20])
def test_hard_negatives(vectors, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(negatives, "CANDIDATE_TILES", 3 if tile < 100 else 32)
    monkeypatch.setattr(negatives, "ANCHOR_TILES", 1 if tile < 100 else 4)
    df, rows = vectors
    df, rows = df.where("vec_id is null or vec_id <> 709"), [r for r in rows if r[0] != 709]     # its scores leave 64 bits
    want = brute_negatives(rows, 20)
    assert len(want) > 200
    assert sorted(tuple(r) for r in negatives.mine(df, every=20).collect()) == want


def test_ties_repeated_rows_and_empty_tables(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(0, 40)] + [(i, [0.5, 0.1], 2) for i in range(40, 80)] * 2
    df = spark.createDataFrame(rows, KIND)
    got = negatives.mine(df, every=100, shift=0).collect()
    assert sorted((r.positive_id, r.rank, r.negative_id) for r in got) == [(p, k + 1, 40 + k) for p in range(1, 6) for k in range(10)]
    none = df.where("false")
    assert negatives.mine(none).count() == 0 and vectorgraph.near_duplicates(none).count() == 0
    got = vectorgraph.near_duplicates(df).collect()
    assert len(got) == 120 and {(r.vec_id < 40, r.n_links, r.component_id) for r in got} == {(True, 119, 0), (False, 119, 0)}
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(nothing).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "12 45"), (4, "short")], "doc_id long, text string")).collect() == []


def brute_variants(texts, length=6, count=5, drop=199):
    seen = collections.Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            seen[w] += len(w) >= length
    words = {w: n for w, n in seen.items() if n >= count}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    near = collections.defaultdict(list)
    ordered = sorted(words, key=len)
    for x, a in enumerate(ordered):
        for b in ordered[x + 1:]:
            if len(b) > len(a) + 1:
                break
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


@pytest.mark.parametrize("shard", [40_000, 25])
def test_spelling_variants(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "GANG_WORDS", 20 if shard < 100 else 100_000)
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", 100 if shard < 100 else 150_000)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    rng = np.random.default_rng(5)
    letters = list("abÀéÿ×") if shard < 100 else list("abcdeé")
    stem = "".join(rng.choice(letters, 9))
    texts = []
    for i in range(160):
        words = [stem] * int(rng.integers(1, 4))
        for _ in range(25):                                # a third of the words begin alike
            w = list(stem)
            for _ in range(int(rng.integers(1, 3))):
                at = int(rng.integers(0, len(w)))
                op = int(rng.integers(0, 3))
                w[at:at + (op > 0)] = [rng.choice(letters)] if op < 2 else []
            words.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
        words += ["".join(rng.choice(list("xyz"), int(rng.integers(5, 8)))) for _ in range(10)]
        texts.append((i, " ".join(words) + "-12Ā"))
    texts += [(None, "chocolate " * 30), (None, None), (500, ""), (501, "chocolat " * 5 + "chocolates " * 5), (502, "a" * 5000 + " "),
              (503, ("b" * 3000 + " ") * 5), (504, ("b" * 3001 + " ") * 25)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    want = brute_variants(texts)
    assert sum(w[1] is not None for w in want) > 5 and any(w[1] != w[2] for w in want if w[1]) and max(w[4] for w in want) > 5
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()) == want


def test_every_edit_is_found():
    """Each kind of edit at each place, over shards' two directions."""
    words = sorted({"abcdefgh"} | {w for k in range(9) for w in ("abcdefgh"[:k] + "abcdefgh"[k + 1:], "abcdefgh"[:k] + "é" + "abcdefgh"[k:],
                                                                 "abcdefgh"[:k] + "z" + "abcdefgh"[k + 1:])} - {""})
    found = set()
    for back in (False, True):
        keys = sorted(w[::-1] for w in words) if back else words
        q, w = spelling.Index(keys).one_error(["hgfedcba" if back else "abcdefgh"], np.array([4]))
        found |= {keys[x][::-1] if back else keys[x] for x in w}
    assert found == set(words) - {"abcdefgh"}
    # letters that the index does not know
    q, w = spelling.Index(["abcd"]).one_error(["abxd", "ßbcd", "abcdß"], np.array([2, 2, 2]))
    assert sorted(q.tolist()) == [0, 2]
