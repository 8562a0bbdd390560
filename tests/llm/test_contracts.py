"""Every operator against a plain version of its contract, on the small tables with odd rows added."""

import collections
import hashlib
import math
import pathlib
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackscope.llm import (catalog, decontaminate, html, lines, minhash, packing, quality, secrets, topk, toxicity,
                            urls)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test data")

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [(900001, None), (900002, ""), (900003, " \n\t "), (900004, "one two"), (900005, "one two"), (900006, "ONE\ttwo"),
       (900007, LONG), (900008, LONG + " tail"), (900009, "one two"), (900009, "one two"), (None, "no id here at all"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    # extra columns whose names clash with the operators' own
    return base.union(odd).withColumn("id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("spans", F.lit(2)).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(texts, size, percent):
    sets = collections.defaultdict(set)
    for i, t in texts:
        if i is not None and shingles(t, size):
            sets[shingles(t, size)].add(i)
    keys = list(sets)
    parent = {i: i for i, _ in texts if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for ids in sets.values():
        for i in ids:
            join(i, min(ids))
    for x in range(len(keys)):
        for y in range(x):
            a, b = keys[x], keys[y]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    join(min(sets[a]), min(sets[b]))
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("size,percent", [(4, 80), (5, 80)])
def test_near_duplicates(docs, texts, size, percent):
    want = brute_components(texts, size, percent)
    rows = minhash.near_duplicates(docs, shingle=size, percent=percent).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got == sorted((i if i is not None else -1, len(shingles(t, size)), want.get(i), i is None or want[i] == i)
                         for i, t in texts) or _differences(got, texts, want, size)


def _differences(got, texts, want, size):
    full = sorted(((i if i is not None else -1), len(shingles(t, size)), want.get(i), i is None or want[i] == i) for i, t in texts)
    raise AssertionError([(a, b) for a, b in zip(got, full) if a != b][:5])


def test_near_duplicate_chains_and_families(spark):
    """Links that only members of a bucket other than its smallest have; a chain; many near copies."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join(base[:100 - k] + [f"n{k}x{j}" for j in range(k)])) for k in range(0, 60, 4)]
    for k in range(100, 220):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            words[at] = f"e{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4, 80)
    assert len(set(want.values())) > 10
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=4).collect()} == want


def test_odd_sketch_bound():
    """Pairs at the similarity bound stay under the count; unrelated ones do not."""
    rng, limit = np.random.default_rng(1), minhash.most_odd_bits(80)
    k = minhash.BANDS * minhash.ROWS
    for share, inside in ((0.8, True), (0.2, False)):
        for _ in range(300):
            same = rng.random(k) < share
            a, b = rng.integers(0, minhash.BITS, k), rng.integers(0, minhash.BITS, k)
            b = np.where(same, a, b)
            odd = (np.bincount(a, minlength=minhash.BITS) ^ np.bincount(b, minlength=minhash.BITS)) & 1
            assert (odd.sum() <= limit) == inside


def test_deduplicated_keeps_one_of_each_group(docs, texts):
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    want = brute_components(texts, 5, 80)
    got = collections.Counter(r[0] for r in kept.select("doc_id").collect())
    assert got.pop(None) == 2
    assert got == collections.Counter({i for i, c in want.items() if i == c})


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([
        (1, None), (2, "no scheme"), (3, "http://ORG"), (4, "http://a.org/x"), (5, "https://x.example.org/en/19?q=/es/"),
        (6, "http://notexample.org/es/1"), (7, "ftp://b.Com/fr/"), (8, "x://y://z.org/"), (None, "http://c.com/de/#/fr/"),
        (9, "http://"), (9, "http://")], "page_id long, url string")).withColumn("host", F.lit(0))
    rows = urls.judge(pages).collect()
    given = collections.Counter((r[0], r[1]) for r in pages.select("page_id", "url").collect())
    want = collections.Counter()
    for (i, u), n in given.items():
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.sub("[A-Z]", lambda m: m.group().lower(), re.split("[/?#]", rest)[0])
            path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]):])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[(i, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None)] += n
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in rows)
    assert got == want
    assert {r.verdict for r in rows} <= {"allow", "block"} and all(0 <= r.score <= 1 for r in rows)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_learned(spark):
    """Held-out URLs that rules decide are judged alike by the regression alone."""
    rows = [(f"http://www.h{k % 40}.{'com' if k % 2 else 'net'}/{'shop' if k % 3 else 'casino'}/item{k}", int(k % 3 > 0)) for k in range(600)]
    known = spark.createDataFrame(rows[:400], "url string, label int")
    asked = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[400:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(asked, labelled=known, rules=()).collect()}
    right = sum((got[k] == "allow") == bool(y) for k, (_, y) in enumerate(rows[400:]))
    assert right >= 0.95 * len(got)


def brute_top_k(vectors, k=5, every=50):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            seen = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    seen[i] = max(seen.get(i, -10**18), sum(x * y for x, y in zip(a, b)))
            best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:k]
            out[q] = [(r + 1, i, s) for r, (i, s) in enumerate(best)]
    return {q: v for q, v in out.items() if v}


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "GANG", 2)
    base = [(r[0], [float(x) for x in r[1]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    hot = [(2000 + k, base[3][1]) for k in range(200)] + [(3000, base[3][1]), (3000, base[3][1])]
    odd = [(5000, None), (5050, []), (5100, [1.0, float("nan")]), (5150, [float("inf")] * 64), (None, base[5][1]), (5200, [None] * 64),
           (5250, [0.5, -0.5]), (5251, [0.25, 1.0]), (5300, [0.0] * 64)]
    rows = base + hot + odd
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = collections.defaultdict(list)
    for r in topk.search(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute_top_k([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    assert topk.search(df.limit(0)).count() == 0


def test_main_text(spark):
    pages = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    odd = [(9001, "http://a/1", None), (9002, "http://a/2", ""), (9003, None, "<p>x  <b>y</b>\n z &amp; &#233;</p><p>w</p>"),
           (9004, "http://a/4", "<body><nav><p>menu</p></nav><main><h1>T</h1>a<br>b<div class='comments'>no</div><form>no</form>c</main><footer>f</footer>"),
           (9005, "http://a/5", "<article><header><h1>H</h1></header><p>one<p>two<script>var a='<p>';</script><aside>no</aside></article> <div id=sidebar>s</div>"),
           (9006, "http://a/6", "<article>cut off <b>here &am"), (9007, "http://a/7", "plain & text < 5")]
    want = {9001: "", 9002: "", 9003: "x y z & é w", 9004: "T a b c", 9005: "H one two", 9006: "cut off here &am", 9007: "plain & text < 5"}
    shared = "all of these words stand on every page of this host as a closing note"
    for k in range(6):
        pages.append((9100 + k, "http://b.example/x", f"<div>unique run number {k} of page {k}</div><div>{shared}</div>"))
        want[9100 + k] = f"unique run number {k} of page {k}"
        copied = "this article was copied word by word to several pages of the host"
        pages.append((9200 + k, "http://c.example/x", f"<article><p>{copied}</p></article>"))
        want[9200 + k] = copied
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert len(got) == len(pages) + len(odd)
    assert all(r.n_chars == len(r.text) for r in got.values())
    for i, text in want.items():
        assert got[i].text == text, i
    import html as entities
    for i, _, source in pages[:50]:
        body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", source, re.S).group(1)
        parts = re.split(r"</?(?:p|h1|li|ul|div|h2|blockquote)\b[^>]*>", re.sub("<br>", " ", body))
        plain = (" ".join(entities.unescape(re.sub("<[^>]*(?:>|$)", "", p)).split()) for p in parts)
        assert got[i].text == " ".join(p for p in plain if p)


def test_main_text_counts_over_the_whole_host(spark):
    """A note on a few of many pages goes however pages are sliced, dealt out and ordered."""
    note = "this closing note stands on some few pages of the large host only"
    pages = [(k, "http://large.example/x", f"<div>text {k} has words of its own {k}a {k}b {k}c</div>"
              + (f"<div>{note}</div>" if k % 20 == 0 else "")) for k in range(100)]
    pages += [(200 + k, "http://other.example/x", f"<div>page {k}</div><div>{note}</div>") for k in range(2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {k: f"text {k} has words of its own {k}a {k}b {k}c" for k in range(100)} | {200 + k: f"page {k} {note}" for k in range(2)}
    for dealt in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("page_id"))):
        assert {r.page_id: r.text for r in html.extract(dealt, group=8).collect()} == want


def test_main_text_drops_site_wide_notices_in_articles(spark):
    """The counts decide bodies too: a host's own notice goes, whatever else repeats there stays."""
    note = "you may read three more articles on this site for free this month"
    line = "and so they lived happily until the very end of their days"
    title = "how the old harbour was rebuilt after the great storm"
    copied = "this article was copied word by word to several pages of the host"
    def page(k, body, menu=""):
        return f"<article>{body}</article><aside>{note if k % 4 else ''}</aside><nav><p>{title}</p>{menu}</nav>"
    bodies = {k: [f"page {k} has words of its own {k}a {k}b {k}c", line, f"more of page {k}"] for k in range(40)}
    bodies[3] = [title, *bodies[3]]
    for k in range(20, 25):
        bodies[k] = [title, copied]
    rows, want = [], {}
    for k, parts in bodies.items():
        shown = parts[:1] + [note] + parts[1:] if k % 5 == 0 else parts
        rows.append((k, "http://a.example/x", page(k, "".join(f"<p>{p}</p>" for p in shown), line if k < 6 else "")))
        want[k] = " ".join(parts)
    # quoted inside a longer block, and on a host where it is no notice
    rows.append((100, "http://a.example/x", page(1, f"<p>the page said {note} and I left</p>")))
    want[100] = f"the page said {note} and I left"
    for k in range(101, 105):
        rows.append((k, "http://b.example/x", f"<article><p>{note}</p></article>"))
        want[k] = note
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for dealt in (df.repartition(1), df.repartition(7)):
        assert {r.page_id: r.text for r in html.extract(dealt, group=8).collect()} == want


@pytest.mark.parametrize("source,want", [
    ("<body class='has-sidebar'><p>all of it</p></body>", "all of it"),
    ("<article class='post sidebar-right'>text</article>", "text"),
    ("<article><h1 class='entry-header'>Heading</h1>text</article>", "Heading text"),
    ("<p class='navy'>blue</p><div class='no-sidebar'>wide</div>", "blue wide"),
    ("<p>to <a href='/hidden-lakes'>lakes</a> <a href=/hidden>and</a> <a title='the hidden cost'>cost</a></p>", "to lakes and cost"),
    ("<p data-hidden='false' data-class=\"menu\">p</p>", "p"), ("<p title='a > b' class=menu>no</p>yes", "yes"),
    ("<p hidden>no</p><p title='x'hidden>no</p><p aria-hidden=true>no</p>yes", "yes"),
    ("<div class='page-banner'>no<article>yes</article>no</div>", "yes"),
    ("<div class='menu'><nav><article>no</article></nav></div>yes", "yes"),
    ("<article>yes<div id=comments>no<article>no</article></div></article>", "yes"),
    ("<article>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>x=2</annotation></math> then</article>", "if x=2 then"),
])
def test_chrome_names(source, want):
    assert " ".join(t for role, t in html.blocks(source) if role != html.IS_CHROME) == want


def test_suffix_ranks():
    rng = np.random.default_rng(5)
    streams = [rng.integers(0, 3, 40).astype(np.uint64) for _ in range(5)]
    body = [np.zeros(40, bool) for _ in streams]
    for run, least in ((3, 2), (6, 3), (5, 5)):
        seen = collections.defaultdict(set)
        for k, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                seen[tuple(s[i:i + run])].add(k)
        for k, (s, got) in enumerate(zip(streams, html.repeated(streams, body, run, least))):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - run + 1):
                if len(seen[tuple(s[i:i + run])]) >= least:
                    want[i:i + run] = True
            assert (got == want).all()


def test_packing(spark, docs, texts, empty):
    from tokenizers import Tokenizer
    path = catalog.vocabulary()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    extra = ["a  b", "a   b", "a \n b", "x\n  y", " a", "a ", "\n", "don't  a", "a\t b", "é  b.", "a..b,, c", "\x02 a", "a\u00a0 b", "3.14, 2", "_.x"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(800000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    given = texts + [(800000 + k, t) for k, t in enumerate(extra)]
    ids = {(i, t): tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in given}
    rows = packing.pack(df, path, with_ids=True).collect()
    whole = collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole[r.doc_id].append((r.start, r.ids))
    want = collections.defaultdict(list)
    for (i, t) in given:
        want[i].append(ids[(i, t)])
    for i, parts in whole.items():
        if i is not None and len(want[i]) == 1:
            at = 0
            for start, piece in sorted(parts):
                assert start == at
                at += len(piece)
            assert sum((p for _, p in sorted(parts)), []) == want[i][0]
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    at = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in at.values())
    assert packing.pack(empty, path).count() == 0


def test_packing_added_tokens(spark):
    """A literal added token in a text has its own id, as in the library with its settings as they are."""
    from tokenizers import Tokenizer
    path = catalog.vocabulary()
    tok = Tokenizer.from_file(path)
    given = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a  <|endoftext|>  b\n\n<|endoftext|>\n c", "<|endoftext|", "plain text, as it is.",
             "a <|ENDOFTEXT|> b", "don<|endoftext|>'t", "\x02 a<|endoftext|> é  b."]
    rows = packing.pack(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), path, with_ids=True).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        got[r.doc_id] += r.ids
    assert got == {k: tok.encode(t, add_special_tokens=False).ids + [1] for k, t in enumerate(given)}
    assert got[0] == [64, 220, 50256, 275, 1]
    assert all(r.doc_tokens == len(got[r.doc_id]) for r in rows)


def test_fill_is_the_best_subset_sum():
    rng = np.random.default_rng(2)
    for _ in range(60):
        stock = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 40, 6)}
        room = int(rng.integers(0, 90))
        sums = {0}
        for length, n in stock.items():
            sums = {s + length * j for s in sums for j in range(n + 1) if s + length * j <= room}
        got = packing.fill(room, stock)
        assert all(got[x] <= stock[x] for x in got) and sum(x * n for x, n in got.items()) == max(sums)


def test_toxicity(spark, docs, empty):
    sf = SF.replace("0.001", "0.01")
    big, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.fit(big, labels)
    truth = {r[0]: r[1] for r in labels.select("doc_id", "toxic").collect()}
    rows = toxicity.score(big, chain).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = toxicity.score(docs, chain).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert not {r.predicted for r in odd if r.doc_id in (900001, 900002)} - {0}
    text = {r[0]: r[1] for r in big.select("doc_id", "text").collect()}
    assert all(text[r.doc_id][s.start:s.end].strip() for r in rows for s in r.spans)
    assert toxicity.score(empty, chain).count() == 0
    assert toxicity.without_toxic(docs, chain).columns == docs.columns
    # no labels at all, or of one kind
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("predicted = 0").count() >= 0
    assert toxicity.score(docs, toxicity.fit(big, labels.where("toxic = 0"))).where("predicted = 1").count() == 0


def test_marginals_by_enumeration():
    import itertools
    rng = np.random.default_rng(4)
    move = np.array([0.3, 0.8, 1.7])
    for n in (1, 2, 5):
        emit = rng.normal(size=n)
        total, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(e for e, v in zip(emit, y) if v))
            for a, b in zip(y, y[1:]):
                p *= {(0, 0): 1, (0, 1): move[0], (1, 0): move[1], (1, 1): move[2]}[a, b]
            total += p
            on += p * np.array(y)
        assert np.allclose(toxicity.posteriors([emit, np.zeros(0), emit], move)[2], on / total)


def test_line_dedup(spark, docs, texts, empty):
    rows = lines.dedup(docs).collect()
    assert len(rows) == len(texts)
    by_text = {r.doc_id: r for r in rows}
    assert by_text[900001].text is None and by_text[900002].text == ""
    for i, t in texts:  # what is left is the text without the spans
        if i is not None and t:
            at, left = 0, ""
            for s in by_text[i].removed:
                left, at = left + t[at:s.start], s.end
            assert by_text[i].text == left + t[at:]
    assert by_text[900004].text == "one two" and by_text[900005].text == by_text[900006].text == ""
    seen = collections.Counter(line for r in rows if r.doc_id is not None for line in
                               {" ".join(x.lower().split()) for x in (r.text or "").split("\n")} - {""} if r.doc_id != 900009)
    assert max(seen.values()) == 1
    assert lines.dedup(empty).count() == 0


def test_line_dedup_finds_passages_inside_lines(spark):
    rng = np.random.default_rng(8)
    fresh = iter(f"u{k}" for k in range(100_000))
    passage = [f"p{int(rng.integers(0, 10**6))}" for _ in range(60)]
    rows = []
    for k in range(40):
        head, tail = [next(fresh) for _ in range(30)], [next(fresh) for _ in range(25)]
        rows.append((k, " ".join(head + (passage if k % 2 else []) + tail)))
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        left = set(got[k].text.split())
        assert set(w for w in t.split() if w[0] == "u") <= left
        assert k == 1 and set(passage) <= left or k != 1 and len(left & set(passage)) < 20


def test_line_dedup_keeps_what_repeats_only_in_pieces(spark):
    """Units met before in other places, here common phrases of few words, make no repeated passage together."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(f"v{int(x)}" for x in rng.integers(0, 12, 400))) for k in range(60)]
    # whole repeated lines beside a line with one unit seen before lend it no words
    shared = "\n".join(" ".join(f"s{j}x{i}" for i in range(20)) for j in range(2))
    rows += [(100, f"alpha\n{shared}"), (101, f"{shared}\nalpha beta"), (102, f"gamma\n{shared}\nalpha delta")]
    powers = lines.Powers()
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    earlier = set()
    for k, t in rows[:60]:
        w = t.split()
        runs = {tuple(w[i:i + 16]) for i in range(len(w) - 15)}
        if not runs & earlier:
            assert got[k].text == t
        earlier |= runs
    assert got[101].text == "alpha beta" and got[102].text == "gamma\nalpha delta"
    # every sequence of units with 16 words inside a line is covered by the runs
    d, _, _, n, row = lines.units(" ".join(f"y{i}" for i in range(300)) + "\n" + "z z z", powers)
    _, first, end = lines.runs(d, n, row, 16, powers)
    made = set(zip(first.tolist(), end.tolist()))
    assert len(made) == len(first) and all(row[a] == row[b - 1] and n[a:b].sum() >= 16 for a, b in made)
    for a in range(len(d)):
        for b in range(a + 1, len(d) + 1):
            if row[a] == row[b - 1] and n[a:b].sum() >= 16:
                assert set(range(a, b)) == {u for x, y in made if a <= x and y <= b for u in range(x, y)}


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def test_secrets(spark, docs, texts, empty):
    body = "A" * 30
    good = f"ghp_{body}" + _base62(zlib.crc32(body.encode()))
    odd = ["é token='abcdefghijklmnop' AKIA" + "Q" * 16, "PassWord : \"0123456789abcdef0123\" apikey=short api_key==aaaaaaaaaaaa",
           "tokentoken=secret=aaaaaaaaaaaaaaa", "ſecret=aaaaaaaaaaaaaaaa toKen=bbbbbbbbbbbbbb", good, good[:-1] + "!", "AKIAAKIA" + "B" * 14 + " AKIA123",
           "deadbeef" * 3 + "g" + "0" * 15]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(700000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    given = texts + [(700000 + k, t) for k, t in enumerate(odd)]
    kinds = ("assign", "access", "hex")
    want = collections.Counter()
    for i, t in given:
        spans = brute_secrets(t or "")
        said = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        want[(i, *[sum(x[1] == k for x in spans) for k in range(3)], hashlib.sha256(said.encode()).hexdigest())] += 1
    rows = secrets.scan(df).collect()
    assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want
    found = {r.doc_id: r.spans for r in rows}
    assert "github:0:40" in found[700004] and "github" not in found[700005]
    masked = secrets.masked(df)
    assert masked.columns == df.columns and masked.count() == df.count()
    assert all(not brute_secrets(r.text or "") for r in masked.collect())
    assert secrets.scan(empty).count() == 0


def _base62(n):
    out = ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = secrets.DIGITS[d] + out
    return out


def brute_scan(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        for s in range(len(b) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i] == b[s] and w[i:i + n] == b[s:s + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, texts, empty):
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bench += [(901, "Short item"), (902, "short ITEM"), (903, None), (904, ""), (905, "x"), (None, "no id item"), (906, "a b c d e f g"), (907, " ".join("abcdefghijklmno"))]
    more = [(600000, "a SHORT, item and x; a b c d e f g!"), (600001, "short item short item"), (600002, " ".join("zzabcdefghijklmnopq")),
            (600003, (bench[0][1] or "") + " " + " ".join(f"f{k}" for k in range(40))), (600004, " ".join(bench[1][1].split()[:12]))]
    odd = spark.createDataFrame(more, "doc_id long, text string")
    df = docs.select("doc_id", "text").union(odd).withColumn("w", F.lit(1))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("win", F.lit(0))
    given = texts + more
    usable = [(i, t) for i, t in bench if i is not None]
    want = collections.Counter((i, *brute_scan(t, usable)) for i, t in given)
    rows = decontaminate.scan(df, b).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    assert got == want
    assert all(sum(s["len"] for s in r.spans or []) == r.n_hit for r in rows)
    kept = decontaminate.clean(df, b)
    assert kept.columns == df.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.scan(empty, b).count() == 0
    assert decontaminate.scan(df, b.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_quality(spark, docs, empty):
    sf = SF.replace("0.001", "0.01")
    big, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r[0]: r[1] for r in labels.select("doc_id", "quality").collect()}
    rows = quality.resample(big, labels).collect()
    share = sum(truth.values()) / len(truth)
    assert sum(r.kept for r in rows) == round(share * len(rows))
    assert min(r.key for r in rows if r.kept) >= max(r.key for r in rows if not r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    good, bad = [i for i in truth if truth[i]], [i for i in truth if not truth[i]]
    assert sum(i in kept for i in good) >= 0.9 * len(good) and sum(i in kept for i in bad) <= 0.4 * len(bad)
    odd = quality.resample(docs, labels, share=0.5).collect()
    assert len(odd) == docs.count() and abs(sum(r.kept for r in odd) - len(odd) / 2) <= 2
    assert quality.resample(empty, labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).where("kept").count() == docs.count()
    for share, n in ((0.0, 0), (1.0, len(odd))):
        assert quality.resample(docs, labels, share=share).where("kept").count() == n
    same = spark.createDataFrame([(1, "a b c")] * 50 + [(2, "d e f")], "doc_id long, text string")
    assert quality.resample(same, labels, share=0.3).where("kept").count() in (1, 50, 51)
