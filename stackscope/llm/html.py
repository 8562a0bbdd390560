"""Main text of web pages by a suffix array over each host's token streams.

A page is cut into blocks with a role: body (inside article or main), chrome (menus, headers, footers, asides, forms,
adverts, notices, comments) or open (neither). Chrome goes; of open blocks the tokens covered by boilerplate go and the
unique runs stay; of bodies whole blocks go that are the host's own notices.

Slices of all pages are concatenated and the suffixes of their token streams sorted; suffixes whose first ``min_run``
tokens agree stand together and are counted, and the counts of all slices are added up by (host, run). So slices,
partitions and the order of rows do not decide the text. Two kinds of runs are joined back to the pages:

* boilerplate, for hosts with open blocks: runs on enough distinct pages of the whole host, mostly outside bodies;
* site-wide runs, for every host: outside bodies on more than half of its pages. There are at most twice as many as a
  page has on average. A body block wholly covered by such runs goes if they stand so in enough distinct bodies. What
  repeats in bodies alone stays, since copied articles repeat too, and so does an article that menus quote everywhere.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscope.llm.common import Cache, in_batches, lower_ascii, mix, odd_numbers
from stackscope.session import store

# fixed values: tags by what they mean for the main text
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select
summary table tbody td tfoot th thead title tr ul head""".split())
SKIPPED = frozenset("script style noscript template svg annotation annotation-xml iframe object head title textarea select canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
CHROME = frozenset("nav footer header aside form button dialog menu".split())
CHROME_NAME = re.compile(r"(?:^|[_-])(ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|cookies?|consent|disqus|"
                         r"footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promos?|"
                         r"promotions?|related|share|sharing|sidebar|social|sponsors?|sponsored|subscribe|widget)(?:$|[_-])", re.I)
#: names that say what stands beside an element
BESIDE = re.compile(r"(?:has|no|with|without)[_-]", re.I)
UNNAMED = frozenset("html body main article h1 h2 h3 h4 h5 h6 hgroup".split())
CHROME_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BODY = frozenset(("article", "main"))

TAG = re.compile(r"<(?:!--(?:.*?(?:-->|\Z))|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
SPACE = re.compile(r"\s+")
CLOSERS = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"},
           "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
OPEN, IN_BODY, IS_CHROME = 0, 1, 2
#: inside ``blocks``: chrome by a class or id alone; an article inside is body again
NAMED = 3


def _chrome(tag: str, attrs: str) -> int:
    """IS_CHROME, NAMED or OPEN, by the tag and its attributes."""
    if tag in CHROME:
        return IS_CHROME
    found = OPEN
    if tag in ("html", "body") or not attrs or attrs.isspace():
        return found
    for m in ATTR.finditer(attrs):
        name, value = m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if name in ("class", "id"):
            if tag not in UNNAMED and any(CHROME_NAME.search(x) and not BESIDE.match(x) for x in value.split()):
                found = NAMED
        elif (name == "role" and value.lower() in CHROME_ROLE or name == "hidden"
              or name == "aria-hidden" and value.lower() == "true"
              or name == "style" and "display:none" in value.replace(" ", "").lower()):
            return IS_CHROME
    return found


def blocks(source: str) -> list[tuple[int, str]]:
    """(role, text) of the blocks of a page in order; references decoded, white space folded, none empty."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []       # open tags and the role inside each
    role, at, skip = OPEN, 0, 0

    def flush() -> None:
        if text:
            s = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if s:
                out.append((min(role, IS_CHROME), s))

    n = len(source)
    while at < n:
        m = TAG.search(source, at)
        if m is None:
            if not skip:
                text.append(source[at:])
            break
        if not skip and m.start() > at:
            text.append(source[at:m.start()])
        at, tag = m.end(), (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            places = [k for k, (t, _) in enumerate(stack) if t == tag]
            if tag in BLOCK or places and stack[places[-1]][1] != role:
                flush()
            if places:
                del stack[places[-1]:]
                role = stack[-1][1] if stack else OPEN
                skip = sum(t in SKIPPED for t, _ in stack)
            continue
        if tag == "br":
            text.append(" ")
            continue
        closes = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1)
                       if tag in CLOSERS.get(stack[k][0], ())), None)
        if tag in BLOCK:
            flush()
            if closes is not None:
                del stack[closes:]
                role = stack[-1][1] if stack else OPEN
                skip = sum(t in SKIPPED for t, _ in stack)
        if tag in VOID or m.group(0).endswith("/>") and tag not in BLOCK | SKIPPED:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        own = role
        if role != IS_CHROME:
            kind = OPEN if tag == "header" and role == IN_BODY else _chrome(tag, m.group(3))
            # what is named so inside an article, as its comments, does not hold the article
            own = IS_CHROME if kind == NAMED and role == IN_BODY else kind or (IN_BODY if tag in BODY else role)
        if own != role:
            flush()
        stack.append((tag, own))
        role = own
        skip += tag in SKIPPED
    flush()
    return out


def run_digests(tokens: np.ndarray, at: np.ndarray, min_run: int) -> np.ndarray:
    """Of the runs of ``min_run`` tokens that begin at these places."""
    mult = odd_numbers(min_run, 23)
    h = np.zeros(len(at), np.uint64)
    for j in range(min(min_run, len(tokens))):
        h += tokens[at + j].astype(np.uint64) * mult[j]
    return mix(h).astype(np.int64)


class Suffixes:
    """The suffixes of several token streams, ranked by their first ``min_run`` tokens by doubling.

    A separator of its own ends each page. Ranks of one run's suffixes stand together in the sorted array, as a group.
    """

    def __init__(self, streams: list[np.ndarray], body: list[np.ndarray], min_run: int):
        self.min_run = min_run
        self.sizes = sizes = np.array([len(s) + 1 for s in streams])
        self.total = total = int(sizes.sum())
        self.first = first = np.cumsum(sizes) - sizes
        self.page = page = np.repeat(np.arange(len(streams)), sizes)
        self.every = every = np.zeros(total, np.int64)
        in_body = np.zeros(total, bool)
        for k, s in enumerate(streams):
            every[first[k]:first[k] + len(s)] = s.astype(np.int64)
            in_body[first[k]:first[k] + len(s)] = body[k]
        _, rank = np.unique(every, return_inverse=True)
        ends = first + sizes - 1
        rank = rank + len(streams)
        rank[ends] = np.arange(len(streams))              # separators differ, so no run crosses a page's end
        length = 1
        while length < min_run:
            step = min(length, min_run - length)
            after = np.full(total, -1)
            after[:-step] = rank[step:]
            _, rank = np.unique(rank * (total + len(streams) + 1) + after + 1, return_inverse=True)
            length += step
        self.order = order = np.argsort(rank, kind="stable")
        ranked, pages = rank[order], page[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        self.group = np.cumsum(new) - 1
        self.head = order[new]
        self.whole = self.head + min_run <= ends[page[self.head]]
        self.pages = np.bincount(self.group, np.r_[True, (pages[1:] != pages[:-1]) | new[1:]])  # stable: pages ascend in a group
        self.count = np.bincount(self.group)
        away = ~in_body[order]
        self.outside = np.bincount(self.group, away)
        g, p = self.group[away], pages[away]
        self.away = np.bincount(g[np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])][:len(g)]], minlength=len(self.head))

    def digests(self) -> np.ndarray:
        """Of each group's run; only those of ``whole`` groups mean anything."""
        return run_digests(self.every, np.minimum(self.head, max(self.total - self.min_run, 0)), self.min_run)

    def covered(self, groups: np.ndarray) -> list[np.ndarray]:
        """For each page, which tokens lie in runs of these groups."""
        starts = np.zeros(self.total + 1, np.int64)
        hit = self.order[(groups & self.whole)[self.group]]
        np.add.at(starts, hit, 1)
        np.add.at(starts, np.minimum(hit + self.min_run, self.total), -1)
        inside = np.cumsum(starts)[:-1] > 0
        return [inside[a:a + n - 1] for a, n in zip(self.first, self.sizes)]


def repeated(streams: list[np.ndarray], body: list[np.ndarray], min_run: int, min_pages: int,
             known: np.ndarray | None = None) -> list[np.ndarray]:
    """For each page, which tokens lie in boilerplate: runs with a ``known`` digest, or if not given those of these pages."""
    if not streams or known is None and len(streams) < min_pages or known is not None and not len(known):
        return [np.zeros(len(s), bool) for s in streams]
    found = Suffixes(streams, body, min_run)
    return found.covered((found.pages >= min_pages) & (found.outside * 2 > found.count) if known is None
                         else np.isin(found.digests(), known))


def streams(rows: list[dict], tokens: Cache) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tokens, role of each) of each page; a token of another host is another token."""
    out = []
    for r in rows:
        words = [t.split(" ") for t in r["texts"]]
        salt = np.uint64(tokens["\n" + r["host"]])
        out.append((np.array([tokens[w] for b in words for w in b], np.uint64) ^ salt,
                    np.repeat(np.array(r["roles"], np.int8), [len(b) for b in words])))
    return out


def counts(rows: list[dict], tokens: Cache, min_run: int) -> dict[str, np.ndarray]:
    """Digest, pages, occurrences and those outside bodies of the runs of a slice of pages."""
    cut = streams(rows, tokens)
    found = Suffixes([s for s, _ in cut], [r == IN_BODY for _, r in cut], min_run)
    ok = found.whole
    return {"h": found.digests()[ok], "pages": found.pages[ok].astype(np.int64), "n": found.count[ok],
            "outside": found.outside[ok].astype(np.int64)}


def outside_counts(rows: list[dict], tokens: Cache, min_run: int) -> dict[str, np.ndarray]:
    """Digest, number of the host and pages of the runs of a slice that stand outside bodies, on pages where they do."""
    cut = streams(rows, tokens)
    found = Suffixes([s for s, _ in cut], [r == IN_BODY for _, r in cut], min_run)
    ok = found.whole & (found.away > 0)
    host = np.array([r["of"] for r in rows], np.int64)
    return {"h": found.digests()[ok], "of": host[found.page[found.head[ok]]], "pages": found.away[ok].astype(np.int64)}


def block_runs(text: str, host: str, tokens: Cache, min_run: int) -> np.ndarray:
    """Distinct digests of the runs that lie wholly in a block."""
    words = text.split(" ")
    own = np.array([tokens[w] for w in words], np.uint64) ^ np.uint64(tokens["\n" + host])
    return np.unique(run_digests(own, np.arange(max(len(own) - min_run + 1, 0)), min_run))


def open_runs(row: dict, tokens: Cache, min_run: int) -> np.ndarray:
    """Distinct digests of a page's runs that reach into open blocks."""
    (own, role), = streams([row], tokens)
    found = Suffixes([own], [role == IN_BODY], min_run)
    reach = np.r_[0, np.cumsum(np.r_[role == OPEN, False])]
    touches = np.zeros(len(found.head), bool)
    start = np.arange(found.total)
    np.logical_or.at(touches, found.group, (reach[np.minimum(start + min_run, found.total)] > reach[start])[found.order])
    return found.digests()[found.whole & touches]


def main_text(row: dict, tokens: Cache, min_run: int) -> str:
    """Main text of a page; ``gone`` has digests of its boilerplate, ``site`` those of site-wide runs in its bodies."""
    gone, site = (np.array(row[k] or [], np.int64) for k in ("gone", "site"))
    if not len(gone) and not len(site):
        return " ".join(t for r, t in zip(row["roles"], row["texts"]) if r != IS_CHROME)
    (own, role), = streams([row], tokens)
    mask, = repeated([own], [role == IN_BODY], min_run, 0, gone)
    at, kept = 0, []
    for r, text in zip(row["roles"], row["texts"]):
        b = text.split(" ")
        if r == IN_BODY:
            notice, = repeated([own[at:at + len(b)]], [role[at:at + len(b)] == IN_BODY], min_run, 0, site)
            if not notice.all():
                kept.append(text)
        elif r == OPEN:
            left = " ".join(w for w, x in zip(b, mask[at:at + len(b)]) if not x)
            if left:
                kept.append(left)
        at += len(b)
    return " ".join(kept)


def _tokens() -> Cache:
    return Cache(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_run: int = 6,
            min_pages: int = 3, group: int = 256, group_chars: int = 4_000_000) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null or empty html: empty text. Pages with a null url, or without a host, form one host. Repeated rows count as
    distinct pages, but not as distinct bodies; ``min_pages`` of either over the whole host. Body blocks of fewer than
    ``min_run`` tokens stay. Slices end after ``group`` pages or ``group_chars`` characters, a bound on memory only,
    since their counts are added up. Other columns are not looked at.
    """
    host = lower_ascii(F.coalesce(F.regexp_extract(F.col(url_col), "://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html"), host.alias("host"))
    at = [-1, 0]

    def parse(cols: dict) -> dict:
        part = TaskContext.get().partitionId()
        if at[0] != part:
            at[:] = part, part << 40
        cut = [blocks(h or "") for h in cols["html"]]
        at[1] += len(cut)
        return {"row": range(at[1] - len(cut), at[1]), "id": cols["id"], "url": cols["url"], "host": cols["host"],
                "open": [any(r == OPEN for r, _ in page) for page in cut],
                "roles": [[r for r, _ in page] for page in cut], "texts": [[t for _, t in page] for page in cut]}

    parsed = store(in_batches(rows, parse, "row long, id long, url string, host string, open boolean, "
                                           "roles array<tinyint>, texts array<string>"))

    def sliced(fn: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, held, chars = _tokens(), [], 0
            for b in batches:
                for r in b.to_pylist():
                    size = sum(map(len, r["texts"]))
                    if held and (len(held) >= group or chars + size > group_chars):
                        yield pa.RecordBatch.from_pydict(fn(held, tokens, min_run))
                        held, chars = [], 0
                    held.append(r)
                    chars += size
            if held:
                yield pa.RecordBatch.from_pydict(fn(held, tokens, min_run))
        return run

    def finish(cols: dict) -> dict:
        tokens = _tokens()
        return {"id": cols["id"], "url": cols["url"], "text": [
            main_text({"host": h, "roles": r, "texts": t, "gone": g, "site": s}, tokens, min_run) for h, r, t, g, s in zip(
                cols["host"], cols["roles"], cols["texts"], cols["gone"], cols["site"])]}

    # stored, so that Spark knows how few pages have any and need not deal all pages out anew
    known = store(_boilerplate(parsed, sliced, min_run, min_pages).join(_notices(parsed, sliced, min_run, min_pages), "row", "full"))
    left = in_batches(parsed.join(known, "row", "left").select("id", "url", "host", "roles", "texts", "gone", "site"), finish,
                      "id long, url string, text string")
    return left.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                       F.length("text").cast("long").alias("n_chars"))


def _boilerplate(parsed: DataFrame, sliced: Callable, min_run: int, min_pages: int) -> DataFrame:
    """(row, gone): of pages with open blocks, the boilerplate of their host that reaches into these."""
    unsure = parsed.where("open")
    if unsure.isEmpty():
        return parsed.sparkSession.createDataFrame([], "row long, gone array<long>")

    def reach(cols: dict) -> dict:
        tokens = _tokens()
        found = [open_runs({"host": h, "roles": r, "texts": t}, tokens, min_run) for h, r, t in zip(
            cols["host"], cols["roles"], cols["texts"])]
        return {"row": np.repeat(np.array(cols["row"], np.int64), [len(x) for x in found]), "h": np.concatenate(found)}

    slices = (parsed.join(unsure.select("host").distinct(), "host", "left_semi").select("host", "roles", "texts")
              .mapInArrow(sliced(counts), "h long, pages long, n long, outside long"))
    boilerplate = (slices.groupBy("h").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("outside").alias("outside"))
                   .where((F.col("pages") >= min_pages) & (F.col("outside") * 2 > F.col("n"))).select("h"))
    return (in_batches(unsure.select("row", "host", "roles", "texts"), reach, "row long, h long").join(boilerplate, "h")
            .groupBy("row").agg(F.collect_set("h").alias("gone")))  # one page's own runs


def _notices(parsed: DataFrame, sliced: Callable, min_run: int, min_pages: int) -> DataFrame:
    """(row, site): of pages whose bodies have blocks that begin with a site-wide run, the site-wide runs in these."""
    away = (parsed.select("host", F.xxhash64("host").alias("of"), "roles", "texts")
            .mapInArrow(sliced(outside_counts), "h long, of long, pages long")
            .groupBy("h", "of").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages))
    hosts = parsed.groupBy(F.xxhash64("host").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    wide = store(away.join(hosts, "of").where("2 * pages > size").select("h"))

    def begin(cols: dict) -> dict:
        tokens, row, block, own = _tokens(), [], [], []
        for i, host, roles, texts in zip(cols["row"], cols["host"], cols["roles"], cols["texts"]):
            salt = tokens["\n" + host]
            for k, (r, t) in enumerate(zip(roles, texts)):
                words = t.split(" ", min_run)[:min_run] if r == IN_BODY else []
                if len(words) == min_run:
                    row.append(i)
                    block.append(k)
                    own += [tokens[w] ^ salt for w in words]
        return {"row": row, "block": block, "h": run_digests(np.array(own, np.uint64), np.arange(0, len(own), min_run), min_run)}

    def inside(cols: dict) -> dict:
        tokens = _tokens()
        found = [np.unique(np.concatenate([block_runs(t[k], h, tokens, min_run) for k in b])) for h, t, b in zip(
            cols["host"], cols["texts"], cols["blocks"])]
        sizes = [len(x) for x in found]
        # copies of an article are one body, whatever notices they show: the smallest digest of the other blocks tells
        bodies = [min((tokens[t] for k, (r, t) in enumerate(zip(roles, texts)) if r == IN_BODY and k not in b), default=0)
                  for roles, texts, b in zip(cols["roles"], cols["texts"], cols["blocks"])]
        return {"row": np.repeat(np.array(cols["row"], np.int64), sizes), "body": np.repeat(np.array(bodies, np.int64), sizes),
                "h": np.concatenate(found)}

    near = store(in_batches(parsed.select("row", "host", "roles", "texts"), begin, "row long, block int, h long")
                 .join(wide, "h", "left_semi").groupBy("row").agg(F.collect_set("block").alias("blocks")))
    held = store(in_batches(parsed.join(near, "row").select("row", "host", "roles", "texts", "blocks"), inside,
                            "row long, body long, h long").join(wide, "h", "left_semi"))
    often = held.groupBy("h").agg(F.count_distinct("body").alias("bodies")).where(F.col("bodies") >= min_pages).select("h")
    return held.join(often, "h", "left_semi").groupBy("row").agg(F.collect_set("h").alias("site"))
