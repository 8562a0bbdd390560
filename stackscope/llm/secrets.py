"""Secret scans: Aho-Corasick keywords first, anchored expressions at the hits, checksums last.

Base kinds are assign, access and hex; the method adds github and npm tokens (whose last six characters
encode the CRC-32 of the rest), JSON web tokens (whose header must decode) and private key blocks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stackscope.llm.common import ASCII_LOWER, in_batches

# fixed values: the base rules, by kind
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = 3

TOKEN = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
         "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END \1PRIVATE KEY-----")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",),
            "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "jwt": ("eyj",), "pem": ("-----begin",)}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def checksum_fits(body: str, tail: str) -> bool:
    """The tail is the CRC-32 of the body in base 62, padded to six digits."""
    crc, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = DIGITS[d] + digits
    return digits == tail


def _header_decodes(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def find(text: str, keys: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, sorted; code points, end exclusive."""
    low = text.lower() if text.isascii() else text.translate(ASCII_LOWER)
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in keys.iter(low):
        hits.setdefault(kind, []).append(end - n + 1)
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        k, done = KINDS.index(kind), 0
        for s in sorted(starts):
            if s < done:  # inside the last match
                continue
            if kind == "assign":
                m = ASSIGN.match(text, s)
                good = m and len(m.group(2)) >= 12
            elif kind == "access":
                m = ACCESS.match(text, s)
                good = m and m.end() - s >= 18
            elif kind == "jwt":
                m = JWT.match(text, s)
                good = m and _header_decodes(m.group())
            elif kind == "pem":
                m = good = PEM.match(text, s)
            else:
                m = TOKEN[kind].match(text, s)
                good = m and checksum_fits(m.group(1), m.group(2))
            if m:
                done = m.end()
                if good:
                    found.append((s, k, done))
    return sorted(found)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text is taken as empty: no spans. Null ids stay null; equal rows get equal results. Other columns are not looked at.
    """
    keys: list = []

    def work(cols: dict) -> dict:
        if not keys:
            keys.append(automaton())
        out: dict[str, list] = {c: [] for c in ("id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for i, text in zip(cols["id"], cols["text"]):
            spans = find(text or "", keys[0])
            base = [x for x in spans if x[1] < BASE]
            out["id"].append(i)
            for k in range(BASE):
                out[f"n_{KINDS[k]}"].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(spell(base).encode()).hexdigest())
            out["spans"].append(spell(spans))
        return out

    got = in_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work,
                     "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return got.withColumnRenamed("id", id_col)


def masked(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret in the text replaced by the mark; all columns and rows stay.

    Null text stays null. Overlapping secrets are replaced together.
    """
    keys: list = []
    kinds = to_arrow_schema(docs.schema)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keys:
            keys.append(automaton())
        for b in batches:
            new = [t if t is None else hide(t, keys[0], mark) for t in b.column(at).to_pylist()]
            columns = [*b.columns[:at], pa.array(new), *b.columns[at + 1:]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return docs.mapInArrow(run, docs.schema)


def hide(text: str, keys: ahocorasick.Automaton, mark: str) -> str:
    parts, at = [], 0
    for s, _, e in find(text, keys):
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])
