"""Column expressions over stack frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackscope.functions.text import bind, contains_any, starts_with_any, strip
from stackscope.knowledge import PLATFORM_PREFIXES

FRAME_LINE = r"^\s*at\s+([^(]+)\(([^)]*)\)\s*(~\[.*)?$"


def is_frame_line(line: Column) -> Column:
    return line.rlike(FRAME_LINE)


def frame_signature(line: Column) -> Column:
    """Signature of a frame line without its module prefix.

    A prefix goes only when it carries a version: "java.base@21/...".
    """
    return F.regexp_replace(strip(F.regexp_extract(line, FRAME_LINE, 1)), r"^[^/]+@[^/]*/", "")


def frame_location(line: Column) -> Column:
    return F.regexp_extract(line, FRAME_LINE, 2)


def frame_text(line: Column) -> Column:
    """``sig(loc)`` of a frame line (best passed as a plain column); null when the line is no frame."""
    return F.when(is_frame_line(line), F.concat(frame_signature(line), F.lit("("), frame_location(line), F.lit(")")))


def frame_of(raw: Column) -> Column:
    """Frame struct of a ``frame_text``, whose signature ends at the first parenthesis."""
    def build(sig: Column, head: Column, loc: Column) -> Column:
        dotted = head != ""
        return F.struct(
            raw.alias("raw"),
            F.when(dotted, head).otherwise(sig).alias("cls"),
            F.when(dotted, F.substring_index(sig, ".", -1)).otherwise(F.lit("")).alias("method"),
            loc.alias("loc"),
            F.when(dotted, sig).otherwise(F.concat(sig, F.lit("."))).alias("sig"),
            (loc == "Native Method").alias("native"),
        )

    return bind(F.substring_index(raw, "(", 1), lambda sig: bind(F.struct(
        F.regexp_extract(sig, r"^(.+)\.[^.]*$", 1).alias("head"),
        strip(F.substr(raw, F.length(sig) + 2, F.length(raw) - F.length(sig) - 2)).alias("loc")),
        lambda p: build(sig, p["head"], p["loc"])))


def parse_frame(line: Column) -> Column:
    """One ``at sig(loc)`` line as a frame struct; null when the line is no frame."""
    return bind(bind(line, frame_text), lambda raw: F.when(raw.isNotNull(), frame_of(raw)))


def normalize_j9_frame(frame: Column) -> Column:
    """``at a/b/C.m(C.java:1(Compiled Code))`` to ``at a.b.C.m(C.java:1)``."""
    def normal(text: Column) -> Column:
        sig = F.translate(F.substring_index(text, "(", 1), "/", ".")
        inside = F.regexp_extract(text, r"^[^(]*\((.*?)(?:\)[^)]*)?$", 1)
        place = strip(F.replace(F.replace(inside, F.lit("(Compiled Code)"), F.lit("")),
                                 F.lit("(JIT Compiled Code)"), F.lit("")))
        loc = bind(place, lambda p: F.when(F.instr(p, "(") > 1, strip(F.substring_index(p, "(", 1))).otherwise(p))
        return F.when(F.instr(text, "(") == 0, text).otherwise(
            F.concat(sig, F.lit("("), loc, F.lit(")")))

    return bind(strip(frame), normal)


def signatures(frames: Column) -> Column:
    return F.transform(frames, lambda f: f["sig"])


def stack_hash(frames: Column, depth: int | None = None) -> Column:
    """Digest of the frame signatures (line numbers do not count); null for no frames."""
    sigs = signatures(frames)
    if depth is not None:
        sigs = F.slice(sigs, 1, depth)
    return F.when(F.size(frames) > 0, F.md5(F.concat_ws("\n", sigs)))


def any_sig_contains(frames: Column, needles, top: int | None = None) -> Column:
    part = frames if top is None else F.slice(frames, 1, top)
    return F.coalesce(F.exists(part, lambda f: contains_any(f["sig"], needles)), F.lit(False))


def label_of(frames: Column, entries, top: int, value) -> Column:
    """First hit over the top frames, frame by frame, then in entry order.

    ``value(entry)`` gives the column returned for a hit.
    """

    def hit(f):
        out = None
        for e in entries:
            cond = contains_any(f["sig"], e.frames)
            out = F.when(cond, value(e)) if out is None else out.when(cond, value(e))
        return out

    if not entries:
        return F.lit(None)
    hits = F.filter(F.transform(F.slice(frames, 1, top), hit), lambda h: h.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def frame_lines(lines: Column) -> Column:
    """Drop lock annotations and block titles from an annotated stack."""
    return F.filter(lines, lambda s: (F.length(s) > 0) & ~s.startswith("- ")
                    & ~s.startswith("Locked "))


def is_app_frame(cls: Column) -> Column:
    return ~starts_with_any(cls, PLATFORM_PREFIXES)


def has_app_frames(frames: Column) -> Column:
    return F.coalesce(F.exists(frames, lambda f: is_app_frame(f["cls"])), F.lit(False))


def annotated_stack(frames: Column, locks: Column, max_frames: int = 40) -> Column:
    """Stack as shown to people: frames with their lock lines in place."""
    def text(l):
        cls = F.when(l["cls"].isNotNull(), F.concat(F.lit(" (a "), l["cls"], F.lit(")"))) \
            .otherwise(F.lit(""))
        addr = F.concat(F.lit("<"), l["address"], F.lit(">"))
        return (F.when(l["kind"] == "LOCKED_MONITOR", F.concat(F.lit("- locked "), addr, cls))
                .when(l["kind"] == "WAITING_TO_LOCK", F.concat(F.lit("- waiting to lock "), addr, cls))
                .when(l["kind"] == "WAITING_ON", F.concat(F.lit("- waiting on "), addr, cls))
                .when(l["kind"] == "PARKING_TO_WAIT_FOR",
                      F.concat(F.lit("- parking to wait for "), addr, cls))
                .when(l["kind"] == "LOCKED_SYNCHRONIZER", F.concat(F.lit("- "), addr, cls))
                .otherwise(F.concat(F.lit("- eliminated"), cls)))

    def is_wait(l):
        return l["kind"].isin("WAITING_TO_LOCK", "WAITING_ON", "PARKING_TO_WAIT_FOR")

    sync = F.transform(F.filter(locks, lambda l: l["kind"] == "LOCKED_SYNCHRONIZER"), text)
    loose_wait = F.transform(F.filter(
        locks, lambda l: (l["kind"] != "LOCKED_SYNCHRONIZER") & (l["frame_idx"] < 0) & is_wait(l)), text)
    loose_hold = F.transform(F.filter(
        locks, lambda l: (l["kind"] != "LOCKED_SYNCHRONIZER") & (l["frame_idx"] < 0) & ~is_wait(l)), text)
    placed = F.filter(locks, lambda l: (l["kind"] != "LOCKED_SYNCHRONIZER") & (l["frame_idx"] >= 0))
    body = F.flatten(F.transform(
        F.slice(frames, 1, max_frames),
        lambda f, i: F.concat(
            F.array(f["raw"]),
            F.when(i == 0, loose_wait).otherwise(F.array().cast("array<string>")),
            F.transform(F.filter(placed, lambda l: l["frame_idx"] == i), text))))
    empty = F.array().cast("array<string>")
    return F.concat(
        body,
        F.when(F.size(loose_hold) > 0, F.concat(F.array(
            F.lit(""), F.lit("Locked monitors (position in stack unknown):")), loose_hold)).otherwise(empty),
        F.when(F.size(sync) > 0, F.concat(F.array(
            F.lit(""), F.lit("Locked ownable synchronizers:")), sync)).otherwise(empty))


def stack_key(frames: Column, locks: Column, max_frames: int = 40) -> Column:
    """Identity of a shown stack: the hash, plus the annotated lines when locks exist."""
    full = stack_hash(frames)
    lines = F.md5(F.concat_ws("\n", annotated_stack(frames, locks, max_frames)))
    return F.when(full.isNull(), F.lit(None)).when(
        F.size(locks) > 0, F.concat_ws("-", full, lines)).otherwise(full)
