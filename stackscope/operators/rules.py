"""Declarative detection rules over the derived thread table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscope.functions.frames import any_sig_contains
from stackscope.functions.text import contains_any, full_match
from stackscope.knowledge import BUNDLED_RULES, RuleEntry
from stackscope.operators.derive import java_threads
from stackscope.operators.series import cpu_delta, longest_runs
from stackscope.session import cut, store

SERIES_RULE = ["series_id", "rule_id"]
THREAD = ["series_id", "dump_idx", "thread_ord"]
#: patterns of a rule table that give no literal start and no frames become expressions
MAX_OPEN_PATTERNS = 500
_GRAMS = (1, 2, 4, 8, 16, 32, 64)


def _rule_condition(rule: RuleEntry):
    cond = F.lit(True)
    if rule.states:
        cond = cond & F.col("state").isin(*rule.states)
    if rule.name_regex:
        cond = cond & full_match(F.col("name"), rule.name_regex)
    if rule.frames:
        cond = cond & any_sig_contains(F.col("frames"), rule.frames)
    return cond


def _first_frame(rule: RuleEntry):
    hits = F.filter("frames", lambda x: contains_any(x["sig"], rule.frames))
    return F.try_element_at(hits, F.lit(1))["raw"]


def rule_matches(t: DataFrame, rules=BUNDLED_RULES) -> DataFrame:
    """(series, dump, thread, rule): one scan of the threads for all rules."""
    hit = F.array_compact(F.array(*[
        F.when(_rule_condition(r), F.lit(r.rule_id)) for r in rules]))
    frame = None
    for r in rules:
        if r.frames:
            f = _first_frame(r)
            frame = F.when(F.col("rule_id") == r.rule_id, f) if frame is None \
                else frame.when(F.col("rule_id") == r.rule_id, f)
    frame = F.lit(None).cast("string") if frame is None else frame
    return java_threads(t).select(
        "series_id", "dump_idx", "thread_ord", "name", "key", "frames", F.explode(hit).alias("rule_id")) \
        .withColumn("frame", frame).drop("frames")


def _literal_start(pattern):
    """The text every full match of a pattern starts with; empty where none is certain."""
    head = r"^((?:[^\\.^$|?*+()\[\]{}]|\\[^A-Za-z0-9])*)"
    got = F.regexp_extract(pattern, head, 1)
    # a quantifier is about the last character
    after = F.substring(pattern, F.length(got) + 1, F.lit(1))
    got = F.when(after.isin("?", "*", "+", "{"), F.regexp_replace(got, r"(\\.|.)$", "")).otherwise(got)
    return F.when(F.contains(pattern, F.lit("|")), F.lit("")).otherwise(F.regexp_replace(got, r"\\(.)", "$1"))


def rule_rows(rules: DataFrame) -> DataFrame:
    """Rules as the matcher reads them: no null or twofold lists, states in capitals, an empty pattern is none, defaults filled in."""
    words = lambda c: F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))
    return rules.select(
        "rule_id", "title", F.upper("severity").alias("severity"), "recommendation", words(F.col("frames")).alias("frames"),
        F.when(F.col("name_regex") != "", F.col("name_regex")).alias("name_regex"), words(F.transform("states", lambda x: F.upper(x))).alias("states"),
        F.when(F.coalesce("min_threads", F.lit(0)) == 0, 1).otherwise(F.col("min_threads")).alias("min_threads"),
        "warn_threads", "critical_threads", "persist_dumps", "cpu_delta")


def _sig_hits(sigs: DataFrame, needles: DataFrame) -> DataFrame:
    """(sig, needle) with the needle inside the frame, through an inverted index.

    A frame is listed under its parts of 1, 2, 4 ... characters, a needle under one part of it of
    the largest such length: the one that the fewest frames have. Only frames of that list are read.
    """
    size = F.lit(0)
    for n in _GRAMS:
        size = F.when(F.length("needle") >= n, n).otherwise(size)
    parts = lambda c, n: F.when(F.length(c) >= n, F.transform(
        F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    listed = sigs.select("sig", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[
        F.coalesce(parts(F.col("sig"), F.lit(n)), F.array().cast("array<string>")) for n in _GRAMS]))).alias("gram"))
    wanted = needles.withColumn("_n", size).select("needle", F.explode(F.when(F.col("_n") == 0, F.array(F.lit(""))).otherwise(
        parts(F.col("needle"), F.col("_n")))).alias("gram")).distinct()
    often = listed.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("_f"))
    # a part that no frame has means no hit at all
    least = wanted.join(often, "gram", "left").groupBy("needle").agg(
        F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "gram")).alias("m")).filter("m.f > 0")
    return listed.join(least.select("needle", F.col("m.gram").alias("gram")), "gram").filter(
        F.contains("sig", F.col("needle"))).select("sig", "needle")


def rule_table_matches(t: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule_matches`` for a table of rules of any length.

    No rule becomes an expression: names and frames are looked up as distinct values in indexes of
    the rules' texts, and threads join the hits. A rule is found by the literal start of its name
    pattern, else by its frames, else by its states; all its conditions are checked after that.
    At most ``MAX_OPEN_PATTERNS`` rules may have nothing but a pattern without a literal start.
    """
    r = rule_rows(rules).withColumn("_start", F.coalesce(_literal_start(F.col("name_regex")), F.lit("")))
    r = r.withColumn("_by", F.when(F.col("_start") != "", "name").when(F.size("frames") > 0, "frame")
                     .when(F.col("name_regex").isNull(), "state").otherwise("pattern"))
    r = store(r)
    java = java_threads(t)
    pattern = lambda c: F.concat(F.lit("^(?:"), c, F.lit(")$"))
    names = java.select("name").distinct()

    # the literal start against every start of a distinct name
    by_name = r.filter("_by = 'name'").select("rule_id", "name_regex", F.substring("_start", 1, 128).alias("_start"))
    starts = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(128))), lambda i: F.substring(
        F.col("name"), F.lit(1), i))).alias("_start"))
    named = starts.filter("name <> ''").join(by_name, "_start").filter(
        F.rlike("name", pattern(F.col("name_regex")))).select("name", "rule_id")
    loose = r.filter("_by = 'pattern'").select("rule_id", "name_regex").limit(MAX_OPEN_PATTERNS + 1).collect()
    if len(loose) > MAX_OPEN_PATTERNS:
        raise ValueError(f"more than {MAX_OPEN_PATTERNS} rules with a pattern alone that starts with no literal text")
    if loose:
        hit = F.array_compact(F.array(*[F.when(full_match(F.col("name"), x.name_regex), F.lit(x.rule_id)) for x in loose]))
        named = named.unionByName(names.select("name", F.explode(hit).alias("rule_id")))
    keys = java.select(*THREAD, "name", "state")
    from_names = keys.join(named, "name").select(*THREAD, "rule_id")

    # frames: distinct ones against the index, and threads through the frames that hit
    used = java.select(*THREAD, F.explode(F.transform("frames", lambda f: f["sig"])).alias("sig"))
    needles = r.select(F.col("rule_id"), "_by", F.explode("frames").alias("needle"))
    hits = cut(_sig_hits(used.select("sig").distinct(), needles.select("needle").distinct()).join(
        needles, "needle").select("sig", "rule_id", "_by").distinct())
    from_frames = used.join(hits.filter("_by = 'frame'"), "sig").select(*THREAD, "rule_id").distinct()
    from_states = keys.join(r.filter("_by = 'state'").select("rule_id", F.explode("states").alias("state")), "state") \
        .select(*THREAD, "rule_id")
    every = [x.rule_id for x in r.filter("_by = 'state' AND size(states) = 0").select("rule_id").limit(MAX_OPEN_PATTERNS + 1).collect()]
    if len(every) > MAX_OPEN_PATTERNS:
        raise ValueError(f"more than {MAX_OPEN_PATTERNS} rules without any condition")
    found = from_names.unionByName(from_frames).unionByName(from_states)
    if every:
        found = found.unionByName(keys.select(*THREAD, F.explode(F.array(*[F.lit(x) for x in every])).alias("rule_id")))

    found = found.join(r.select("rule_id", "_by", F.col("frames").alias("_needles"), "name_regex", F.col("states").alias("_states")), "rule_id")
    m = found.join(java.select(*THREAD, "name", "key", "state", "frames"), THREAD).filter(
        ((F.size("_states") == 0) | F.array_contains("_states", F.col("state")))
        & (F.col("name_regex").isNull() | F.col("_by").isin("name", "pattern") | F.rlike("name", pattern(F.col("name_regex")))))
    first = F.try_element_at(F.filter("frames", lambda f: F.exists("_needles", lambda n: F.contains(f["sig"], n))), F.lit(1))["raw"]
    return m.withColumn("frame", first).filter((F.size("_needles") == 0) | F.col("frame").isNotNull()).select(
        *THREAD, "name", "key", "rule_id", "frame")


def _meta(rules):
    """Rule fields as literal lookups, no join needed."""
    def pick(attr, typ):
        out = None
        for r in rules:
            v = F.lit(getattr(r, attr)).cast(typ)
            out = F.when(F.col("rule_id") == r.rule_id, v) if out is None \
                else out.when(F.col("rule_id") == r.rule_id, v)
        return F.lit(None).cast(typ) if out is None else out
    return pick


def evaluate_rules(t: DataFrame, dump: DataFrame, occ: DataFrame, rules=BUNDLED_RULES,
                   names: int = 15) -> DataFrame:
    """Rules that fire, one row per series and rule. ``rules`` are entries, or a table of any length."""
    if isinstance(rules, DataFrame):
        rows = rule_rows(rules)
        m = store(rule_table_matches(t, rules))
        fields = rows.select("rule_id", F.struct(*[c for c in rows.columns if c not in ("rule_id", "frames", "states")]).alias("_rule"))
        pick = lambda attr, typ: F.col(f"_rule.{attr}").cast(typ)
        bind = lambda df: df.join(fields, "rule_id")
        persist = cpu_rules = True
    else:
        rules = tuple(rules)
        m, pick, bind = rule_matches(t, rules), _meta(rules), lambda df: df
        persist = [r for r in rules if r.persist_dumps is not None]
        cpu_rules = [r for r in rules if r.cpu_delta in ("zero", "spinning")]
    per_dump = m.groupBy(*SERIES_RULE, "dump_idx").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("key", "frame"), "thread_ord").alias("_first"))
    worst = per_dump.groupBy(*SERIES_RULE).agg(
        F.max_by(F.struct("dump_idx", "n", "_first"), F.struct("n", -F.col("dump_idx"))).alias("w")) \
        .select(*SERIES_RULE, F.col("w.dump_idx").alias("dump_idx"), F.col("w.n").alias("matched"),
                F.col("w._first.key").alias("_first_key"), F.col("w._first.frame").alias("frame"))
    df = bind(worst).filter(F.col("matched") >= F.coalesce(pick("min_threads", "int"), F.lit(1)))

    if persist:
        runs = longest_runs(bind(m).filter(pick("persist_dumps", "int").isNotNull()), SERIES_RULE)
        kept = bind(runs).filter(F.col("run") >= pick("persist_dumps", "int")).groupBy(*SERIES_RULE).agg(
            F.min("key").alias("_persist_key"))
        df = df.join(kept, SERIES_RULE, "left")
    else:
        df = df.withColumn("_persist_key", F.lit(None).cast("string"))
    needs_persist = pick("persist_dumps", "int").isNotNull()
    df = df.filter(~needs_persist | F.col("_persist_key").isNotNull())

    mode = pick("cpu_delta", "string")
    if cpu_rules:
        d = cpu_delta(occ.filter(~F.col("is_vm")), dump)
        df = df.withColumn("key", F.coalesce("_persist_key", "_first_key")).join(
            d.select("series_id", "key", "ratio"), ["series_id", "key"], "left").drop("key")
        ok = (F.when(mode == "zero", F.col("ratio") <= 0.05)
              .when(mode == "spinning", F.col("ratio") >= 0.70).otherwise(F.lit(True)))
        df = df.filter(F.coalesce(ok, F.lit(False)))
    cap = pick("severity", "string")
    severity = (F.when(cap == "INFO", "INFO")
                .when(F.col("matched") < pick("warn_threads", "int"), "INFO")
                .when((cap == "CRITICAL") & (F.col("matched") >= pick("critical_threads", "int")), "CRITICAL")
                .otherwise("WARNING"))
    title = F.replace(F.replace(pick("title", "string"), F.lit("{count}"), F.col("matched").cast("string")),
                      F.lit("{dump}"), F.col("dump_idx").cast("string"))
    w = Window.partitionBy(*SERIES_RULE, "dump_idx").orderBy("thread_ord")
    shown = m.select(*SERIES_RULE, "dump_idx", "thread_ord", "name", F.row_number().over(w).alias("_rn")) \
        .filter(F.col("_rn") <= names).groupBy(*SERIES_RULE, "dump_idx").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("thread_ord", "name"))),
                        lambda s: s["name"]).alias("threads"))
    return df.join(shown, [*SERIES_RULE, "dump_idx"]).select(
        *SERIES_RULE, severity.alias("severity"), title.alias("title"), "dump_idx", "matched", "frame",
        "threads", pick("recommendation", "string").alias("recommendation"),
        F.when(mode.isNotNull() | needs_persist, "high").otherwise("medium").alias("confidence"))


def dry_run_rules(t: DataFrame, dump: DataFrame, occ: DataFrame, rules=BUNDLED_RULES) -> DataFrame:
    """Every rule for every series, fired or not."""
    fired = evaluate_rules(t, dump, occ, rules).select(*SERIES_RULE, "severity", "matched", "dump_idx")
    every = dump.select("series_id").distinct().select(
        "series_id", F.explode(F.array(*[F.lit(r.rule_id) for r in rules])).alias("rule_id"))
    return every.join(fired, SERIES_RULE, "left").withColumn("fired", F.col("severity").isNotNull())


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
