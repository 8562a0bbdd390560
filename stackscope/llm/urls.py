"""URL filter: rules by host and path, and else logistic regression on hashed character n-grams.

All of it is DataFrame functions. A URL's features are the distinct buckets of the three- and four-letter
n-grams of its host and of its path (digits count as one letter, so that numbers do not matter). The
regression is trained by full-batch gradient steps on a small table of labelled URLs, each step one aggregation; the weights,
DIM numbers, are all that comes to the driver.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscope.llm.common import lower_ascii
from stackscope.session import store

DIM = 2048
GRAMS = (3, 4)

# fixed values: (host, path, verdict) of the stated rules
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of host and path."""
    def grams(text: Column, kind: str) -> Column:
        s = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))
        each = [F.transform(F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1)))
                            .otherwise(F.array().cast("array<int>")), lambda i, n=n: F.substring(s, i, F.lit(n))) for n in GRAMS]
        return F.transform(F.array_distinct(F.concat(*each)), lambda g: F.pmod(F.xxhash64(F.lit(kind), g), F.lit(DIM)).cast("int"))

    return F.array_distinct(F.concat(grams(host, "h"), grams(path, "p")))


def margin(slots: Column, weights: np.ndarray, constant: float) -> Column:
    """Score of a URL: the mean weight of its buckets, scaled, plus the constant."""
    table = F.from_json(F.lit(json.dumps([round(float(w), 9) for w in weights])), "array<double>")
    total = F.aggregate(slots, F.lit(0.0), lambda a, i: a + F.get(table, i))
    return total / F.sqrt(F.greatest(F.size(slots), F.lit(1)).cast("double")) + F.lit(float(constant))


def train(labelled: DataFrame, rounds: int = 12, rate: float = 1.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, constant) from a small table (host, path, label 0 or 1); both labels weigh the same in total."""
    table = store(labelled.where("label in (0, 1)").select(features(F.col("host"), F.col("path")).alias("x"), "label"))
    n = {r[0]: r[1] for r in table.groupBy("label").count().collect()}
    weights, constant = np.zeros(DIM), 0.0
    if len(n) < 2:
        return weights, (8.0 if n.get(1) else -8.0) if n else 0.0
    share = F.when(F.col("label") == 1, 0.5 / n[1]).otherwise(0.5 / n[0])
    seen = np.full(DIM + 1, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-margin(F.col("x"), weights, constant)))
        gap = table.select((share * (F.col("label") - p)).alias("g"), "x")
        # bucket DIM is the constant
        each = gap.select("g", F.size("x").alias("n"), F.explode(F.concat("x", F.array(F.lit(DIM)))).alias("slot"))
        g = np.zeros(DIM + 1)
        for slot, v in each.groupBy("slot").agg(F.sum(F.when(F.col("slot") == DIM, F.col("g")).otherwise(
                F.col("g") / F.sqrt(F.greatest("n", F.lit(1)))))).collect():
            g[slot] = v
        g[:DIM] -= ridge * weights / DIM
        seen += g * g
        step = rate * g / np.sqrt(seen)
        weights, constant = weights + step[:DIM], constant + step[DIM]
    return weights, float(constant)


def labelled_by_rules(urls: DataFrame, limit: int = 4000, rules=RULES) -> DataFrame:
    """(host, path, label): at most ``limit`` distinct URLs that a rule decides, those with the smallest hash; 1 is allow."""
    verdicts = {h + p: v for h, p, v in rules}
    ruled = urls.where("rule is not null").select("host", "path", F.when(F.col("rule").isin(
        [r for r, v in verdicts.items() if v == "allow"]), 1).otherwise(0).alias("label"))
    return ruled.distinct().orderBy(F.xxhash64("host", "path"), "host", "path").limit(limit)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None,
          rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (probability of allow by the regression).

    Verdict: the rule's, where one fits, else allow from a score of 0.5. labelled: a small table (url, label); by
    default a bounded sample of the URLs that a rule decides. Null urls, or ones without ``://``, have empty host and path, no rule, and are
    judged by the regression. With labels of one kind only, or none, all others get that kind, or allow. Repeated rows are judged alike. Other
    columns are not looked at.
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = labelled_by_rules(own, rules=rules)
    else:
        known = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")
    weights, constant = train(known)
    score = 1 / (1 + F.exp(-margin(F.col("x"), weights, constant)))
    scored = own.withColumn("x", features(F.col("host"), F.col("path"))).withColumn("score", score)
    allowed = [h + p for h, p, v in rules if v == "allow"]
    verdict = (F.when(F.col("rule").isin(allowed), "allow").when(F.col("rule").isNotNull(), "block")
               .when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
