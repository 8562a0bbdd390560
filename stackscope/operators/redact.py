"""Stable pseudonyms for e-mail addresses, IPv4 addresses and host names.

Numbers follow the order in which a token is first met over all rows. They come
from a distributed running count over the distinct tokens, and tokens are replaced
through an equi-join, so neither the texts nor the dictionary pass through one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscope.functions.scan import running
from stackscope.knowledge import HOST_SUFFIXES
from stackscope.session import store

# fixed values: what counts as an address decides every match
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = r"\b(?:" + OCTET + r"\.){3}" + OCTET + r"\b"
HOST = (r"(?<![\w.@])(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+(?:" + "|".join(HOST_SUFFIXES) + r")(?![\w.])")

#: distinct tokens that one task numbers, and how many chunks there are at least and at most
CHUNK_ROWS, FEWEST_CHUNKS, MOST_CHUNKS = 1_000_000, 64, 1000


def _tokens(df: DataFrame, text: str, pattern: str, stage: int) -> DataFrame:
    """(id, stage, pos, token) of every match in the texts."""
    return df.select("_id", F.posexplode(F.regexp_extract_all(text, F.lit("(" + pattern + ")"), F.lit(1)))) \
             .select("_id", F.lit(stage).alias("stage"), "pos", F.col("col").alias("token"))


def _number(first: DataFrame) -> DataFrame:
    """Ordinal of every (kind, token) by its first place (_id, stage, pos).

    Chunks are cut at quantiles of the ids found, so gaps in the ids or a busy range of them make no chunk large.
    """
    n = min(MOST_CHUNKS, max(FEWEST_CHUNKS, first.count() // CHUNK_ROWS + 1))
    at = sorted(set(first.approxQuantile("_id", [i / n for i in range(1, n)], 0.25 / n)))
    place = F.col("_id").cast("double")
    chunk = F.size(F.filter(F.lit(at), lambda b: b <= place)) if at else F.lit(0)
    return running(first.withColumn("_chunk", chunk), ["kind"], "_chunk", ["_id", "stage", "pos"],
                   total={"ord": F.lit(1)})


def _first_seen(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("kind", "token").agg(F.min(F.struct("_id", "stage", "pos")).alias("f")) \
        .select("kind", "token", "f.*")


def _splice(text: Column, pattern: str, pseudo: Column) -> Column:
    """The text with its matches of a pattern replaced by ``pseudo`` (pos, pseudo), in order."""
    parts = F.split(text, pattern, -1)
    # texts between matches alternate with the pseudonyms of the matches
    spliced = F.concat(F.element_at(parts, 1), F.array_join(F.zip_with(
        pseudo, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p, rest: F.concat(p["pseudo"], rest)), ""))
    return F.when(F.size(pseudo) > 0, spliced).otherwise(text)


def redact(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Redacted rows, and the mapping (kind, token, pseudonym, ord).

    ``id_col`` is a unique integer that gives the order of the rows. Only texts with a match are shuffled;
    null texts and texts without one pass through.
    """
    address = f"{EMAIL}|{IPV4}"
    src = df.withColumn("_id", F.col(id_col).cast("long"))
    # the texts are searched once for addresses and once for hosts; everything else works on the stored matches
    one = store(_tokens(src, text, address, 0).withColumn(
        "kind", F.when(F.col("token").contains("@"), "email").otherwise("ip")))
    ips = store(_number(store(_first_seen(one.filter("kind = 'ip'"))))).select(
        "kind", "token", F.concat(F.lit("ip-"), F.col("ord").cast("string")).alias("pseudonym"), "ord")
    # hosts are looked for in what is left between addresses; one may go on from an IPv4 address, whose number is known
    met = one.join(ips, ["kind", "token"], "left").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", F.coalesce("pseudonym", F.lit("user-0@host-0")).alias("pseudo")))).alias("_p"))
    dotted = F.coalesce(F.col(text).rlike(IPV4), F.lit(False))
    blank = src.filter(dotted).join(met, "_id").select("_id", _splice(F.col(text), address, F.col("_p")).alias(text)) \
        .unionByName(src.filter(~dotted).select("_id", F.regexp_replace(text, EMAIL, "user-0@host-0").alias(text)))
    two = store(_tokens(blank, text, HOST, 1).withColumn("kind", F.lit("host")))
    found = one.unionByName(two)
    domain = one.filter("kind = 'email'").select(
        "_id", "stage", "pos", F.substring_index("token", "@", -1).alias("token"), F.lit("host").alias("kind"))
    named = store(_number(store(_first_seen(found.filter("kind <> 'ip'").unionByName(domain)))))
    hosts = _host_pseudonyms(named.filter("kind = 'host'"))
    emails = named.filter("kind = 'email'").select("token", "ord", F.substring_index(
        "token", "@", -1).alias("_d")).join(
        hosts.select(F.col("token").alias("_d"), F.col("pseudonym").alias("_h")), "_d").select(
        F.lit("email").alias("kind"), "token",
        F.concat(F.lit("user-"), F.col("ord").cast("string"), F.lit("@"), F.col("_h")).alias("pseudonym"), "ord")
    mapping = store(hosts.unionByName(emails).unionByName(ips))
    place = F.struct("pos", F.col("pseudonym").alias("pseudo"))
    per_row = found.join(mapping.select("kind", "token", "pseudonym"), ["kind", "token"]).groupBy("_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("stage") == i, place))).alias(f"_p{i}") for i in (0, 1)])
    hit = F.coalesce(F.col(text).rlike(address) | F.col(text).rlike(HOST), F.lit(False))
    # the same host matches again: pseudonyms never look like a host name
    out = src.filter(hit).join(per_row, "_id").withColumn(text, _splice(F.col(text), address, F.col("_p0"))) \
        .withColumn(text, _splice(F.col(text), HOST, F.col("_p1")))
    return out.select(*df.columns).unionByName(df.filter(~hit)), mapping


def _host_pseudonyms(hosts: DataFrame) -> DataFrame:
    """host-N, or prefix-host-N when an earlier host is the part after a hyphen.

    A host first met in an e-mail address is host-N always.
    """
    base = hosts.select("kind", "token", "ord",
                        F.concat(F.lit("host-"), F.col("ord").cast("string")).alias("_plain"))
    words = F.split("token", "-")
    suffix = hosts.filter("stage = 1").select("token", "ord", F.explode(F.transform(
        F.sequence(F.lit(2), F.size(words)),
        lambda i: F.array_join(F.slice(words, i, F.size(words)), "-"))).alias("_s")) \
        .filter(F.instr("token", "-") > 0)
    known = base.select(F.col("token").alias("_s"), F.col("ord").alias("_ko"), F.col("_plain").alias("_kp"))
    reused = suffix.join(known, "_s").filter(F.col("_ko") < F.col("ord")).groupBy("token").agg(
        F.min_by(F.struct("_s", "_kp"), "_ko").alias("k"))
    return base.join(reused, "token", "left").select(
        "kind", "token", F.when(F.col("k").isNull(), F.col("_plain")).otherwise(F.concat(
            F.substr("token", F.lit(1), F.length("token") - F.length("k._s")), F.col("k._kp"))).alias("pseudonym"),
        "ord")
