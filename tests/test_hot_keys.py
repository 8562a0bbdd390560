"""One key that holds nearly all rows: results against plain versions, and work that spreads."""

import random

import pytest
from pyspark.sql import functions as F

from stackscope.operators import findings, locks, series


@pytest.fixture()
def eight(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def lock_threads(spark, waits, holds):
    """Threads from (dump, ord, address waited for) and (dump, ord, addresses held)."""
    lock = "struct<kind:string,address:string,cls:string,frame_idx:int>"
    rows = [(d, o, f"w{o:06d}", [("WAITING_TO_LOCK", a, "x.L", 0)], ("WAITING_TO_LOCK", a, "x.L", 0)) for d, o, a in waits]
    rows += [(d, o, f"h{o:06d}", [("LOCKED_MONITOR", a, "x.L", 0) for a in aa], None) for d, o, aa in holds]
    df = spark.createDataFrame(rows, f"dump_idx int, thread_ord long, name string, locks array<{lock}>, wait_lock {lock}")
    return df.withColumn("series_id", F.lit("s")).withColumn("key", F.col("name"))


def test_waiters_of_one_lock_are_spread(eight):
    waits = [(0, o, "0x1") for o in range(20000)] + [(0, 20000 + o, "0x2") for o in range(5)] + [(1, 3, "0x1"), (1, 4, "0x9")]
    t = lock_threads(eight, waits, [(0, 30000, ["0x1"]), (0, 30001, ["0x2"]), (1, 30000, ["0x1"])])
    edges = {(r.dump_idx, r.waiter): r.holder for r in locks.waits_for(t).collect()}
    want = {(d, f"w{o:06d}"): {"0x1": "h030000", "0x2": "h030001"}[a] for d, o, a in waits if a != "0x9"}
    assert edges == want
    joined = locks.held_by(locks.lock_wait(t), locks.lock_holders(t)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    # five blocks of ordinals instead of one key
    assert len(joined) >= 3 and max(r["count"] for r in joined) < 16000


def test_lock_holders_against_brute_force(spark):
    rnd = random.Random(5)
    waits = sorted({(d, rnd.randrange(40)): f"0x{rnd.randrange(3)}" for d in range(6) for _ in range(12)}.items())
    waits = [(d, o, a) for (d, o), a in waits]
    holds = [(d, 100 + i, [f"0x{i}"]) for d in range(6) for i in range(3) if rnd.random() < 0.7]
    t = lock_threads(spark, waits, holds)
    pairs = [(d, f"w{o:06d}", f"h{ho:06d}", a) for d, o, a in waits for hd, ho, aa in holds if hd == d and a in aa]
    want, every, dumps = {}, {}, {}
    for h in {p[2] for p in pairs}:
        mine = [p for p in pairs if p[2] == h]
        at = sorted({p[0] for p in mine})
        run = best = 1
        for x, y in zip(at, at[1:]):
            run = run + 1 if y == x + 1 else 1
            best = max(best, run)
        for d in at:
            dumps[h, d] = (sum(p[0] == d for p in mine), sorted({p[3] for p in mine if p[0] == d}))
        if best >= 2:
            names = sorted({p[1] for p in mine})
            want[h] = (best, len(at), len(names), names[:4])
            for n in names:
                seen = {p[0] for p in mine if p[1] == n}
                every[h, n] = (len(seen), min(seen), max(seen))
    got = {r.holder_key: (r.longest_run, r.dumps, r.starved_total, r.sample_waiters)
           for r in series.persistent_lock_holders(t, samples=4).collect()}
    assert got == want and want
    assert {(r.holder_key, r.waiter_key): (r.dumps, r.from_dump, r.to_dump) for r in series.lock_holder_waiters(t).collect()} == every
    assert {(r.holder_key, r.dump_idx): (r.waiters, r.address_list) for r in series.lock_holder_dumps(t).collect()} == dumps


def test_findings_of_one_series_are_ranked_in_ranges(eight):
    rnd = random.Random(2)
    rows = [("hot" if i % 10 else "cold", "x", rnd.randrange(3), rnd.choice([10, 30]), f"t{rnd.randrange(700)}", {"n": f"{i:06d}"})
            for i in range(6000)] + [("one", "x", 0, 10, "t", {})]
    df = eight.createDataFrame(rows, "series_id string, id string, sev_ord int, detector_ord int, title string, evidence map<string,string>")
    ranked = findings.rank_findings(df)
    assert ranked.columns == [*df.columns, "rank"]
    got = {s: [] for s in ("hot", "cold", "one")}
    for r in ranked.collect():
        got[r.series_id].append((r["rank"], (r.sev_ord, r.detector_ord, r.title, r.evidence.get("n", ""))))
    for s, have in got.items():
        want = sorted((x[2], x[3], x[4], x[5].get("n", "")) for x in rows if x[0] == s)
        assert [k for _, k in sorted(have)] == want and sorted(i for i, _ in have) == list(range(1, len(want) + 1))
    assert findings.rank_findings(df.limit(0)).count() == 0


def test_display_limits_can_be_switched_off(spark):
    occ = spark.createDataFrame([("s", d, f"k{i:04d}", "RUNNABLE", f"k{i}") for i in range(200) for d in range(2)],
                                "series_id string, dump_idx int, key string, state string, display_name string")
    for c, v in (("thread_ord", F.lit(0)), ("norm_name", F.col("display_name")), ("name", F.col("display_name"))):
        occ = occ.withColumn(c, v)
    flags = occ.select("series_id", "key", F.lit("stuck").alias("flag"), F.lit(0).alias("flag_ord")).distinct()
    assert series.flagged_timelines(occ, flags).count() == 300
    assert series.flagged_timelines(occ, flags, limit=None).count() == 400
