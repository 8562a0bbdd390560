import random

from dumps import dump, thread, write
from pyspark.sql import functions as F

from stackscope.streaming.ingest import dump_lines_stream, ingest_dumps_stream
from stackscope.streaming.slices import slice_samples_stream
from stackscope.streaming.trigger import threshold_trigger, threshold_trigger_stream

SCHEMA = "pid long, ts timestamp, ticks long, thread_count int"


def metrics():
    rnd = random.Random(5)
    rows = []
    for pid in (1, 2, 3):
        ticks = 0
        for i in range(60):
            ticks += rnd.randrange(0, 1100)
            rows.append((pid, 1_700_000_000 + i * 10, ticks, rnd.randrange(0, 60)))
    return rows


def expected(rows, cpu, count, cool):
    out, state = [], {}
    for pid, t, ticks, n in sorted(rows, key=lambda r: (r[0], r[1])):
        prev, until = state.get(pid, (None, None))
        hit = False
        if prev is not None:
            hit = 100.0 * ((ticks - prev[0]) / 100) / (t - prev[1]) >= cpu
        if not hit and n >= count:
            hit = True
        if hit and (until is None or t >= until):
            out.append((pid, t))
            until = t + cool
        state[pid] = ((ticks, t), until)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "pid long, t long, ticks long, thread_count int").select(
        "pid", F.timestamp_seconds("t").alias("ts"), "ticks", "thread_count")


def test_batch_trigger_matches_a_loop(spark):
    rows = metrics()
    got = threshold_trigger(frame(spark, rows), 80.0, 55, 45)
    assert sorted((r.pid, int(r.ts.timestamp())) for r in got.select(
        "pid", F.col("ts")).collect()) == sorted(expected(rows, 80.0, 55, 45))


def send(spark, tmp_path, rows, *args, **options):
    """One more micro-batch; a stream with processing-time state would run empty batches for ever, so each run is a single one."""
    src = str(tmp_path / "in")
    frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
    q = threshold_trigger_stream(spark.readStream.schema(SCHEMA).parquet(src), *args, **options).writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    assert q.awaitTermination(90)
    return spark.read.schema("pid long, ts timestamp, reason string").parquet(str(tmp_path / "out"))


def test_stream_trigger_over_any_batch_borders(spark, tmp_path):
    """Uneven batches, several rows of a process in each and in any order, equal the batch twin."""
    rows = sorted(metrics(), key=lambda r: r[1])
    for a, b in ((0, 7), (7, 95), (95, 180)):
        out = send(spark, tmp_path, random.Random(a).sample(rows[a:b], b - a), 80.0, 55, 45)
    got = sorted((r.pid, r.ts, r.reason) for r in out.collect())
    assert got == sorted((r.pid, r.ts, r.reason) for r in threshold_trigger(frame(spark, rows), 80.0, 55, 45).collect()) and got


def test_the_state_of_a_dead_process_expires(spark, tmp_path):
    import time
    assert send(spark, tmp_path, [(1, 1_700_000_000, 0, 1), (1, 1_700_000_010, 1000, 1)], 80.0, None, 0, expire_s=2).count() == 1
    time.sleep(3)
    # forgotten meanwhile: without the earlier sample the next one only primes
    assert send(spark, tmp_path, [(1, 1_700_000_020, 2000, 1)], 80.0, None, 0, expire_s=60).count() == 1
    assert send(spark, tmp_path, [(1, 1_700_000_030, 3000, 1)], 80.0, None, 0, expire_s=60).count() == 2


def test_steps_of_a_process(spark):
    """The array step against a loop over samples, with missing values and equal times."""
    import numpy as np

    from stackscope.streaming.trigger import step
    rnd = random.Random(8)
    for _ in range(60):
        n = rnd.randrange(1, 30)
        us = np.cumsum([rnd.choice([0, 1, 5]) * 1_000_000 for _ in range(n)])
        ticks = np.array([rnd.choice([np.nan, rnd.randrange(0, 900)]) for _ in range(n)])
        threads = np.array([rnd.choice([np.nan, 3, 9]) for _ in range(n)])
        want, prev, until = [], None, None
        for i in range(n):
            hit = False
            if not np.isnan(ticks[i]):
                if prev is not None and us[i] > prev[1]:
                    hit = (ticks[i] - prev[0]) / 100 / ((us[i] - prev[1]) / 1e6) * 100 >= 80
                prev = (ticks[i], us[i])
            if (hit or threads[i] >= 9) and (until is None or us[i] >= until):
                want.append(i)
                until = us[i] + 6_000_000
        cut = rnd.randrange(0, n + 1)
        state, got = (None, None, None), []
        for a, b in ((0, cut), (cut, n)):
            if b > a:
                state, fired, _ = step(state, us[a:b], ticks[a:b], threads[a:b], 80.0, 9, 6_000_000, 1)
                got += [a + int(i) for i in fired]
        assert got == want


def test_slices_close_behind_the_watermark(spark, tmp_path):
    rows = [("s", 1_700_000_000 + i, 1 + i % 2, f"t{1 + i % 2}", 9, [f"f{i}"]) for i in range(30)] + [("s", 1_700_000_900, 1, "t1", 9, ["late"])]
    df = spark.createDataFrame(rows, "series_id string, t long, thread_id long, thread_name string, os_tid long, frames array<string>") \
        .withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = slice_samples_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "10 seconds", "5 seconds") \
        .writeStream.format("memory").queryName("slices").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.thread_id, r.frames[0]) for r in spark.table("slices").collect())
    assert got == [(1, "f18"), (1, "f28"), (1, "f8"), (2, "f19"), (2, "f29"), (2, "f9")]


def test_ingest_appends_new_files(spark, tmp_path):
    src = tmp_path / "dumps"
    src.mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        q = ingest_dumps_stream(dump_lines_stream(spark, str(src)), out, cp)
        q.processAllAvailable()
        q.stop()
    blocked = [thread(f"w{i}", i + 1, state="BLOCKED", frames=("org.apache.log4j.Category.callAppenders",)) for i in range(3)]
    write(src, "a.txt", dump("2024-03-01 10:00:00", blocked))
    run()
    write(src, "b.txt", dump("2024-03-01 10:01:00", [thread("main", 1)]))
    run()
    assert spark.read.parquet(out + "/thread").count() == 4
    assert spark.read.parquet(out + "/dump").count() == 2
    assert [r.id for r in spark.read.parquet(out + "/finding").collect()] == ["sync-logging-bottleneck"]


def test_a_stuck_thread_over_three_triggers(spark, tmp_path):
    """Text, javacore and JSON files in turn: numbering and runs go on over batches, as in one batch run; replays count once."""
    import json

    from test_sources import javacore, json_doc

    from stackscope.plans.analyze import analyze
    from stackscope.sources.load import load_dumps
    from stackscope.streaming.ingest import latest_stuck
    src = tmp_path / "dumps"
    src.mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    def busy(cpu):
        return thread("http-nio-8080-exec-1", 7, frames=("com.shop.Pay.hash", "com.shop.Pay.run"), cpu=cpu, elapsed=cpu / 1000)

    def other(k):
        return thread("http-nio-8080-exec-2", 8, frames=(f"com.shop.Step{k}.go",), cpu=1.0, elapsed=1.0)

    files = [("a.txt", dump("2024-03-01 10:00:00", [busy(1000.0), other(0)])),
             ("b.txt", dump("2024-03-01 10:01:00", [busy(61000.0), other(1)])),
             ("c.txt", dump("2024-03-01 10:02:00", [busy(121000.0), other(2)])),
             ("d.txt", javacore()), ("e.json", [json.dumps(json_doc())])]

    def run():
        q = ingest_dumps_stream(dump_lines_stream(spark, str(src)), out, cp)
        q.processAllAvailable()
        q.stop()

    counts = []
    for batch in (files[:1], files[1:2], files[2:]):
        for name, lines in batch:
            write(src, name, lines)
        run()
        found = [r.id for r in spark.read.parquet(out + "/finding").collect()]
        counts.append(found.count("stuck-thread"))
    assert counts == [0, 0, 1]
    whole = load_dumps(spark, [str(src / n) for n, _ in files])
    batch = analyze(whole)
    want = batch.tables["stuck_threads"].select("key", "from_dump", "to_dump", "run_length", "kind", "severity", "why", "cpu_delta_ms", "wall_s").collect()
    got = latest_stuck(spark, out).select("key", "from_dump", "to_dump", "run_length", "kind", "severity", "why", "cpu_delta_ms", "wall_s").collect()
    assert sorted(got) == sorted(want) and len(got) == 1 and got[0].run_length == 3
    columns = [c for c in whole.dump.columns if c != "reordered"]
    assert sorted(spark.read.parquet(out + "/dump").select(*columns).collect()) == sorted(whole.dump.select(*columns).collect())
    one = [r.severity for r in spark.read.parquet(out + "/finding").filter("id = 'stuck-thread'").collect()]
    assert one == [r.severity for r in batch.findings.filter("id = 'stuck-thread'").collect()]


def test_runs_merge_in_any_order(spark):
    """Parts of a series merged one after the other, or all together, give the runs of the whole."""
    import itertools

    from stackscope.operators.series import RUN, merge_runs
    rnd = random.Random(3)
    rows, want = [], []
    for key in "abc":
        fps = [rnd.choice("xxyz") for _ in range(14)]
        at = 0
        for fp, g in itertools.groupby(fps):
            n = len(list(g))
            want.append((key, fp, at, at + n - 1, float(at), float(at + n - 1)))
            at += n
        rows += [("s", key, fp, key, i, i, i if i % 2 else None, None, float(i), float(i), None, None) for i, fp in enumerate(fps)]
    one = spark.createDataFrame(rows, RUN)

    def plain(df):
        return sorted(tuple(r) for r in df.select("key", "fp", "from_dump", "to_dump", "cpu_first", "cpu_last").collect())

    assert plain(merge_runs(one)) == sorted(want)
    parts = [merge_runs(one.filter(f"from_dump >= {a} and from_dump < {b}")) for a, b in ((0, 5), (5, 6), (6, 14))]
    left = merge_runs(merge_runs(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    right = merge_runs(parts[0].unionByName(merge_runs(parts[2].unionByName(parts[1]))))
    assert plain(left) == plain(right) == sorted(want)
    first = {(r.key, r.from_dump): r.runnable_at for r in left.collect()}
    assert first == {(k, a): next((i for i in range(a, b + 1) if i % 2), None) for k, _, a, b, _, _ in want}


def test_late_dumps_keep_their_place_of_arrival(spark):
    from stackscope.sources.tables import index_dumps
    from stackscope.sources.load import tables_of
    from stackscope.streaming.ingest import SERIES, _numbered_on
    from dumps import line_table
    lines = line_table(spark, dump("2024-03-01 10:01:00", [thread("main", 1)]), "b.txt").withColumn("input_ord", F.lit(0))
    before = spark.createDataFrame([("series", 4)], "series_id string, dumps long").withColumn(
        "last_ts", F.lit("2024-03-01 10:05:00").cast("timestamp"))
    t = _numbered_on(index_dumps(tables_of(lines)), before.select(*[c.split()[0] for c in SERIES.split(", ")]))
    assert [(r.dump_idx, r.source_name, r.reordered) for r in t.dump.collect()] == [(4, "b.txt#1", True)]
    assert [r.dump_idx for r in t.thread.collect()] == [4]
