"""Sizes by which Spark plans joins and tasks, where files or rows are much smaller than what is made of them."""

import datetime

import pytest
from pyspark.sql import functions as F

from stackscope.plans.snapshots import dump_text, event_tables
from stackscope.session import configure, store

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


@pytest.mark.parametrize("named, kept", [("10485760b", "1048576"), ("10MB", "1048576"), ("1g", "1048576"), ("256k", "256k"), ("-1", "-1")])
def test_broadcast_limit_is_only_lowered(spark, named, kept):
    spark.conf.set(LIMIT, named)
    assert configure(spark).conf.get(LIMIT) == kept


def test_tables_in_small_files_are_not_broadcast(spark):
    spark.conf.set(LIMIT, "10485760b")
    configure(spark)
    t = store(spark.range(100000).select(F.md5(F.col("id").cast("string")).alias("key"), F.col("id").alias("at")))
    runs = t.groupBy("key").agg(F.max("at").alias("at"))
    plan = t.join(runs, ["key", "at"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_threads_of_events_are_made_in_many_tasks(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(days=i % 5, seconds=i), i % 97, ("click", "error", "view")[i % 3], float(i % 50)) for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double") \
        .write.parquet(str(tmp_path / "events.parquet"))
    configure(spark)
    t = event_tables(spark, str(tmp_path))
    for df in (t.thread, dump_text(t)):
        per = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per) >= 8 and max(per) < sum(per) / 3
    assert t.thread.count() == len({(i % 5, i % 97) for i in range(2000)})
