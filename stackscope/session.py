"""Session settings, and the two ways of storing an intermediate result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: tables whose files are larger are never sent through the driver to every task by Spark's own choice
BROADCAST = 1 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Per-session settings the operators rely on (timestamps are read as UTC)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # threads are grouped with a few KB each; the default of 128 groups sorts far too early
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "8192")
    # sides of joins are judged by file sizes; stored stacks and names are 25 times as large and more in the driver's memory
    if _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) > BROADCAST:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST))
    return spark


def _bytes(size: str) -> int:
    """Bytes of a size setting such as 10485760b, 256k or -1."""
    number, unit = size.strip().lower().removesuffix("b"), 1
    if number[-1:] in "kmgt":
        number, unit = number[:-1], 1024 ** ("kmgt".index(number[-1]) + 1)
    return int(number) * unit


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    A local folder is made only where nothing is set (tests, local mode).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="stackscope-ckpt-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for the narrow tables of a loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Written Parquet table, for wide tables read many times with few columns each."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
