"""Event and document tables read as snapshot data.

A user is a thread, a day is a dump, the last event of a user on a day is what the
thread was doing. Everything is derived from the rows by columns, so the snapshot
grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackscope import schema
from stackscope.sources.series import order_series
from stackscope.sources.tables import Tables, conform

#: fixed mapping of event types to thread states
STATE_OF = {"click": "RUNNABLE", "purchase": "RUNNABLE", "error": "BLOCKED",
            "view": "WAITING", "signup": "TIMED_WAITING"}
#: fixed frames per event type; {v} is the user's variant
FRAMES_OF = {
    "click": ("java.net.SocketInputStream.socketRead0", "com.shop.web.Page{v}.render",
              "java.lang.Thread.run"),
    "purchase": ("com.shop.cart.Checkout{v}.pay", "com.shop.web.Dispatcher.dispatch",
                 "java.lang.Thread.run"),
    "error": ("org.apache.log4j.Category.callAppenders", "com.shop.audit.Trail{v}.write",
              "java.lang.Thread.run"),
    "view": ("java.util.concurrent.LinkedBlockingQueue.take",
             "java.util.concurrent.ThreadPoolExecutor.getTask", "java.lang.Thread.run"),
    "signup": ("com.zaxxer.hikari.util.ConcurrentBag.borrow", "com.shop.user.Signup{v}.store",
               "java.lang.Thread.run"),
}
NATIVE = "java.net.SocketInputStream.socketRead0"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    # times without a zone are taken as UTC, the session's zone
    return df.select(*[F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n)
                       for n, t in df.dtypes])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows that become many times as wide further on, dealt by keys to four tasks a core.

    A number given here is kept: by the size of the narrow rows, adaptive execution would merge them into one task or a few.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _frames(event: Column, variant: Column) -> Column:
    out = None
    for et, sigs in FRAMES_OF.items():
        arr = []
        for s in sigs:
            head, _, method = s.rpartition(".")
            cls = F.lit(head) if "{v}" not in head else F.concat(
                F.lit(head.split("{v}")[0]), variant, F.lit(head.split("{v}")[1]))
            loc = "Native Method" if s == NATIVE else method + ".java:1"
            arr.append(F.struct(
                F.concat(cls, F.lit(f".{method}({loc})")).alias("raw"), cls.alias("cls"),
                F.lit(method).alias("method"), F.lit(loc).alias("loc"),
                F.concat(cls, F.lit(f".{method}")).alias("sig"), F.lit(s == NATIVE).alias("native")))
        out = F.when(event == et, F.array(*arr)) if out is None else out.when(event == et, F.array(*arr))
    return out


def _lock(kind: str, address: Column, cls: Column, frame: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), address.alias("address"), cls.alias("cls"),
                    F.lit(frame).alias("frame_idx"))


def ledger(n: Column) -> tuple[Column, Column]:
    """(address, class) of one of the eight shared locks."""
    slot = (n % 8).cast("string")
    return F.concat(F.lit("0x00000000e000000"), slot), F.concat(F.lit("com.shop.Ledger"), slot)


def event_tables(spark: SparkSession, sf_dir: str, by_node: bool = False) -> Tables:
    """Canonical tables of the events; by_node splits the users into ten nodes."""
    ev = read(spark, sf_dir, "events")
    u = F.col("user_id")
    series = F.concat(F.lit("n"), (u % 10).cast("string")) if by_node else F.lit("all")
    one = ev.select(
        series.alias("series_id"), F.to_date("ts").alias("day"), "user_id",
        F.struct("ts", "event_id").alias("_at"), "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents")) \
        .groupBy("series_id", "day", "user_id").agg(
            F.max_by("event_type", "_at").alias("event_type"), F.max_by("cents", "_at").alias("cents"))
    days = order_series(one.select("series_id", "day").distinct().withColumn(
        "ts", F.col("day").cast("timestamp")), ["day"])
    dump = days.withColumn("banner", F.concat(F.lit("Full thread dump of "), F.col("series_id"))) \
        .withColumn("source_name", F.concat(F.lit("day-"), F.col("day").cast("string"))) \
        .withColumn("saw_sync", F.lit(False))
    # one narrow row per day and user: a window over a user is at most the days of the series
    w = Window.partitionBy("series_id", "user_id").orderBy("day")
    et = F.col("event_type")
    n = u.cast("string")
    status = (F.when(et == "error", "[STUCK] ").when(et == "purchase", "[HOGGING] ")
              .when(et == "signup", "[STANDBY] ").otherwise("[ACTIVE] "))
    name = (F.when(u % 4 == 0, F.concat(F.lit("http-nio-8080-exec-"), n))
            .when(u % 4 == 1, F.concat(F.lit("pool-7-thread-"), n))
            .when(u % 4 == 2, F.concat(status, F.lit("ExecuteThread: '"), n, F.lit("' for queue: 'q'")))
            .otherwise(F.concat(F.lit("WebContainer : "), n)))
    state = None
    for k, s in STATE_OF.items():
        state = F.when(et == k, F.lit(s)) if state is None else state.when(et == k, F.lit(s))
    mine, mine_cls = ledger(u)
    other, other_cls = ledger(u + 3)
    own = F.concat(F.lit("0x00000000f"), F.lpad(n, 7, "0"))
    none = F.array().cast(T.ArrayType(schema.LOCK))
    locks = (F.when((et == "error") & (u % 5 == 0), F.array(
                _lock("WAITING_TO_LOCK", mine, mine_cls, 0), _lock("LOCKED_MONITOR", other, other_cls, 1)))
             .when(et == "error", F.array(_lock("WAITING_TO_LOCK", mine, mine_cls, 0)))
             .when(et == "purchase", F.array(_lock("LOCKED_MONITOR", mine, mine_cls, 0)))
             .when(et == "view", F.array(_lock("WAITING_ON", own, F.lit("java.lang.Object"), 0),
                                         _lock("LOCKED_MONITOR", own, F.lit("java.lang.Object"), 1)))
             .otherwise(none))
    skew = F.when(F.lit(by_node) & (u % 2 == 1), 1.5).otherwise(1.0)
    placed = one.withColumn("cpu_ms", (F.sum("cents").over(w) * 10000).cast("double")) \
        .join(days.select("series_id", "day", "dump_idx"), ["series_id", "day"])
    thread = spread(placed, "dump_idx", "user_id").select(
        "series_id", "dump_idx", u.alias("thread_ord"), name.alias("name"), u.alias("java_id"),
        (u % 2 == 0).alias("daemon"), (u % 3 + 4).cast("int").alias("prio"), F.lit(0).alias("os_prio"),
        "cpu_ms", (F.datediff("day", F.lit("2024-01-01").cast("date")) * 86400.0 * skew + u).alias("elapsed_s"),
        F.concat(F.lit("0x"), F.lower(F.hex(u + 4096))).alias("tid_hex"),
        F.concat(F.lit("0x"), F.lower(F.hex(u + 1))).alias("nid_hex"), (u + 1).alias("nid_dec"),
        state.alias("state"), F.lit("").alias("state_detail"), F.lit("waiting on condition").alias("header_cond"),
        F.lit(False).alias("is_virtual"), F.lit(None).cast("string").alias("carrier_tid"),
        _frames(et, (u % 3).cast("string")).alias("frames"), locks.alias("locks"))
    return Tables(conform(dump, schema.DUMP), conform(thread, schema.THREAD),
                  spark.createDataFrame([], schema.JVM_CYCLE), spark.createDataFrame([], schema.PARSE_ISSUE))


def error_pauses(spark: SparkSession, sf_dir: str, by_node: bool = False) -> DataFrame:
    """Error events as stop-the-world windows of ``value`` minutes."""
    u = F.col("user_id")
    series = F.concat(F.lit("n"), (u % 10).cast("string")) if by_node else F.lit("all")
    return read(spark, sf_dir, "events").filter("event_type = 'error'").select(
        series.alias("series_id"), F.col("ts").alias("start_ts"),
        (F.round(F.col("value") * 100).cast("long") * 600).cast("double").alias("duration_ms"),
        F.concat(F.lit("cause "), (u % 3).cast("string")).alias("cause"), F.lit("gc").alias("kind"))


def dump_text(t: Tables) -> DataFrame:
    """The thread table printed as HotSpot text, one line table for all dumps of a series."""
    d = t.dump.select("series_id", "dump_idx", "ts", "banner")
    base = F.col("dump_idx").cast("long") * F.lit(1 << 40)
    head = d.select("series_id", base.alias("pos"), F.explode(F.array(
        F.struct(F.lit(0).alias("i"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("line")),
        F.struct(F.lit(1).alias("i"), F.col("banner").alias("line")),
        F.struct(F.lit(2).alias("i"), F.lit("").alias("line")))).alias("l")) \
        .select("series_id", (F.col("pos") + F.col("l.i")).alias("pos"), "l.line")

    def lock_line(l):
        verb = (F.when(l["kind"] == "LOCKED_MONITOR", "locked").when(l["kind"] == "WAITING_TO_LOCK", "waiting to lock")
                .otherwise("waiting on"))
        return F.concat(F.lit("\t- "), verb, F.lit(" <"), l["address"], F.lit("> (a "), l["cls"], F.lit(")"))

    header = F.concat(
        F.lit('"'), F.col("name"), F.lit('" #'), F.col("java_id").cast("string"),
        F.when(F.col("daemon"), " daemon").otherwise(""), F.lit(" prio="), F.col("prio").cast("string"),
        F.lit(" os_prio="), F.col("os_prio").cast("string"), F.lit(" cpu="),
        F.col("cpu_ms").cast("decimal(20,2)").cast("string"), F.lit("ms elapsed="),
        F.col("elapsed_s").cast("decimal(20,2)").cast("string"), F.lit("s tid="), F.col("tid_hex"),
        F.lit(" nid="), F.col("nid_hex"), F.lit(" "), F.col("header_cond"), F.lit("  [0x00007f0000000000]"))
    body = F.flatten(F.transform("frames", lambda f, i: F.concat(
        F.array(F.concat(F.lit("\tat "), f["raw"])),
        F.transform(F.filter("locks", lambda l: l["frame_idx"] == i), lock_line))))
    lines = F.concat(
        F.array(header, F.concat(F.lit("   java.lang.Thread.State: "), F.col("state"))), body,
        F.array(F.lit("")))
    rows = t.thread.select("series_id", (F.col("dump_idx").cast("long") * F.lit(1 << 40)
                                         + (F.col("thread_ord") + 1) * 64).alias("_p"),
                           F.posexplode(lines)).select(
        "series_id", (F.col("_p") + F.col("pos")).alias("pos"), F.col("col").alias("line"))
    return head.unionByName(rows).select(
        "series_id", F.lit(None).cast("string").alias("node"), F.lit("events.log").alias("file"),
        F.lit("events.log").alias("source_name"),
        # chunks of about 16 dumps' worth of a thousand threads each
        F.shiftright("pos", 16).alias("chunk"), "pos", "line")
