"""J9 javacore text as Spark jobs over the line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscope.functions.frames import frame_of, frame_text, normalize_j9_frame
from stackscope.functions.names import map_j9_state
from stackscope.functions.scan import running
from stackscope.functions.text import bind, strip
from stackscope.session import store
from stackscope.sources.hotspot import place_locks
from stackscope.sources.tables import Tables, index_dumps

THREAD = r'^3XMTHREADINFO\s+"(.*)"\s+(.*)$'
JAVA_THREAD = r"^3XMJAVALTHREAD\s+\(java/lang/Thread getId:0x([0-9a-fA-F]+), isDaemon:(true|false)\)"
NATIVE_ID = r"native thread ID:(0x[0-9a-fA-F]+|\d+)"
CPU = r"^3XMCPUTIME\s+.*?CPU usage total:\s*([\d.]+)\s*secs"
STACK = r"^4XESTACKTRACE\s+(at\s+.*)$"
ENTERED = (r"^5XESTACKTRACE\s+\(entered lock:\s*([^,@]+)@(0x[0-9a-fA-F]+)"
           r"(?:/[0-9a-fA-Fx]+)?,\s*entry count:\s*\d+\)")
BLOCK = (r"^3XMTHREADBLOCK\s+(Blocked|Waiting|Parked)\s+on:\s*(<unknown>|[^@\s]+@0x[0-9a-fA-F]+)"
         r'(?:\s+Owned by:\s*("[^"]*"|<unowned>|<unknown>).*)?$')
MONITOR = r"^3LKMONOBJECT\s+([^@\s]+)@(0x[0-9a-fA-F]+)(?:/[0-9a-fA-Fx]+)?:\s*(.*)$"
OWNER = r'(?:owner|Flat locked by)\s+"([^"]*)"'
WAITER = r'^3LK(WAITER|WAITNOTIFY)\s+"([^"]*)".*$'
CYCLE_THREAD = r'^2LKDEADLOCKTHR\s+Thread\s+"([^"]*)".*$'
DATE = r"^1TIDATETIME(UTC)?\s+Date:\s*(\d{4}/\d{2}/\d{2}) at (\d{2}:\d{2}:\d{2})(?::(\d{1,3}))?.*$"
KEY = ["series_id", "file"]


def _get(line: Column, pattern: str, group: int = 1) -> Column:
    v = F.regexp_extract(line, pattern, group)
    return F.when(v != "", v)


def _cls(c: Column) -> Column:
    return F.translate(strip(c), "/", ".")


def tag_lines(lines: DataFrame) -> DataFrame:
    """Tagged lines with their thread, monitor and deadlock-report ordinals; stored, as every table reads them."""
    df = lines.filter((F.col("line") != "") & ~F.col("line").startswith("NULL"))
    df = df.withColumn("tag", F.regexp_extract("line", r"^(\S*)", 1)) \
           .withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    tag = F.col("tag")
    monitor = F.when((tag == "3LKMONOBJECT") & F.col("line").rlike(MONITOR), F.struct(
        F.lower(_get(F.col("line"), MONITOR, 2)).alias("address"),
        _cls(_get(F.col("line"), MONITOR, 1)).alias("cls"))) \
        .when(tag.isin("3LKMONOBJECT", "2LKMONINUSE"), F.struct(
            F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("cls")))
    return store(running(
        df, KEY, "chunk", ["pos"],
        last={
            "monitor": monitor,
            "in_stack": F.when(tag == "3XMTHREADINFO", 0).when(
                tag == "3XMTHREADINFO3", F.col("line").contains("Java callstack").cast("int")),
        },
        total={
            "thread_no": F.when(tag == "3XMTHREADINFO", 1).otherwise(0),
            "cycle_no": F.when(tag == "1LKDEADLOCK", 1).otherwise(0),
        }))


def javacore_tables(tagged: DataFrame) -> Tables:
    line, tag, at = F.col("line"), F.col("tag"), F.struct("chunk", "pos")
    keys = [*KEY, "dump_no"]
    df = tagged.withColumn("dump_no", F.lit(1).cast("long"))

    def ref(kind, address, cls):
        return F.struct(kind.alias("kind"), address.alias("address"), cls.alias("cls"))

    obj = _get(line, BLOCK, 2)
    verb = F.regexp_extract(line, BLOCK, 1)
    block = F.when((tag == "3XMTHREADBLOCK") & obj.contains("@"), ref(
        F.when(verb == "Blocked", "WAITING_TO_LOCK").when(verb == "Parked", "PARKING_TO_WAIT_FOR")
        .otherwise("WAITING_ON"),
        F.lower(F.substring_index(obj, "@", -1)), _cls(F.substring_index(obj, "@", 1))))
    text = strip(line)
    entered = F.when((tag == "5XESTACKTRACE") & (F.col("in_stack") == 1) & text.rlike(ENTERED), ref(
        F.lit("LOCKED_MONITOR"), F.lower(_get(text, ENTERED, 2)), _cls(_get(text, ENTERED, 1))))
    own_ref = F.coalesce(block, entered)
    frame = F.when((tag == "4XESTACKTRACE") & (F.col("in_stack") == 1) & line.rlike(STACK),
                   bind(normalize_j9_frame(F.regexp_extract(line, STACK, 1)), frame_text))

    lines = df.filter(F.col("thread_no") > 0).withColumn("_frame", frame).withColumn("_ref", own_ref)
    raw = lines.groupBy(*keys, "thread_no").agg(
        F.max(F.when(tag == "3XMTHREADINFO", line)).alias("_head"),
        F.max(F.when(tag == "3XMJAVALTHREAD", line)).alias("_java"),
        F.max_by(_get(line, NATIVE_ID), F.when((tag == "3XMTHREADINFO1") & line.rlike(NATIVE_ID), at)).alias("_nid"),
        F.max_by(_get(line, CPU), F.when((tag == "3XMCPUTIME") & line.rlike(CPU), at)).alias("_cpu"),
        F.array_sort(F.collect_list(F.when(F.col("_frame").isNotNull(), F.struct(
            at.alias("at"), F.col("_frame").alias("frame"))))).alias("_frames"),
        F.array_sort(F.collect_list(F.when(F.col("_ref").isNotNull(), F.struct(
            at.alias("at"), F.col("_ref").alias("ref"))))).alias("_locks"),
    ).filter(F.col("_head").rlike(THREAD))
    attrs = F.regexp_extract("_head", THREAD, 2)
    letters = _get(attrs, r"state:([A-Z]+)")
    state, label = map_j9_state(letters)
    nid = F.col("_nid")
    dec = F.when(nid.startswith("0x"), F.conv(F.substring(nid, 3, 18), 16, 10).cast("long")) \
        .otherwise(nid.cast("long"))
    # blocks that precede any frame carry no position
    locks = F.transform(place_locks(F.col("_frames"), F.col("_locks")), lambda l: F.struct(
        l["kind"].alias("kind"), l["address"].alias("address"), l["cls"].alias("cls"),
        F.when(l["kind"] == "LOCKED_MONITOR", l["frame_idx"]).otherwise(F.lit(-1)).alias("frame_idx")))
    thread = raw.select(
        *keys, F.col("thread_no").alias("thread_ord"),
        F.regexp_extract("_head", THREAD, 1).alias("name"),
        F.conv(_get(F.col("_java"), JAVA_THREAD, 1), 16, 10).cast("long").alias("java_id"),
        F.coalesce(_get(F.col("_java"), JAVA_THREAD, 2) == "true", F.lit(False)).alias("daemon"),
        _get(attrs, r"prio=(\d+)").cast("int").alias("prio"),
        (F.col("_cpu").try_cast("double") * 1000.0).alias("cpu_ms"),
        F.lower(_get(attrs, r"J9VMThread:(0x[0-9a-fA-F]+)")).alias("tid_hex"),
        F.when(dec.isNotNull(), F.concat(F.lit("0x"), F.lower(F.hex(dec)))).alias("nid_hex"),
        F.coalesce(dec, F.lit(-1).cast("long")).alias("nid_dec"),
        F.when(letters.isNull(), "UNKNOWN").otherwise(state).alias("state"),
        F.when(letters.isNull(), "").otherwise(label).alias("state_detail"),
        F.lit("").alias("header_cond"), F.lit(False).alias("is_virtual"),
        F.transform("_frames", lambda f: frame_of(f["frame"])).alias("frames"),
        locks.alias("locks"))
    # read four times below, mostly by its names: stored, as grouping the lines anew would parse every frame again
    thread = _merge_monitors(df, store(thread), own_ref, keys)
    return Tables(*_dump_level(df, thread, keys))


def _merge_monitors(df: DataFrame, thread: DataFrame, own_ref: Column, keys: list[str]) -> DataFrame:
    """Add ownership and queues of the LOCKS section to the threads they name."""
    line, tag, at = F.col("line"), F.col("tag"), F.struct("chunk", "pos")
    first = thread.groupBy(*keys, "name").agg(F.min("thread_ord").alias("thread_ord"))
    name_of = thread.select(*keys, F.col("thread_ord").alias("thread_no"), "name")

    mon = df.filter(tag == "3LKMONOBJECT").filter(F.col("monitor.address").isNotNull())
    pool_owner = mon.select(
        *keys, F.lit(0).alias("rank"), at.alias("at"), F.col("monitor.address").alias("address"),
        _get(F.regexp_extract(line, MONITOR, 3), OWNER).alias("name"))
    # within the LOCKS section the last line wins, later mentions only fill gaps
    pool_owner = pool_owner.filter("name IS NOT NULL").groupBy(*keys, "address").agg(
        F.max_by("name", "at").alias("name")).withColumn("rank", F.lit(0))
    said = _get(line, BLOCK, 3)
    mention = df.filter(tag == "3XMTHREADBLOCK").filter(said.startswith('"')).select(
        *keys, at.alias("at"), own_ref["address"].alias("address"),
        F.regexp_extract(said, '^"([^"]*)"$', 1).alias("name"))
    entered = df.filter((tag == "5XESTACKTRACE") & own_ref.isNotNull()).select(
        *keys, "thread_no", at.alias("at"), own_ref["address"].alias("address")) \
        .join(name_of, [*keys, "thread_no"]).drop("thread_no")
    later = mention.filter("address IS NOT NULL").unionByName(entered) \
        .groupBy(*keys, "address").agg(F.min_by("name", "at").alias("name")) \
        .withColumn("rank", F.lit(1))
    owner = pool_owner.unionByName(later).groupBy(*keys, "address").agg(F.min_by("name", "rank").alias("name")) \
        .withColumn("kind", F.lit("LOCKED_MONITOR"))
    queued = df.filter(tag.isin("3LKWAITER", "3LKWAITNOTIFY") & line.rlike(WAITER)) \
        .filter(F.col("monitor.address").isNotNull()).select(
            *keys, F.col("monitor.address").alias("address"), F.regexp_extract(line, WAITER, 2).alias("name"),
            F.when(F.regexp_extract(line, WAITER, 1) == "WAITER", "WAITING_TO_LOCK")
            .otherwise("WAITING_ON").alias("kind")).distinct()
    # the pool section names a class last; block and entered lines only fill gaps
    cls = mon.select(*keys, F.col("monitor.address").alias("address"), F.col("monitor.cls").alias("cls"),
                     at.alias("at")).groupBy(*keys, "address").agg(F.max_by("cls", "at").alias("cls")) \
        .withColumn("rank", F.lit(0)).unionByName(
            df.filter(own_ref.isNotNull()).select(
                *keys, own_ref["address"].alias("address"), own_ref["cls"].alias("cls"), at.alias("at"))
            .groupBy(*keys, "address").agg(F.min_by("cls", "at").alias("cls")).withColumn("rank", F.lit(1))) \
        .groupBy(*keys, "address").agg(F.min_by("cls", "rank").alias("cls"))
    facts = (owner.unionByName(queued).join(cls, [*keys, "address"], "left")
             .join(first, [*keys, "name"]))
    have = thread.select(*keys, "thread_ord", F.explode("locks").alias("l")).select(
        *keys, "thread_ord", F.col("l.kind").alias("kind"), F.col("l.address").alias("address")).distinct()
    added = facts.join(have, [*keys, "thread_ord", "kind", "address"], "left_anti") \
        .groupBy(*keys, "thread_ord").agg(F.array_sort(F.collect_list(F.struct(
            F.when(F.col("kind") == "LOCKED_MONITOR", 0).otherwise(1).alias("o"),
            "address", "kind", "cls"))).alias("_extra"))
    extra = F.transform(F.coalesce("_extra", F.array()), lambda x: F.struct(
        x["kind"].alias("kind"), x["address"].alias("address"), x["cls"].alias("cls"),
        F.lit(-1).alias("frame_idx")))
    return thread.join(added, [*keys, "thread_ord"], "left") \
        .withColumn("locks", F.when(F.col("_extra").isNull(), F.col("locks"))
                    .otherwise(F.concat("locks", extra))).drop("_extra")


def _dump_level(df: DataFrame, thread: DataFrame, keys: list[str]):
    line, tag, at = F.col("line"), F.col("tag"), F.struct("chunk", "pos")
    rest = F.trim(F.substr(line, F.length(tag) + 1))
    stamp = F.try_to_timestamp(
        F.concat(_get(line, DATE, 2), F.lit(" "), _get(line, DATE, 3)), F.lit("yyyy/MM/dd HH:mm:ss"))
    stamp = F.timestamp_micros(
        F.unix_micros(stamp) + F.coalesce(_get(line, DATE, 4).cast("long"), F.lit(0)) * 1000)
    utc = F.regexp_extract(line, DATE, 1) == "UTC"
    noise = ~line.rlike(r"^\d[A-Z]{2,}") & (strip(line) != "")
    dump = df.groupBy(*keys).agg(
        F.first("source_name", ignorenulls=True).alias("source_name"),
        (F.min("input_ord") if "input_ord" in df.columns else F.lit(0)).alias("input_ord"),
        F.max_by(stamp, F.when(utc & stamp.isNotNull(), at)).alias("_utc"),
        F.min_by(stamp, F.when(~utc & stamp.isNotNull(), at)).alias("_local"),
        F.max_by(rest, F.when(tag == "1TISIGINFO", at)).alias("dump_reason"),
        F.max_by(rest, F.when(tag == "1CIJAVAVERSION", at)).alias("_version"),
        F.min_by(rest, F.when((tag == "2XMFULLTHDDUMP") & (rest != ""), at)).alias("_banner"),
        F.bool_or(tag.isin("1LKMONPOOLDUMP", "1LKPOOLINFO")).alias("saw_sync"),
        F.bool_or(tag.isin("1XMCURTHDINFO", "1XMTHDINFO")).alias("_threads"),
        F.count(F.when(noise, 1)).alias("_noise"),
        F.min_by(F.substring(strip(line), 1, 120), F.when(noise, at)).alias("_noise_text"))
    dump = dump.withColumn("ts", F.coalesce("_utc", "_local")).withColumn(
        "banner", F.coalesce("_banner", F.concat(
            F.lit("IBM J9/OpenJ9 javacore"),
            F.coalesce(F.concat(F.lit(" - "), F.col("_version")), F.lit("")))))
    has = thread.select(*keys).distinct().withColumn("_has", F.lit(True))
    msgs = dump.join(has, keys, "left").select(*keys, F.explode(F.array_compact(F.array(
        F.when(F.col("dump_reason").isNotNull(),
               F.concat(F.lit("trigger of the dump: "), F.col("dump_reason"))),
        F.when(~F.col("_threads") & F.col("_has").isNull(), F.lit("the file lists no threads")),
        F.when(F.col("_noise") > 0, F.concat(
            F.col("_noise").cast("string"), F.lit(' line(s) fit no known form, the first being ("'),
            F.col("_noise_text"), F.lit('")')))))).alias("message"))
    names = df.filter((tag == "2LKDEADLOCKTHR") & (F.col("cycle_no") > 0) & line.rlike(CYCLE_THREAD)).select(
        *keys, "cycle_no", F.regexp_extract(line, CYCLE_THREAD, 1).alias("thread_name"), at.alias("at")) \
        .groupBy(*keys, "cycle_no", "thread_name").agg(F.min("at").alias("at"))
    w = Window.partitionBy(*keys, "cycle_no")
    cycle = names.withColumn("_n", F.count("*").over(w)).filter("_n >= 2").select(
        *keys, "cycle_no", F.row_number().over(w.orderBy("at")).cast("long").alias("pos"), "thread_name")
    return (dump.select(*keys, "input_ord", "ts", "banner", "source_name", "saw_sync", "dump_reason"),
            thread, cycle, msgs)


def parse_javacore(lines: DataFrame) -> Tables:
    return index_dumps(javacore_tables(tag_lines(lines)))
