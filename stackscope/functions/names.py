"""Column expressions over thread names and states."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from stackscope.functions.text import full_match
from stackscope.knowledge import (
    HOUSEKEEPING_NAMES, J9_STATES, MUXER_QUEUE, POOL_RULES, THREAD_STATES,
)

STATUS_PREFIX = r"^\[(?:STUCK|ACTIVE|STANDBY|HOGGING)] "
QUEUE_NAME = (r"^(?:\[(?:STUCK|ACTIVE|STANDBY|HOGGING)] )?"
              r"ExecuteThread:? '?\d+'? for queue: '(.+?)'.*$")
CONNECTOR_NAME = r"^((?:http|https|ajp)-[\w.-]+)-exec-\d+$"
SUPPORT_NAME = r"^((?:http|https|ajp)-[\w.-]+)-(?:Poller|Acceptor|ClientPoller)(?:-\d+)?$"


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(name, STATUS_PREFIX, "")


def thread_key(tid: Column, name: Column) -> Column:
    return F.concat(F.coalesce(tid, F.lit("?")), F.lit("|"), normalized_name(name))


def is_stuck_marked(name: Column) -> Column:
    return name.contains("[STUCK]") | name.contains("[HOGGING]")


def is_housekeeping(name: Column) -> Column:
    return full_match(name, "|".join(HOUSEKEEPING_NAMES))


def group_count(pattern: str) -> int:
    """Groups of a pattern, by the expressions of the JVM that the rules run with."""
    jvm = SparkContext._active_spark_context._jvm
    return jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()


def assign_pool(name: Column, user_rules=()) -> Column:
    """Pool of a thread name, first matching rule wins; null when none matches."""
    out = None
    for base, pattern in user_rules:
        cond = full_match(name, pattern)
        value = F.lit(base)
        if group_count(pattern):
            group = F.regexp_extract(name, "^(?:" + pattern + ")$", 1)
            value = F.when(group != "", F.concat(F.lit(base + " "), group)).otherwise(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    for pattern, before, after in POOL_RULES:
        cond = full_match(name, pattern)
        value = F.lit(before) if after is None else F.concat(
            F.lit(before), F.regexp_extract(name, "^(?:" + pattern + ")$", 1), F.lit(after))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def map_state(text: Column) -> Column:
    """HotSpot state by prefix of the upper-cased text."""
    up = F.upper(F.trim(text))
    out = None
    for s in THREAD_STATES:
        cond = up.startswith(s)
        out = F.when(cond, F.lit(s)) if out is None else out.when(cond, F.lit(s))
    return out.otherwise(F.lit("UNKNOWN"))


def map_j9_state(letters: Column) -> tuple[Column, Column]:
    """(state, label) of a J9 state code."""
    state = label = None
    for code, (st, lb) in J9_STATES.items():
        c = letters == code
        state = F.when(c, F.lit(st)) if state is None else state.when(c, F.lit(st))
        label = F.when(c, F.lit(lb)) if label is None else label.when(c, F.lit(lb))
    return (state.otherwise(F.lit("UNKNOWN")),
            label.otherwise(F.concat(F.lit("UNKNOWN (J9 state "), letters, F.lit(")"))))


def _group_or_null(name: Column, pattern: str) -> Column:
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1))


def queue_of(name: Column) -> Column:
    return _group_or_null(name, QUEUE_NAME)


def connector_of(name: Column) -> Column:
    return _group_or_null(name, CONNECTOR_NAME)


def support_connector_of(name: Column) -> Column:
    return _group_or_null(name, SUPPORT_NAME)


def websphere_pool_of(name: Column) -> Column:
    return (F.when(name.rlike(r"^WebContainer : \d+$"), F.lit("WebContainer"))
            .when(name.startswith("ORB.thread.pool"), F.lit("ORB.thread.pool"))
            .when(name.startswith("SIBJMSRAThreadPool"), F.lit("SIBJMSRAThreadPool"))
            .when(name.startswith("WMQJCAResourceAdapter"), F.lit("WMQJCAResourceAdapter"))
            .when(name.startswith("SoapConnectorThreadPool"), F.lit("SoapConnectorThreadPool"))
            .when(name.startswith("server.startup :"), F.lit("server.startup"))
            .when(name.startswith("Deferrable Alarm :") | name.startswith("Non-deferrable Alarm :"),
                  F.lit("Alarm threads"))
            .when(name.startswith("TCPChannel.DCS") | name.startswith("HAManager."),
                  F.lit("HAManager/DCS")))


def worker_group(name: Column, platform: Column) -> Column:
    """Worker group shown in the middleware panel; null when the name has none."""
    queue = queue_of(name)
    return (F.when((platform == "WEBLOGIC") & queue.isNotNull(),
                   F.concat(F.lit("queue '"), queue, F.lit("'")))
            .when(platform == "TOMCAT", connector_of(name))
            .when(platform == "WEBSPHERE", websphere_pool_of(name))
            .when((platform == "LIBERTY") & name.rlike(r"^Default Executor-thread-\d+$"),
                  F.lit("Default Executor")))


def is_muxer(name: Column, frames: Column) -> Column:
    return F.coalesce(queue_of(name) == MUXER_QUEUE, F.lit(False)) | F.coalesce(
        F.exists(frames, lambda f: f["cls"].startswith("weblogic.socket.") & f["cls"].contains("Muxer")),
        F.lit(False))
