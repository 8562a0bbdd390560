"""Bundled knowledge bases.

Fixed values: the patterns, labels, thresholds and prefixes below decide which
rows match, so they have to stay exactly as they are. Sites extend them through
``stackscope.sources.kb``; nothing here is edited per site.
"""

from __future__ import annotations

from dataclasses import dataclass

THREAD_STATES = [
    "NEW", "RUNNABLE", "BLOCKED", "WAITING", "TIMED_WAITING", "TERMINATED", "UNKNOWN",
]

HOLD_KINDS = ["LOCKED_MONITOR", "LOCKED_SYNCHRONIZER"]
WAIT_KINDS = ["WAITING_TO_LOCK", "WAITING_ON", "PARKING_TO_WAIT_FOR"]


@dataclass(frozen=True)
class LabelEntry:
    """A named group of frame substrings and what a hit means."""

    name: str
    label: str
    frames: tuple[str, ...]
    category: str | None = None


@dataclass(frozen=True)
class RuleEntry:
    rule_id: str
    title: str
    severity: str
    recommendation: str
    frames: tuple[str, ...] = ()
    name_regex: str | None = None
    states: tuple[str, ...] = ()
    min_threads: int = 1
    warn_threads: int | None = None
    critical_threads: int | None = None
    persist_dumps: int | None = None
    cpu_delta: str | None = None


#: how many top frames the idle and the meaning lookups read
IDLE_TOP_FRAMES = 8
MEANING_TOP_FRAMES = 10

IDLE_PATTERNS = (
    LabelEntry("socket-accept", "idle (acceptor/await loop)", (
        "sun.nio.ch.Net.accept",
        "sun.nio.ch.NioSocketImpl.accept",
        "java.net.PlainSocketImpl.socketAccept",
        "java.net.AbstractPlainSocketImpl.accept",
        "java.net.ServerSocket.accept",
    )),
    LabelEntry("selector-wait", "idle (selector/poller wait)", (
        "sun.nio.ch.EPoll.wait",
        "sun.nio.ch.EPollArrayWrapper.epollWait",
        "sun.nio.ch.EPollSelectorImpl.doSelect",
        "sun.nio.ch.KQueue.poll",
        "sun.nio.ch.WEPoll.wait",
        "sun.nio.ch.Net.poll",
        "sun.nio.ch.WindowsSelectorImpl$SubSelector.poll0",
        "io.netty.channel.epoll.Native.epollWait",
    )),
    LabelEntry("reference-processing", "idle (reference processing)", (
        "java.lang.ref.Reference.waitForReferencePendingList",
        "jdk.internal.ref.CleanerImpl.run",
    )),
    LabelEntry("executor-idle", "idle (waiting for work)", (
        "java.util.concurrent.ThreadPoolExecutor.getTask",
        "java.util.concurrent.ScheduledThreadPoolExecutor$DelayedWorkQueue.take",
        "java.util.concurrent.LinkedBlockingQueue.take",
        "java.util.concurrent.LinkedBlockingQueue.poll",
        "java.util.concurrent.LinkedBlockingDeque.takeFirst",
        "java.util.concurrent.ForkJoinPool.awaitWork",
        "java.util.concurrent.ForkJoinPool.scan",
        "java.util.concurrent.DelayQueue.take",
    )),
    LabelEntry("object-wait-idle", "idle (timer/queue wait)", (
        "java.util.TimerThread.mainLoop",
        "java.lang.ref.ReferenceQueue.remove",
    )),
    LabelEntry("container-idle", "idle (container idle loop)", (
        "org.apache.catalina.core.StandardServer.await",
        "org.apache.tomcat.util.net.NioEndpoint$Poller.run",
        "org.apache.tomcat.util.net.Acceptor.run",
        "org.apache.tomcat.util.threads.TaskQueue.take",
        "org.apache.tomcat.util.net.NioBlockingSelector$BlockPoller.run",
        "org.apache.tomcat.util.net.AprEndpoint$Poller.run",
        "weblogic.work.ExecuteThread.waitForRequest",
        "weblogic.socket.PosixSocketMuxer.processSockets",
        "weblogic.socket.EPollSocketMuxer.processSockets",
        "weblogic.socket.SocketMuxer.processSockets",
        "weblogic.socket.NIOSocketMuxer.processSockets",
        "com.ibm.ws.util.BoundedBuffer.waitGet_",
        "com.ibm.ws.threading.internal.BoundedBuffer.take",
        "com.ibm.ejs.util.am.AlarmManagerThread.run",
        "io.undertow.server.protocol.framed.FrameHandler.run",
    )),
)

FRAME_MEANINGS = (
    LabelEntry("oracle-jdbc-read", "waiting on an Oracle JDBC response", (
        "oracle.jdbc.driver", "oracle.net.ns.", "T4CPreparedStatement", "T4CStatement",
    ), "db-wait"),
    LabelEntry("generic-jdbc", "executing a JDBC statement", (
        "com.mysql.cj.jdbc", "org.postgresql.core", "com.microsoft.sqlserver.jdbc",
    ), "db-wait"),
    LabelEntry("hikari-borrow", "waiting to borrow a connection from HikariCP", (
        "com.zaxxer.hikari.util.ConcurrentBag.borrow",
        "com.zaxxer.hikari.pool.HikariPool.getConnection",
    ), "db-pool-wait"),
    LabelEntry("ucp-borrow", "waiting to borrow a connection from Oracle UCP", (
        "oracle.ucp.jdbc.PoolDataSourceImpl.getConnection",
        "oracle.ucp.common.UniversalConnectionPoolBase.borrowConnection",
    ), "db-pool-wait"),
    LabelEntry("weblogic-jdbc-reserve", "waiting for a WebLogic JDBC connection", (
        "weblogic.jdbc.common.internal.ConnectionPool.reserve",
        "weblogic.common.resourcepool.ResourcePoolImpl.reserveResource",
    ), "db-pool-wait"),
    LabelEntry("websphere-j2c-reserve", "waiting for a WebSphere JCA/JDBC connection", (
        "com.ibm.ws.j2c.poolmanager.FreePool.createOrWaitForConnection",
        "com.ibm.ejs.j2c.FreePool.createOrWaitForConnection",
        "com.ibm.ejs.j2c.PoolManager.reserve",
    ), "db-pool-wait"),
    LabelEntry("weblogic-jta", "inside WebLogic JTA transaction processing", (
        "weblogic.transaction.internal.",
    ), "db-wait"),
    LabelEntry("weblogic-t3-call", "waiting on a t3/RMI response from another WebLogic server", (
        "weblogic.rjvm.ResponseImpl.waitForData",
        "weblogic.rmi.internal.BasicOutboundRequest.sendReceive",
    ), "ws-call"),
    LabelEntry("tomcat-jsp-compile", "compiling a JSP", (
        "org.apache.jasper.compiler.",
    ), "file-io"),
    LabelEntry("ibm-mq", "waiting on an IBM MQ operation", (
        "com.ibm.mq.", "com.ibm.msg.client",
    ), "mq-wait"),
    LabelEntry("kafka-poll", "polling Kafka for records", (
        "org.apache.kafka.clients.consumer.KafkaConsumer.poll",
        "org.apache.kafka.common.network.Selector.poll",
    ), "kafka"),
    LabelEntry("redis-client", "waiting on a Redis response", (
        "redis.clients.jedis", "io.lettuce.core.protocol",
    ), "cache-wait"),
    LabelEntry("apache-httpclient", "waiting on an HTTP response (Apache HttpClient)", (
        "org.apache.http.impl.conn",
        "org.apache.http.impl.io.SessionInputBufferImpl",
        "org.apache.hc.client5",
    ), "http-wait"),
    LabelEntry("okhttp", "waiting on an HTTP response (OkHttp)", (
        "okhttp3.internal", "okio.Okio",
    ), "http-wait"),
    LabelEntry("jdk-httpclient", "waiting on an HTTP response (java.net.http)", (
        "jdk.internal.net.http",
    ), "http-wait"),
    LabelEntry("hibernate-flush", "flushing the Hibernate session", (
        "org.hibernate.event.internal.DefaultFlushEventListener",
        "org.hibernate.internal.SessionImpl.flush",
        "org.hibernate.engine.spi.ActionQueue",
    ), "orm"),
    LabelEntry("hibernate-load", "loading entities via Hibernate", (
        "org.hibernate.loader", "org.hibernate.internal.SessionImpl.find",
    ), "orm"),
    LabelEntry("jaxws-call", "invoking a SOAP/web-service endpoint", (
        "org.apache.cxf.interceptor", "com.sun.xml.ws.client", "javax.xml.ws.Service",
    ), "ws-call"),
    LabelEntry("file-io", "reading/writing a file", (
        "java.io.FileInputStream.readBytes",
        "java.io.FileOutputStream.writeBytes",
        "java.io.RandomAccessFile.readBytes",
        "sun.nio.ch.FileChannelImpl",
        "sun.nio.ch.FileDispatcherImpl",
    ), "file-io"),
    LabelEntry("crypto", "performing cryptographic work", (
        "sun.security.ssl.", "javax.crypto.", "java.security.SecureRandom",
    ), "crypto"),
    LabelEntry("logging-write", "writing a log record", (
        "org.apache.log4j.",
        "org.apache.logging.log4j.core.appender",
        "ch.qos.logback.core",
        "java.util.logging.Logger",
    ), "logging"),
)

_PARKED = ("WAITING", "TIMED_WAITING", "BLOCKED")

BUNDLED_RULES = (
    RuleEntry(
        "connection-pool-exhaustion", "{count} threads queue for a pooled connection",
        "CRITICAL",
        "Look at the threads that own connections first; bound statements with timeouts, "
        "turn on leak detection and compare pool size with worker count.",
        frames=(
            "com.zaxxer.hikari.util.ConcurrentBag.borrow",
            "com.zaxxer.hikari.pool.HikariPool.getConnection",
            "oracle.ucp.jdbc.PoolDataSourceImpl.getConnection",
            "oracle.ucp.common.UniversalConnectionPoolBase.borrowConnection",
            "weblogic.jdbc.common.internal.ConnectionPool.reserve",
            "weblogic.common.resourcepool.ResourcePoolImpl.reserveResource",
            "org.apache.commons.dbcp2.PoolingDataSource.getConnection",
            "org.apache.commons.pool2.impl.GenericObjectPool.borrowObject",
            "org.apache.tomcat.jdbc.pool.ConnectionPool.borrowConnection",
            "com.mchange.v2.resourcepool.BasicResourcePool.awaitAvailable",
            "com.ibm.ws.j2c.poolmanager.FreePool.createOrWaitForConnection",
            "com.ibm.ejs.j2c.FreePool.createOrWaitForConnection",
        ),
        states=_PARKED, min_threads=3, critical_threads=10),
    RuleEntry(
        "sync-logging-bottleneck", "{count} threads held up by a log appender's lock",
        "CRITICAL",
        "Move the appenders to asynchronous ones, log less on hot paths, never to a console.",
        frames=(
            "org.apache.log4j.Category.callAppenders",
            "org.apache.log4j.AppenderSkeleton.doAppend",
            "org.apache.logging.log4j.core.appender.OutputStreamManager",
            "ch.qos.logback.core.OutputStreamAppender",
            "ch.qos.logback.core.AppenderBase.doAppend",
            "java.util.logging.Logger.log",
            "java.util.logging.StreamHandler.publish",
        ),
        states=("BLOCKED",), min_threads=3, critical_threads=10),
    RuleEntry(
        "classloader-contention", "{count} threads held up while a class is loaded", "WARNING",
        "Warm up before taking traffic, use parallel-capable loaders, cache reflective lookups.",
        frames=("java.lang.ClassLoader.loadClass", ".loadClass"),
        states=("BLOCKED",), min_threads=3),
    RuleEntry(
        "weblogic-jta-wait", "{count} threads busy with a global transaction's commit",
        "WARNING",
        "Check the transaction timeout and every enlisted XA resource; one slow participant "
        "or slow transaction-log storage holds up the commit.",
        frames=(
            "weblogic.transaction.internal.ServerTransactionImpl.commit",
            "weblogic.transaction.internal.ServerTransactionImpl.internalCommit",
            "weblogic.transaction.internal.TransactionImpl.globalPrepare",
            "weblogic.transaction.internal.TransactionImpl.globalCommit",
        ),
        states=_PARKED, min_threads=3, critical_threads=10),
    RuleEntry(
        "weblogic-t3-peer-hang",
        "{count} remote calls to a peer server without an answer yet", "WARNING",
        "Find the peer named in the stacks, check it, and put a timeout on remote calls.",
        frames=(
            "weblogic.rjvm.ResponseImpl.waitForData",
            "weblogic.rmi.internal.BasicOutboundRequest.sendReceive",
        ),
        min_threads=2, critical_threads=8, persist_dumps=2),
    RuleEntry(
        "weblogic-ldap-auth-stall",
        "{count} logins stay in the directory lookup", "WARNING",
        "Check the directory server and the provider's connect and read timeouts.",
        frames=(
            "weblogic.security.providers.authentication",
            "netscape.ldap.LDAPConnection",
            "com.bea.common.security.internal.service",
        ),
        states=("WAITING", "TIMED_WAITING", "RUNNABLE"),
        min_threads=3, critical_threads=10, persist_dumps=2),
    RuleEntry(
        "tomcat-session-replication-blocked",
        "{count} threads held up while sessions are copied between nodes", "WARNING",
        "Check cluster membership and the network between nodes; keep sessions small.",
        frames=("org.apache.catalina.tribes.", "org.apache.catalina.ha.session."),
        states=("BLOCKED",), min_threads=3, critical_threads=8),
    RuleEntry(
        "tomcat-jsp-compilation-storm", "{count} requests translate a page template first",
        "WARNING",
        "Compile the pages at build time and switch development mode off.",
        frames=("org.apache.jasper.compiler.",),
        states=("RUNNABLE", "BLOCKED"), min_threads=3),
    RuleEntry(
        "websphere-sib-wait",
        "{count} threads wait on the built-in message bus", "WARNING",
        "Check the messaging engine, its message store and the destination depths.",
        frames=("com.ibm.ws.sib.", "com.ibm.websphere.sib."),
        states=_PARKED, min_threads=5, critical_threads=10, persist_dumps=2),
    RuleEntry(
        "exception-processing", "{count} thread(s) spend their time on stack traces of exceptions",
        "WARNING",
        "Fix what throws, or stop steering the hot path with exceptions.",
        frames=(
            "java.lang.Throwable.fillInStackTrace",
            "java.lang.Throwable.printStackTrace",
            "java.lang.Throwable.getStackTrace",
            "java.lang.Throwable.getOurStackTrace",
            "java.lang.ExceptionInInitializerError",
        ),
        states=("RUNNABLE", "BLOCKED"), min_threads=1, warn_threads=5),
)

#: ordered pool rules: (full-match regex, text before group 1, text after group 1);
#: a pattern without a group names the pool by the first text alone
POOL_RULES = (
    (r"(?:\[(?:STUCK|ACTIVE|STANDBY|HOGGING)] )?ExecuteThread:? '?\d+'? for queue: '(.+)'.*",
     "WebLogic queue '", "'"),
    (r"WebContainer : \d+", "WebSphere WebContainer", None),
    (r"(SIBJMSRAThreadPool|WMQJCAResourceAdapter|ORB\.thread\.pool|SoapConnectorThreadPool|TCPChannel\.DCS)\b.*",
     "WebSphere ", ""),
    (r"(server\.startup|Deferrable Alarm|Non-deferrable Alarm) : \d+", "WebSphere ", ""),
    (r"Default Executor-thread-\d+", "Liberty default executor", None),
    (r"((?:http|https|ajp)-[\w.-]+)-exec-\d+", "", ""),
    (r"(catalina-exec)-\d+", "", ""),
    (r"(Catalina-utility)-\d+", "", ""),
    (r"default task-\d+", "WildFly 'default' workers", None),
    (r"(EJB default) - \d+", "WildFly EJB default", None),
    (r"(XNIO-\d+) task-\d+", "", " tasks"),
    (r"(XNIO-\d+) I/O-\d+", "", " I/O"),
    (r"(ForkJoinPool(?:\.commonPool|-\d+))-worker-\d+", "", ""),
    (r"(pool-\d+)-thread-\d+", "", ""),
    (r"(HikariPool-\d+)[: ].*", "", ""),
    (r"(grpc-default-executor)-\d+", "", ""),
    (r"(scheduling|task-scheduler|taskExecutor)-\d+", "", ""),
)

HOUSEKEEPING_NAMES = (
    r"Reference Handler",
    r"Finalizer",
    r"Signal Dispatcher",
    r"Attach Listener",
    r"Common-Cleaner",
    r"Notification Thread",
    r"Service Thread",
    r"Monitor Deflation Thread",
    r"C[12] CompilerThread\d*",
    r"Sweeper thread",
    r"VM Thread",
    r"VM Periodic Task Thread",
    r"Cleaner-\d+",
    r"GC task thread#\d+.*",
    r"GC Thread#?\d*",
    r"G1 (Main Marker|Conc#\d+|Refine#\d+|Service|Young RemSet Sampling)",
    r"ZGC.*",
    r"Shenandoah.*",
    r"Concurrent Mark-Sweep GC Thread",
    r"CMS Main Thread",
    r"Gang worker#\d+.*",
    r"VM JFR Buffer Flush Thread",
    r"JFR .*",
)

#: class prefixes of the JDK and of containers; everything else is application code
PLATFORM_PREFIXES = (
    "java.", "javax.", "jakarta.", "jdk.", "sun.", "com.sun.",
    "org.apache.catalina.", "org.apache.tomcat.", "org.apache.coyote.",
    "weblogic.", "com.ibm.ws.", "com.ibm.io.", "io.undertow.",
    "org.jboss.", "org.wildfly.", "org.xnio.",
)

#: platforms in enum order; the order breaks score ties
PLATFORMS = ("WEBLOGIC", "WEBSPHERE", "LIBERTY", "TOMCAT", "WILDFLY", "UNKNOWN")
PLATFORM_MIN_SCORE = 4

#: middleware signals: (platform, weight, evidence, kind, pattern)
MIDDLEWARE_SIGNALS = (
    ("WEBLOGIC", 5, "names of work manager threads", "name",
     r"(?:\[(?:STUCK|ACTIVE|STANDBY|HOGGING)] )?ExecuteThread:? '?\d+'? for queue: .*"),
    ("WEBLOGIC", 3, "timer and listener threads of the server", "name",
     r"(weblogic\.timers\..*|DynamicListenThread.*|weblogic\.GCMonitor)"),
    ("WEBLOGIC", 4, "stacks run through weblogic packages", "frame", "weblogic."),
    ("WEBSPHERE", 5, "web container threads by name", "name", r"WebContainer : \d+"),
    ("WEBSPHERE", 3, "system pools of the application server by name", "name",
     r"(ORB\.thread\.pool.*|SIBJMSRAThreadPool.*|WMQJCAResourceAdapter.*|"
     r"Deferrable Alarm : \d+|Non-deferrable Alarm : \d+|server\.startup : \d+|"
     r"HAManager\..*|SoapConnectorThreadPool : \d+|TCPChannel\.DCS : \d+)"),
    ("WEBSPHERE", 4, "stacks run through com.ibm.ws packages", "frame", "com.ibm.ws."),
    ("WEBSPHERE", 2, "the dump's banner names J9", "banner", "J9 VM"),
    ("LIBERTY", 5, "threads of the default executor by name", "name", r"Default Executor-thread-\d+"),
    ("LIBERTY", 4, "stacks run through com.ibm.ws.threading packages", "frame", "com.ibm.ws.threading."),
    ("TOMCAT", 5, "connector worker threads by name", "name",
     r"(?:http|https|ajp)-[\w.-]+-exec-\d+"),
    ("TOMCAT", 4, "container housekeeping threads by name", "name",
     r"(catalina-exec-\d+|Catalina-utility-\d+|ContainerBackgroundProcessor.*|"
     r"(?:http|https|ajp)-[\w.-]+-(?:Poller|Acceptor|ClientPoller|BlockPoller).*)"),
    ("TOMCAT", 4, "stacks run through catalina packages", "frame", "org.apache.catalina."),
    ("TOMCAT", 3, "stacks run through tomcat packages", "frame", "org.apache.tomcat."),
    ("TOMCAT", 3, "stacks run through coyote packages", "frame", "org.apache.coyote."),
    ("WILDFLY", 5, "task and I/O worker threads by name", "name",
     r"(default task-\d+|XNIO-\d+ (task|I/O)-\d+.*|EJB default - \d+)"),
    ("WILDFLY", 4, "stacks run through jboss packages", "frame", "org.jboss."),
    ("WILDFLY", 3, "stacks run through undertow packages", "frame", "io.undertow."),
)

MIN_POOL_FOR_SATURATION = 8
MUXER_QUEUE = "weblogic.socket.Muxer"

#: J9 thread state letters
J9_STATES = {
    "R": ("RUNNABLE", "runs or may run (letter R)"),
    "B": ("BLOCKED", "enters a monitor that another thread owns (letter B)"),
    "MW": ("BLOCKED", "waits for a monitor (letters MW)"),
    "CW": ("WAITING", "waits to be notified (letters CW)"),
    "P": ("WAITING", "is parked (letter P)"),
    "S": ("WAITING", "is suspended (letter S)"),
    "Z": ("TERMINATED", "has ended (letter Z)"),
    "N": ("NEW", "has not started (letter N)"),
}

#: frames that mean "inside a blocking socket read"
SOCKET_FRAMES = (
    "java.net.SocketInputStream.socketRead0",
    "java.net.SocketInputStream.socketRead",
    "sun.nio.ch.NioSocketImpl.park",
    "sun.security.ssl.SSLSocketInputRecord.read",
    "java.net.SocketTimeoutException",
)

#: heap and section lines inside a dump that are expected and not counted as noise
EXPECTED_NOISE_PREFIXES = (
    "Threads class SMR info", "_java_thread_list", "Compiling:", "Heap",
    "PSYoungGen", "ParOldGen", "Metaspace", "class space", "eden space", "from space",
    "to   space", "object space", "garbage-first heap", "region size",
    "def new generation", "tenured generation", "compacting perm gen",
)

HOST_SUFFIXES = (
    "com", "net", "org", "io", "co", "de", "uk", "in", "corp", "internal", "local",
    "lan", "intra", "cloud", "svc", "cluster",
)
