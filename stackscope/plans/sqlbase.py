"""The snapshot of the event table as SQL, for checking results with a database."""

from __future__ import annotations


def snap(by_node: bool = False, body: str = "") -> str:
    """CTEs ``days`` and ``snap`` followed by a query."""
    series = "'n' || CAST(user_id % 10 AS VARCHAR)" if by_node else "'all'"
    skew = "CASE WHEN user_id % 2 = 1 THEN 1.5 ELSE 1.0 END" if by_node else "1.0"
    return f"""
WITH RECURSIVE ev AS (
  SELECT {series} AS series_id, CAST(ts AS DATE) AS day, user_id AS u, event_type AS et,
         CAST(round(value * 100) AS BIGINT) AS cents, {skew} AS skew,
         row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events),
one AS (SELECT * FROM ev WHERE rn = 1),
days AS (
  SELECT series_id, day, dense_rank() OVER (PARTITION BY series_id ORDER BY day) - 1 AS dump_idx
  FROM (SELECT DISTINCT series_id, day FROM one)),
snap0 AS (
  SELECT o.series_id, d.dump_idx, o.day, o.u, o.et, o.u % 3 AS v,
    CASE o.u % 4 WHEN 0 THEN 'http-nio-8080-exec-' || CAST(o.u AS VARCHAR)
      WHEN 1 THEN 'pool-7-thread-' || CAST(o.u AS VARCHAR)
      WHEN 2 THEN 'ExecuteThread: ''' || CAST(o.u AS VARCHAR) || ''' for queue: ''q'''
      ELSE 'WebContainer : ' || CAST(o.u AS VARCHAR) END AS norm,
    CASE WHEN o.u % 4 <> 2 THEN '' WHEN o.et = 'error' THEN '[STUCK] ' WHEN o.et = 'purchase' THEN '[HOGGING] '
      WHEN o.et = 'signup' THEN '[STANDBY] ' ELSE '[ACTIVE] ' END AS mark,
    CASE o.u % 4 WHEN 0 THEN 'http-nio-8080' WHEN 1 THEN 'pool-7' WHEN 2 THEN 'WebLogic queue ''q'''
      ELSE 'WebSphere WebContainer' END AS pool,
    CASE o.et WHEN 'click' THEN 'RUNNABLE' WHEN 'purchase' THEN 'RUNNABLE' WHEN 'error' THEN 'BLOCKED'
      WHEN 'view' THEN 'WAITING' ELSE 'TIMED_WAITING' END AS state,
    CASE WHEN o.et = 'view' THEN 'IDLE' ELSE 'APPLICATION' END AS cls,
    CASE o.et WHEN 'signup' THEN 'db-pool-wait' WHEN 'error' THEN 'logging' END AS category,
    CASE o.et
      WHEN 'click' THEN 'java.net.SocketInputStream.socketRead0'
      WHEN 'purchase' THEN 'com.shop.cart.Checkout' || CAST(o.u % 3 AS VARCHAR) || '.pay'
      WHEN 'error' THEN 'org.apache.log4j.Category.callAppenders'
      WHEN 'view' THEN 'java.util.concurrent.LinkedBlockingQueue.take'
      ELSE 'com.zaxxer.hikari.util.ConcurrentBag.borrow' END AS f0,
    CASE o.et
      WHEN 'click' THEN 'com.shop.web.Page' || CAST(o.u % 3 AS VARCHAR) || '.render'
      WHEN 'purchase' THEN 'com.shop.web.Dispatcher.dispatch'
      WHEN 'error' THEN 'com.shop.audit.Trail' || CAST(o.u % 3 AS VARCHAR) || '.write'
      WHEN 'view' THEN 'java.util.concurrent.ThreadPoolExecutor.getTask'
      ELSE 'com.shop.user.Signup' || CAST(o.u % 3 AS VARCHAR) || '.store' END AS f1,
    'java.lang.Thread.run' AS f2,
    10000 * sum(o.cents) OVER (PARTITION BY o.series_id, o.u ORDER BY o.day) AS cpu,
    CAST(date_diff('day', DATE '2024-01-01', o.day) AS DOUBLE) * 86400.0 * o.skew + o.u AS elapsed
  FROM one o JOIN days d ON d.series_id = o.series_id AND d.day = o.day),
snap AS (
  SELECT *, mark || norm AS name, '0x' || lower(hex(u + 4096)) || '|' || norm AS key,
    md5(f0 || chr(10) || f1 || chr(10) || f2) AS h,
    f0 || CASE WHEN et = 'click' THEN '(Native Method)' ELSE '(' || split_part(f0, '.', -1) || '.java:1)' END AS r0,
    f1 || '(' || split_part(f1, '.', -1) || '.java:1)' AS r1,
    'java.lang.Thread.run(run.java:1)' AS r2
  FROM snap0),
n_dumps AS (SELECT series_id, count(*) AS n FROM days GROUP BY series_id),
holds AS (
  SELECT series_id, dump_idx, u, name, u % 8 AS slot FROM snap WHERE et = 'purchase'
  UNION ALL
  SELECT series_id, dump_idx, u, name, (u + 3) % 8 AS slot FROM snap WHERE et = 'error' AND u % 5 = 0),
holder AS (
  SELECT series_id, dump_idx, slot, max(u) AS hu, arg_max(name, u) AS holder FROM holds GROUP BY ALL),
waits AS (SELECT series_id, dump_idx, u, name, key, u % 8 AS slot FROM snap WHERE et = 'error'),
edges AS (
  SELECT w.series_id, w.dump_idx, w.u, w.name AS waiter, h.holder, h.hu, w.slot
  FROM waits w JOIN holder h USING (series_id, dump_idx, slot) WHERE h.holder <> w.name)
{body}"""
