"""Streaming queries; the SQL keeps only windows that the last watermark has closed."""

from pyspark.sql import functions as F

from tracewright.catalog.base import register
from tracewright.streaming import jobs as J

register("r1_repeat_sessions", "run_id:l event_type,start_ts,last_ts:s n:l", lambda tr: J.drained(J.repeat_sessions(J.event_stream(tr.spark, tr.sf_dir)), "sessions").select(
    "run_id", "event_type", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "n"),
    """WITH e AS (SELECT user_id AS run_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events),
  g AS (SELECT *, sum(brk) OVER (PARTITION BY run_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e),
  w AS (SELECT run_id, event_type, min(ts) AS a, max(ts) AS z, count(*) AS n FROM g GROUP BY run_id, event_type, s),
  answer AS (SELECT run_id, event_type, strftime(a, '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(z, '%Y-%m-%d %H:%M:%S') AS last_ts, n FROM w
  WHERE z + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events))""")
register("r2_stream_backlog", "run_id:l start_ts:s opened,closed,backlog:l", lambda tr: J.backlog_levels(J.drained(J.backlog_steps(J.event_stream(tr.spark, tr.sf_dir)), "backlog")).select(
    "run_id", F.date_format("start_ts", "yyyy-MM-dd").alias("start_ts"), "opened", "closed", "backlog"),
    """WITH w AS (SELECT user_id AS run_id, date_trunc('day', ts) AS d, count(*) FILTER (WHERE event_type = 'signup') AS opened, count(*) FILTER (WHERE event_type = 'purchase') AS closed FROM events GROUP BY 1, 2),
  k AS (SELECT * FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)),
  answer AS (SELECT run_id, strftime(d, '%Y-%m-%d') AS start_ts, opened, closed, sum(opened - closed) OVER (PARTITION BY run_id ORDER BY d) AS backlog FROM k)""")
