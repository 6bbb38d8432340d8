"""Streaming queries (K1-K9): each drains the available files of a driver
table through a real stream (fresh checkpoint) and returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as S
from ..streaming import timers as TM
from . import oracle as O
from .registry import register


@register("stream_detect", O.with_views('SELECT doc_id, entity_type, start, "end", score, text FROM spans',
                                        extra=O.spans_view(None, 0.7)))
def stream_detect(spark, sf):
    """K1: incremental detection stream over the documents files."""
    return S.stream_detect(spark, sf)


@register("stream_sink", O.with_views("SELECT entity_type, count(*) AS n FROM spans GROUP BY entity_type",
                                      extra=O.spans_view(None, 0.7)))
def stream_sink(spark, sf):
    """K2: foreachBatch sink writing results + entities per batch id."""
    return S.stream_sink(spark, sf).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@register("stream_dedup", """SELECT DISTINCT o_custkey % 3 + 1 AS job_id,
    concat('/corpus/job', o_custkey % 3 + 1, '/d', o_orderkey % 7, '/f', o_orderkey) AS file_path FROM orders""")
def stream_dedup(spark, sf):
    """K3: register-once dedup of (job, path) within a watermark."""
    return S.stream_dedup(spark, sf).select("job_id", "file_path")


@register("stream_per_hour", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY 1""")
def stream_per_hour(spark, sf):
    """K4: tumbling hourly windows on event time."""
    return S.stream_per_hour(spark, sf)


@register("stream_sliding", """SELECT strftime(make_timestamp(b * 300000000), '%Y-%m-%d %H:%M:%S') AS window_start,
    count(*) AS events FROM (SELECT epoch_us(ts) // 300000000 - k AS b FROM events, range(6) r(k)) x GROUP BY b""")
def stream_sliding(spark, sf):
    """K5: 30-minute windows sliding by 5 minutes."""
    return S.stream_sliding(spark, sf)


@register("stream_sessions", """SELECT job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
    strftime(max(ts) + INTERVAL '2' HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS events
  FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL '2' HOUR THEN 1 ELSE 0 END)
          OVER (PARTITION BY job_id ORDER BY ts, event_id) AS sid
        FROM (SELECT event_id, user_id AS job_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
              FROM events) a) b GROUP BY job_id, sid
  HAVING max(ts) + INTERVAL '2' HOUR <= (SELECT max(ts) - INTERVAL '1' HOUR FROM events)""")
def stream_sessions(spark, sf):
    """K6: per-job activity sessions (2 h gap) that the watermark has closed."""
    return S.stream_sessions(spark, sf)


@register("stream_stalled", """SELECT o_orderkey AS file_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started,
    'timeout' AS reason FROM orders
  WHERE ((o_orderstatus = 'P' AND o_orderkey % 2 = 1) OR o_orderkey % 3600 > 300)
    AND o_orderdate + INTERVAL '300' SECOND < (SELECT least(max(o_orderdate), max(
          CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 2 = 0 THEN o_orderdate + (o_orderkey % 3600) * INTERVAL '1' SECOND END))
        - INTERVAL '10' MINUTE FROM orders)""")
def stream_stalled(spark, sf):
    """K7: files without an end event within 300 s of event time after their
    start (interval join of the start and end streams)."""
    r = S.stream_stalled(spark, sf)
    return r.select("file_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "reason")


@register("stream_late", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    count(*) FILTER (NOT late) AS events, count(*) FILTER (late) AS late
  FROM (SELECT ts, event_id % 10 = 0 AND ts <= (SELECT max(ts) - INTERVAL '1' HOUR FROM events WHERE event_id % 10 <> 0)
          AS late FROM events) x GROUP BY 1""")
def stream_late(spark, sf):
    """K8: rows behind the watermark dropped and counted, with a late part."""
    return S.stream_late(spark, sf)


@register("stream_rates", O.with_views(
    """SELECT job_id, event_id, dt, round((value - prev_value) / dt, 6) AS rate FROM (
         SELECT job_id, event_id, value, lag(value) OVER w AS prev_value,
           date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS dt
         FROM t_log WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) x WHERE dt > 0""", "t_log"))
def stream_rates(spark, sf):
    """K9: sample rates on a stream (foreachBatch + carried last sample)."""
    r = S.stream_rates(spark, sf)
    return r.select("job_id", "event_id", "dt", F.round("rate", 6).alias("rate"))


@register("stream_watch", """WITH o AS (
    SELECT o_orderkey AS k, o_orderdate AS t, o_orderkey % 5 = 0 AS twice,
      CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 2 = 0 THEN o_orderkey % 900 END AS e FROM orders),
  w AS (SELECT max(greatest(t + CASE WHEN twice THEN 200 ELSE 0 END * INTERVAL '1' SECOND, t + coalesce(e, 0) * INTERVAL '1' SECOND))
          - INTERVAL '10' MINUTE AS mark FROM o),
  r AS (SELECT k, t + CASE WHEN twice THEN 200 ELSE 0 END * INTERVAL '1' SECOND AS started,
          CASE WHEN twice AND NOT coalesce(e > 0 AND e <= 200, false) THEN 2 ELSE 1 END AS starts
        FROM o WHERE NOT coalesce(CASE WHEN twice THEN e > 200 AND e <= 500 ELSE e > 0 AND e <= 300 END, false))
  SELECT k AS file_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started,
    strftime(started + INTERVAL '300' SECOND, '%Y-%m-%d %H:%M:%S') AS deadline, starts, 'timeout' AS reason
  FROM r, w WHERE started + INTERVAL '300' SECOND < mark""")
def stream_watch(spark, sf):
    """K7 by keyed state and timers: a repeated start resets its deadline."""
    r = TM.stream_watch(spark, sf)
    times = (F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started", "deadline"))
    return r.select("file_id", *times, "starts", "reason")


@register("stream_progress", """SELECT count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_event,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event, count(*) AS observed_rows,
    coalesce(sum(CASE WHEN event_id % 10 = 0 AND ts <= (SELECT max(ts) - INTERVAL '1' HOUR FROM events WHERE event_id % 10 <> 0)
      THEN 1 END), 0)::BIGINT AS late_rows FROM events GROUP BY event_id % 10 = 0""")
def stream_progress(spark, sf):
    """Rows per part as the stream reports them, observed counters,
    and the rows that the watermark dropped."""
    return S.stream_progress(spark, sf)
