"""Throughput, windows and completion estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as TS
from . import oracle as O
from .registry import register
from .testbed import Testbed


def _tb(spark, sf):
    return Testbed(spark, sf)


@register("per_minute", O.with_views(
    "SELECT strftime(process_end, '%Y-%m-%d %H:%M') AS bucket, count(*) AS files FROM t_files "
    "WHERE status = 'completed' AND process_end IS NOT NULL GROUP BY 1", "t_files"))
def per_minute(spark, sf):
    """Completed files per minute."""
    return TS.bucket_counts(_tb(spark, sf).files, TS.MINUTE_KEY)


@register("per_hour", O.with_views(
    "SELECT strftime(process_end, '%Y-%m-%d %H') AS bucket, count(*) AS files FROM t_files "
    "WHERE status = 'completed' AND process_end IS NOT NULL GROUP BY 1", "t_files"))
def per_hour(spark, sf):
    """Completed files per hour."""
    return TS.bucket_counts(_tb(spark, sf).files, TS.HOUR_KEY)


@register("last24_buckets", O.with_views(
    "SELECT strftime(process_end, '%Y-%m-%d %H') AS bucket, count(*) AS files FROM t_files "
    "WHERE status = 'completed' AND process_end IS NOT NULL GROUP BY 1 ORDER BY bucket DESC LIMIT 24", "t_files"))
def last24_buckets(spark, sf):
    """The newest 24 hourly buckets that hold data."""
    return TS.last_buckets(_tb(spark, sf).files, 24)


@register("recent_rate", O.with_views(
    """SELECT count(*) AS files, count(*) * 60.0 / 60 AS files_per_hour, round(avg(processing_time), 6) AS avg_time
       FROM t_files WHERE status = 'completed'
         AND process_end >= (SELECT max(process_end) FROM t_files WHERE status = 'completed') - INTERVAL '60' MINUTE
         AND process_end <= (SELECT max(process_end) FROM t_files WHERE status = 'completed')""", "t_files"))
def recent_rate(spark, sf):
    """Files in the hour before an explicit as_of (the newest finish)."""
    f = _tb(spark, sf).files
    as_of = f.where(F.col("status") == "completed").agg(F.max("process_end")).scalar()
    r = TS.recent_rate(f, as_of, 60)
    return r.select("files", "files_per_hour", F.round("avg_time", 6).alias("avg_time"))


@register("sample_rates", O.with_views(
    """SELECT job_id, event_id, dt, round((value - prev_value) / dt, 6) AS rate FROM (
         SELECT job_id, event_id, value, lag(value) OVER w AS prev_value,
           date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS dt
         FROM t_log WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) x WHERE dt > 0""", "t_log"))
def sample_rates(spark, sf):
    """Rate of change between consecutive samples per job (lag)."""
    r = TS.sample_rates(_tb(spark, sf).log, "job_id", "ts", "value")
    return r.select("job_id", "event_id", "dt", F.round("rate", 6).alias("rate"))


@register("last10_samples", O.with_views(
    """SELECT job_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY job_id
         ORDER BY ts DESC, event_id DESC) AS rn FROM t_log) x WHERE rn <= 10""", "t_log"))
def last10_samples(spark, sf):
    """Newest ten samples per job."""
    return TS.last_samples(_tb(spark, sf).log, "job_id", "ts", 10).select("job_id", "event_id", "value")


@register("running_rate", O.with_views(
    """SELECT job_id, file_id, processed, elapsed_seconds,
         CASE WHEN elapsed_seconds > 0 THEN processed * 3600.0 / elapsed_seconds ELSE 0.0 END AS files_per_hour
       FROM (SELECT job_id, file_id, row_number() OVER w AS processed,
               date_diff('second', first_value(process_end) OVER w, process_end) AS elapsed_seconds
             FROM t_files WHERE status = 'completed'
             WINDOW w AS (PARTITION BY job_id ORDER BY process_end, file_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x
       WHERE processed % 5 = 0""", "t_files"))
def running_rate(spark, sf):
    """Running processed count and rate, every fifth file per job."""
    return TS.running_rate(_tb(spark, sf).files, 5)


def _plural_sql(n, word):
    return f"CAST({n} AS VARCHAR) || ' {word}' || CASE WHEN {n} <> 1 THEN 's' ELSE '' END"


def _eta_text_sql(h):
    mins = f"CAST(floor({h} * 60) AS BIGINT)"
    hh = f"CAST(floor({h}) AS BIGINT)"
    mm = f"CAST(floor(({h} - floor({h})) * 60) AS BIGINT)"
    d = f"CAST(floor({h} / 24) AS BIGINT)"
    hd = f"CAST(floor({h} % 24) AS BIGINT)"
    return (f"CASE WHEN {h} < 1 THEN CAST({mins} AS VARCHAR) || ' minutes' "
            f"WHEN {h} < 24 THEN {_plural_sql(hh, 'hour')} || CASE WHEN {mm} > 0 THEN ', ' || {_plural_sql(mm, 'minute')} ELSE '' END "
            f"ELSE {_plural_sql(d, 'day')} || CASE WHEN {hd} > 0 THEN ', ' || {_plural_sql(hd, 'hour')} ELSE '' END END")


ETA_PENDING_SQL = f"""SELECT job_id, elapsed_seconds,
          printf('%d:%02d:%02d', CAST(floor(elapsed_seconds / 3600) AS BIGINT),
                 CAST(floor((CAST(floor(elapsed_seconds) AS BIGINT) % 3600) / 60) AS BIGINT),
                 CAST(floor(elapsed_seconds) AS BIGINT) % 60) AS elapsed_time_formatted,
          files_per_hour,
          CASE WHEN files_per_hour > 0 AND pending > 0 THEN pending / files_per_hour ELSE 0.0 END AS estimated_completion_hours,
          CASE WHEN files_per_hour > 0 AND pending > 0 THEN {_eta_text_sql('(pending / files_per_hour)')}
               ELSE 'Unknown' END AS estimated_completion_time
        FROM (SELECT job_id, completed, pending, elapsed_seconds,
                CASE WHEN elapsed_seconds > 0 AND completed > 0 THEN completed / elapsed_seconds * 3600 ELSE 0.0 END
                  AS files_per_hour
              FROM (SELECT j.job_id, c.completed, c.pending,
                      CAST(date_diff('second', j.start_time, j.last_updated) AS DOUBLE) AS elapsed_seconds
                    FROM t_jobs j JOIN (SELECT job_id, count(*) FILTER (WHERE status = 'completed') AS completed,
                      count(*) FILTER (WHERE status = 'pending') AS pending FROM t_files GROUP BY job_id) c
                    ON j.job_id = c.job_id) a) b"""


@register("eta_pending", O.with_views(ETA_PENDING_SQL, "t_jobs", "t_files"))
def eta_pending(spark, sf):
    """Elapsed h:mm:ss, files/hour and the pending-files ETA text."""
    tb = _tb(spark, sf)
    return TS.eta_pending(tb.jobs, tb.files)


@register("eta_remaining", O.with_views(
    """SELECT job_id, status, remaining_files, rate,
         CASE WHEN status <> 'running' OR processed_files = 0 OR start_time IS NULL OR last_updated IS NULL THEN NULL
              WHEN rate <= 0 THEN 'inf days'
              WHEN remaining_files / rate / 60 / 60 > 24 THEN printf('%.1f days', remaining_files / rate / 60 / 60 / 24)
              WHEN remaining_files / rate / 60 / 60 > 1 THEN printf('%.1f hours', remaining_files / rate / 60 / 60)
              WHEN remaining_files / rate / 60 > 1 THEN printf('%.1f minutes', remaining_files / rate / 60)
              ELSE printf('%.1f seconds', remaining_files / rate) END AS estimated_remaining_time,
         CASE WHEN status <> 'running' THEN 'Job is not running, status is ' || status
              WHEN start_time IS NULL OR last_updated IS NULL OR processed_files = 0
                THEN 'Insufficient data to estimate completion time' END AS message,
         CASE WHEN total_files > 0 THEN (processed_files + error_files) * 100.0 / total_files ELSE 0.0 END
           AS percent_complete
       FROM (SELECT *, total_files - processed_files - error_files AS remaining_files,
               CASE WHEN date_diff('second', start_time, last_updated) > 0
                    THEN processed_files / CAST(date_diff('second', start_time, last_updated) AS DOUBLE) ELSE 0.0 END AS rate
             FROM t_jobs) j""", "t_jobs"))
def eta_remaining(spark, sf):
    """Remaining-files ETA with the reference's unit ladder."""
    return TS.eta_remaining(_tb(spark, sf).jobs)


@register("dashboard_snapshot", O.with_views(
    """SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'completed') AS completed,
         count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'error') AS errors,
         count(DISTINCT file_type) AS file_types,
         round(count(*) FILTER (WHERE status IN ('completed', 'error')) * 100.0 / count(*), 6) AS progress_pct,
         (SELECT count(*) FROM t_entities e JOIN t_results r ON e.result_id = r.result_id WHERE e.score >= 0.7) AS entities
       FROM t_files""", "t_files", "t_results", "t_entities"))
def dashboard_snapshot(spark, sf):
    """One-row dashboard snapshot joined from single-row aggregates."""
    tb = _tb(spark, sf)
    f = tb.files.agg(F.count(F.lit(1)).alias("total_files"),
                     F.count_if(F.col("status") == "completed").alias("completed"),
                     F.count_if(F.col("status") == "pending").alias("pending"),
                     F.count_if(F.col("status") == "error").alias("errors"),
                     F.count_distinct("file_type").alias("file_types"),
                     F.round(F.count_if(F.col("status").isin("completed", "error")) * 100.0 / F.count(F.lit(1)), 6)
                     .alias("progress_pct"))
    e = tb.entities.where(F.col("score") >= 0.7).join(tb.results.select("result_id"), "result_id") \
        .agg(F.count(F.lit(1)).alias("entities"))
    return f.withColumn("entities", e.scalar())


@register("dashboard_job", O.ledger_sql(
    f"""SELECT j.job_id, j.name, j.status, c.*, round((c.completed + c.error) * 100.0 / c.total_files, 1) AS progress_percent,
          round(c.error * 100.0 / c.total_files, 1) AS error_rate,
          CAST(date_diff('second', j.start_time, j.last_updated) AS BIGINT) AS elapsed_seconds,
          (SELECT count(DISTINCT file_type) FROM t_files f WHERE f.job_id = j.job_id) AS file_types,
          (SELECT count(DISTINCT entity_type) FROM fe WHERE fe.job_id = j.job_id) AS entity_types,
          (SELECT count(*) FROM fe WHERE fe.job_id = j.job_id) AS entities,
          (SELECT count(*) FROM fs WHERE {O.sql_trigger('types')}
             AND file_id IN (SELECT file_id FROM t_files f WHERE f.job_id = j.job_id)) AS high_risk
        FROM (SELECT * FROM jobs ORDER BY job_id DESC LIMIT 1) j,
          LATERAL (SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'completed') AS completed,
            count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
            count(*) FILTER (WHERE status = 'error') AS error FROM t_files f WHERE f.job_id = j.job_id) c""",
    ("jobs", O.VIEWS["t_jobs"][1])))
def dashboard_job(spark, sf):
    """The newest job's snapshot, one row: job, processing, time, types
    and high-risk files."""
    from ..operators import classify as C
    from ..operators import ledger as L
    tb = _tb(spark, sf)
    job = L.latest_job(tb.jobs).select("job_id", "name", "status", F.timestamp_diff(
        "SECOND", F.col("start_time"), F.col("last_updated")).alias("elapsed_seconds"))
    newest = job.select("job_id").scalar()
    files = tb.files.where(F.col("job_id") == newest)
    counts = files.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        *(F.count_if(F.col("status") == s).alias(s if s != "error" else "error") for s in (
            "completed", "pending", "processing", "error")),
        F.count_distinct("file_type").alias("file_types"))
    fe = C.ledger_entities(files, tb.results, tb.entities)
    sets = C.with_breach(fe.groupBy("file_id").agg(F.collect_set("entity_type").alias("entity_types"),
                                                   F.count(F.lit(1)).alias("n")))
    found = sets.agg(F.size(F.array_distinct(F.flatten(F.collect_set("entity_types")))).cast("long").alias("entity_types"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.count_if("breach_trigger").alias("high_risk"))
    out = job.join(counts, "job_id")
    for c in found.columns:
        out = out.withColumn(c, found.select(c).scalar())
    return out.select(
        "job_id", "name", "status", "total_files", "completed", "pending", "processing", "error",
        F.round((F.col("completed") + F.col("error")) * 100.0 / F.col("total_files"), 1).alias("progress_percent"),
        F.round(F.col("error") * 100.0 / F.col("total_files"), 1).alias("error_rate"), "elapsed_seconds", "file_types",
        "entity_types", "entities", "high_risk")
