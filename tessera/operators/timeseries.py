"""Throughput and completion analytics.

Every "now" of the reference is an explicit ``as_of`` column or value, so
results are reproducible.  Bucket counts are plain aggregates; running
counts and lags are two-level distributed scans (``operators.parallel``), so
a job or host holding most of the rows is not processed by one task; the
newest-n samples use a window group limit (top-n before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_KEY = "yyyy-MM-dd HH:mm"
HOUR_KEY = "yyyy-MM-dd HH"


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def parse_time(text: Column) -> Column:
    """A time written in ISO form or with a space, with or without
    fractions of a second; null when none fits."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def bucket_counts(files: DataFrame, fmt: str = MINUTE_KEY, ts: str = "process_end") -> DataFrame:
    """Completed files per minute / hour bucket (string keys, like the
    reference's strftime keys)."""
    done = files.where((F.col("status") == "completed") & F.col(ts).isNotNull())
    return done.groupBy(F.date_format(ts, fmt).alias("bucket")).agg(F.count(F.lit(1)).alias("files"))


def last_buckets(files: DataFrame, n: int = 24, fmt: str = HOUR_KEY) -> DataFrame:
    """The newest n buckets that have data."""
    return bucket_counts(files, fmt).orderBy(F.desc("bucket")).limit(n)


def recent_rate(files: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Files finished in the ``minutes`` before ``as_of``, the hourly
    rate and their mean processing time."""
    lo = F.timestamp_add("MINUTE", F.lit(-minutes), as_of)
    recent = files.where((F.col("status") == "completed") & (F.col("process_end") >= lo)
                         & (F.col("process_end") <= as_of))
    return recent.agg(F.count(F.lit(1)).alias("files"),
                      (F.count(F.lit(1)) * 60.0 / minutes).alias("files_per_hour"),
                      F.avg("processing_time").alias("avg_time"))


def sample_rates(samples: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Rate of change between consecutive samples of a key; no row when
    the time step is not positive."""
    from .parallel import lagged
    s = lagged(samples.select(key, "event_id", ts, value), key, [ts, "event_id"], [ts, value])
    s = s.withColumnRenamed("prev_" + ts, "prev_ts").withColumnRenamed("prev_" + value, "prev_value")
    dt = F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col(ts)) / F.lit(1e6)
    s = s.withColumn("dt", dt).where(F.col("dt") > 0)
    return s.select(key, "event_id", "dt", ((F.col(value) - F.col("prev_value")) / F.col("dt")).alias("rate"))


def last_samples(samples: DataFrame, key: str, ts: str, n: int = 10) -> DataFrame:
    """The newest n samples per key (a window group limit)."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc("event_id"))
    return samples.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def running_rate(files: DataFrame, every: int = 5) -> DataFrame:
    """Running count of completed files per job and the rate so far,
    reported every ``every`` files."""
    from .parallel import ranked
    done = files.where(F.col("status") == "completed").select("job_id", "file_id", "process_end")
    # a job may hold most of the files: the running count is a distributed
    # rank, and the first finish a partial aggregate, not a per-job window
    r = ranked(done, ["process_end", "file_id"], ["job_id"], out="processed")
    first = done.groupBy("job_id").agg(F.min("process_end").alias("first_end"))
    r = r.where(F.col("processed") % every == 0).join(first, "job_id")
    elapsed = seconds_between(F.col("first_end"), F.col("process_end"))
    return r.select("job_id", "file_id", "processed", elapsed.alias("elapsed_seconds"),
                    F.when(elapsed > 0, F.col("processed") * 3600.0 / elapsed).otherwise(F.lit(0.0))
                    .alias("files_per_hour"))


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n != 1, F.lit("s")).otherwise(F.lit("")))


def hms(seconds: Column) -> Column:
    """'h:mm:ss' of a second count (hours unbounded)."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def eta_text(hours: Column) -> Column:
    """W7: '<m> minutes' / '<h> hour(s)[, <m> minute(s)]' /
    '<d> day(s)[, <h> hour(s)]'."""
    mins = F.floor(hours * 60).cast("long")
    h = F.floor(hours).cast("long")
    m = F.floor((hours - F.floor(hours)) * 60).cast("long")
    d = F.floor(hours / 24).cast("long")
    hh = F.floor(hours % 24).cast("long")
    return (F.when(hours < 1, F.concat(mins.cast("string"), F.lit(" minutes")))
            .when(hours < 24, F.concat(_plural(h, "hour"), F.when(m > 0, F.concat(F.lit(", "), _plural(m, "minute")))
                                       .otherwise(F.lit(""))))
            .otherwise(F.concat(_plural(d, "day"), F.when(hh > 0, F.concat(F.lit(", "), _plural(hh, "hour")))
                                .otherwise(F.lit("")))))


def eta_pending(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Elapsed time, files/hour and the ETA of the pending files."""
    c = files.groupBy("job_id").agg(F.count_if(F.col("status") == "completed").alias("completed"),
                                    F.count_if(F.col("status") == "pending").alias("pending"))
    j = jobs.select("job_id", "start_time", "last_updated").join(c, "job_id")
    el = seconds_between(F.col("start_time"), F.col("last_updated")).cast("double")
    j = j.withColumn("elapsed_seconds", el)
    fph = F.when((F.col("elapsed_seconds") > 0) & (F.col("completed") > 0),
                 F.col("completed") / F.col("elapsed_seconds") * 3600).otherwise(F.lit(0.0))
    j = j.withColumn("files_per_hour", fph)
    est_h = F.col("pending") / F.col("files_per_hour")
    ok = (F.col("files_per_hour") > 0) & (F.col("pending") > 0)
    return j.select("job_id", "elapsed_seconds", hms(F.col("elapsed_seconds")).alias("elapsed_time_formatted"),
                    "files_per_hour",
                    F.when(ok, est_h).otherwise(F.lit(0.0)).alias("estimated_completion_hours"),
                    F.when(ok, eta_text(est_h)).otherwise(F.lit("Unknown")).alias("estimated_completion_time"))


def eta_remaining(jobs: DataFrame) -> DataFrame:
    """remaining = total - processed - error; rate from elapsed time."""
    remaining = F.col("total_files") - F.col("processed_files") - F.col("error_files")
    el = seconds_between(F.col("start_time"), F.col("last_updated")).cast("double")
    rate = F.when(el > 0, F.col("processed_files") / el).otherwise(F.lit(0.0))
    j = jobs.select("job_id", "status", "total_files", "processed_files", "error_files", "start_time",
                    "last_updated", remaining.alias("remaining_files"), rate.alias("rate"))
    est_s = F.col("remaining_files") / F.col("rate")
    est_m = est_s / 60
    est_h = est_m / 60
    text = (F.when(F.col("rate") <= 0, F.lit("inf days"))
            .when(est_h > 24, F.format_string("%.1f days", est_h / 24))
            .when(est_h > 1, F.format_string("%.1f hours", est_h))
            .when(est_m > 1, F.format_string("%.1f minutes", est_m))
            .otherwise(F.format_string("%.1f seconds", est_s)))
    insufficient = F.col("start_time").isNull() | F.col("last_updated").isNull() | (F.col("processed_files") == 0)
    msg = (F.when(F.col("status") != "running", F.concat(F.lit("Job is not running, status is "), F.col("status")))
           .when(insufficient, F.lit("Insufficient data to estimate completion time")))
    pct = F.when(F.col("total_files") > 0, (F.col("processed_files") + F.col("error_files")) * 100.0
                 / F.col("total_files")).otherwise(F.lit(0.0))
    return j.select("job_id", "status", "remaining_files", "rate",
                    F.when(msg.isNull(), text).alias("estimated_remaining_time"), msg.alias("message"),
                    pct.alias("percent_complete"))
