"""Metrics JSON-lines source (S7) and sample rates (W4 on metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("timestamp_epoch", T.DoubleType()),
    T.StructField("monitor_runtime", T.DoubleType()),
    T.StructField("host", T.LongType()),
    T.StructField("system", T.StructType([
        T.StructField("cpu", T.StructType([T.StructField("total_percent", T.DoubleType()),
                                           T.StructField("load_avg", T.ArrayType(T.DoubleType()))])),
        T.StructField("memory", T.StructType([T.StructField("percent", T.DoubleType())])),
        T.StructField("disk", T.StructType([T.StructField("read_bytes", T.LongType()),
                                            T.StructField("write_bytes", T.LongType())])),
        T.StructField("network", T.StructType([T.StructField("bytes_sent", T.LongType()),
                                               T.StructField("bytes_recv", T.LongType())])),
    ])),
    T.StructField("processes", T.StructType([
        T.StructField("worker_processes", T.ArrayType(T.StructType([T.StructField("pid", T.LongType())])))])),
])

MB = 1024.0 * 1024.0


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit nested schema (no inference)."""
    return spark.read.schema(METRICS).json(path)


def read_metrics_stream(spark: SparkSession, path: str) -> DataFrame:
    """S7 as a stream: new JSON-lines files are picked up as they land."""
    return spark.readStream.schema(METRICS).json(path)


def metric_rates(m: DataFrame, key: str = "host") -> DataFrame:
    """MB/s of disk and network and the change of the worker count per
    second between consecutive samples of a host (ties by the process ids);
    no row when the time step is <= 0."""
    from ..operators.parallel import lagged
    cols = ["timestamp_epoch", "rb", "wb", "ns", "nr", "workers"]
    s = m.select(key, "timestamp_epoch",
                 F.col("system.disk.read_bytes").alias("rb"), F.col("system.disk.write_bytes").alias("wb"),
                 F.col("system.network.bytes_sent").alias("ns"), F.col("system.network.bytes_recv").alias("nr"),
                 F.size("processes.worker_processes").alias("workers"),
                 F.array_max("processes.worker_processes.pid").alias("tie"))
    # lag as an equi-join on (host, rank - 1): a busy host is not one task
    s = lagged(s, key, ["timestamp_epoch", "tie"], cols)

    def d(c):
        return F.col(c) - F.col("prev_" + c)

    s = s.select(key, "timestamp_epoch", d("timestamp_epoch").alias("dt"), d("rb").alias("drb"),
                 d("wb").alias("dwb"), d("ns").alias("dns"), d("nr").alias("dnr"), d("workers").alias("worker_change"))
    s = s.where(F.col("dt") > 0)
    return s.select(key, "timestamp_epoch",
                    (F.col("drb") / F.col("dt") / MB).alias("disk_read_mb_s"),
                    (F.col("dwb") / F.col("dt") / MB).alias("disk_write_mb_s"),
                    (F.col("dns") / F.col("dt") / MB).alias("net_sent_mb_s"),
                    (F.col("dnr") / F.col("dt") / MB).alias("net_recv_mb_s"),
                    (F.col("worker_change") / F.col("dt")).alias("worker_rate"))


def metrics_from_log(log: DataFrame) -> DataFrame:
    """Metric samples derived from a processing log (one sample per event:
    cumulative byte counters per host), in the S7 record shape."""
    from ..operators.parallel import prefix_scan
    base = log.select("job_id", "ts", "event_id", "value", F.lit(4096).cast("long").alias("b"),
                      (F.col("value") * 1000).cast("long").alias("n"))
    base = prefix_scan(base, ["ts", "event_id"], ["job_id"], sums={"b": "rb", "n": "ns"})
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return base.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), epoch.alias("timestamp_epoch"),
        F.lit(0.0).alias("monitor_runtime"), F.col("job_id").alias("host"),
        F.struct(F.struct(F.col("value").alias("total_percent"), F.array(F.col("value")).alias("load_avg")).alias("cpu"),
                 F.struct(F.col("value").alias("percent")).alias("memory"),
                 F.struct(F.col("rb").cast("long").alias("read_bytes"), (F.col("rb") / 4).cast("long").alias("write_bytes"))
                 .alias("disk"),
                 F.struct(F.col("ns").cast("long").alias("bytes_sent"), (F.col("ns") * 2).cast("long").alias("bytes_recv"))
                 .alias("network")).alias("system"),
        F.struct(F.array_repeat(F.struct(F.col("event_id").alias("pid")), (F.col("event_id") % 5 + 1).cast("int"))
                 .alias("worker_processes")).alias("processes"))
