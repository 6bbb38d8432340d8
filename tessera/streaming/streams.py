"""Structured Streaming operators.

The reference polls its ledger in a loop; here every incremental job is a
stream over a file source with a checkpoint, so a restart resumes exactly
where the last committed micro-batch ended (resumable scan, K1), and sinks
are idempotent per batch id (K2).  ``run_available`` drains what is there
(``trigger(availableNow=True)``) and returns, which is how a scheduled scan
runs; the same plans run continuously with a processing-time trigger.

Checkpoints live under the session's ``spark.checkpoint.dir`` (a shared
folder on a cluster), never in a machine-local temp folder.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import detect as D
from ..session import scratch_path


def source(spark: SparkSession, folder: str, table: str, max_files: int | None = None) -> DataFrame:
    """A parquet file stream over one table: ``<table>.parquet`` and any
    later ``<table>*.parquet`` in the folder, each a file or a folder of part
    files (new files are new data)."""
    folder = folder.rstrip("/")
    r = spark.readStream.schema(spark.read.parquet(f"{folder}/{table}.parquet").schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{folder}/{table}*.parquet")


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that batches have written below ``path``; none, if there was
    no batch yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"streams/{name}/checkpoint")


def run_available(df: DataFrame, name: str, mode: str = "append", path: str | None = None,
                  foreach_batch: Callable | None = None, fresh: bool = True) -> str | None:
    """Drain the available input once and stop (resumable: the checkpoint
    remembers what was consumed).  Rows go to parquet files, or to
    ``foreach_batch``; never through the driver.  ``fresh`` starts from an
    empty checkpoint and output (used by the registered queries so each run
    recomputes from scratch).  Returns the output path."""
    spark = df.sparkSession
    name = name + ("-" + _run_tag() if fresh else "")
    path = path or scratch_path(spark, f"streams/{name}/out")
    w = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint_for(spark, name))
         .trigger(availableNow=True))
    q = w.foreachBatch(foreach_batch).start() if foreach_batch else w.format("parquet").option("path", path).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return path


def drained(df: DataFrame, name: str, fresh: bool = True) -> DataFrame:
    """The rows that an append-mode stream has written so far."""
    return df.sparkSession.read.schema(df.schema).parquet(run_available(df, name, fresh=fresh))


def latest(df: DataFrame, name: str, keys: list[str], fresh: bool = True) -> DataFrame:
    """The last value that an update-mode aggregate has given each key.

    Each micro-batch overwrites its own folder, so a replayed batch changes
    nothing; state older than the watermark leaves the stream."""
    spark = df.sparkSession
    name = name + ("-" + _run_tag() if fresh else "")
    base = scratch_path(spark, f"streams/{name}/batches")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
    run_available(df, name, mode="update", foreach_batch=write, fresh=False)
    schema = T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])
    rest = [c for c in df.columns if c not in keys]
    rows = _written(spark, base, schema).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("v"))
    return rows.select(*keys, "v.*")


def _run_tag() -> str:
    import uuid
    return uuid.uuid4().hex[:12]


def with_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Event time must be a TIMESTAMP for watermarks (the tables store
    TIMESTAMP_NTZ)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


# --------------------------------------------------------------------- K1/K2
def stream_detect(spark: SparkSession, folder: str, name: str = "tessera_stream_detect",
                  fresh: bool = True) -> DataFrame:
    """K1: incremental detection over newly arrived document files.  With
    ``fresh=False`` the checkpoint of ``name`` is kept, so a rerun processes
    only files that arrived since the last run (resumable scan)."""
    docs = source(spark, folder, "documents").select("doc_id", "text")
    return drained(D.detect_entities(docs), name, fresh)


def idempotent_batch_writer(base: str) -> Callable:
    """K2: each micro-batch writes results and entities under its batch id
    with overwrite, so a replayed batch replaces its own output only."""
    def write(batch: DataFrame, batch_id: int) -> None:
        arr = batch.persist()
        res = arr.select(F.col("doc_id").alias("result_id"), F.size("entities").cast("long").alias("entity_count"),
                         F.lit(batch_id).alias("batch_id"))
        ent = arr.select(F.col("doc_id").alias("result_id"), F.explode("entities").alias("s"),
                         F.lit(batch_id).alias("batch_id")).select("result_id", "s.*", "batch_id")
        res.write.mode("overwrite").parquet(f"{base}/results/batch_id={batch_id}")
        # a type's rows in a few files, however many tasks hold some
        ent = ent.repartition("entity_type", F.pmod(F.xxhash64("result_id"), F.lit(8)))
        ent.write.mode("overwrite").partitionBy("entity_type").parquet(f"{base}/entities/batch_id={batch_id}")
        arr.unpersist()
    return write


def stream_sink(spark: SparkSession, folder: str) -> DataFrame:
    """K2: detection stream appended to results + entities tables."""
    base = scratch_path(spark, "streams/sink-" + _run_tag())
    docs = source(spark, folder, "documents").select("doc_id", "text")
    arrays = D.detect_arrays(docs)
    run_available(arrays, "tessera_stream_sink", foreach_batch=idempotent_batch_writer(base))
    span = arrays.schema["entities"].dataType.elementType
    return _written(spark, f"{base}/entities", T.StructType(
        [T.StructField("result_id", arrays.schema["doc_id"].dataType), *span.fields, T.StructField("batch_id", T.IntegerType())]))


# --------------------------------------------------------------------- K3
def stream_dedup(spark: SparkSession, folder: str, name: str = "tessera_stream_dedup") -> DataFrame:
    """K3: register each (job, path) once; duplicates arriving within the
    watermark delay are dropped and their state expires afterwards."""
    o = source(spark, folder, "orders")
    files = o.select((F.col("o_custkey") % 3 + 1).alias("job_id"),
                     F.concat(F.lit("/corpus/job"), (F.col("o_custkey") % 3 + 1).cast("string"), F.lit("/d"),
                              (F.col("o_orderkey") % 7).cast("string"), F.lit("/f"),
                              F.col("o_orderkey").cast("string")).alias("file_path"),
                     F.col("o_orderdate").cast("timestamp").alias("seen_at"))
    dedup = files.withWatermark("seen_at", "1 day").dropDuplicatesWithinWatermark(["job_id", "file_path"])
    return drained(dedup, name)


# --------------------------------------------------------------------- K4-K6
def _events(spark, folder, max_files=None):
    return with_event_time(source(spark, folder, "events", max_files).select(
        "event_id", "ts", F.col("user_id").alias("job_id"), "event_type", "value"))


def _ntz(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stream_per_hour(spark: SparkSession, folder: str, name: str = "tessera_stream_hour",
                    max_files: int | None = None) -> DataFrame:
    """K4: tumbling hourly throughput (the last value of every window)."""
    e = _events(spark, folder, max_files).withWatermark("ts", "1 hour")
    agg = e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"),
                                                              F.sum("value").alias("value"))
    return latest(agg.select("w.start", "events", "value"), name, ["start"]).select(
        _ntz("start").alias("window_start"), "events", F.round("value", 6).alias("value"))


def stream_sliding(spark: SparkSession, folder: str, name: str = "tessera_stream_sliding",
                   max_files: int | None = None) -> DataFrame:
    """K5: 30-minute windows sliding every 5 minutes."""
    e = _events(spark, folder, max_files).withWatermark("ts", "1 hour")
    agg = e.groupBy(F.window("ts", "30 minutes", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return latest(agg.select("w.start", "events"), name, ["start"]).select(_ntz("start").alias("window_start"), "events")


def stream_sessions(spark: SparkSession, folder: str, gap: str = "2 hours",
                    name: str = "tessera_stream_sessions", max_files: int | None = None) -> DataFrame:
    """K6: activity sessions per job: a gap longer than ``gap`` closes one.
    A session is written once the watermark (an hour) has passed its end."""
    e = _events(spark, folder, max_files).withWatermark("ts", "1 hour")
    agg = e.groupBy("job_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return drained(agg, name).select("job_id", _ntz("s.start").alias("session_start"),
                                     _ntz("s.end").alias("session_end"), "events")


# --------------------------------------------------------------------- K7
def stalled_items(starts: DataFrame, ends: DataFrame, timeout: str = "300 seconds",
                  delay: str = "10 minutes") -> DataFrame:
    """K7 core: ``starts(file_id, started)`` without ``ends(file_id, ended)``
    from the start to ``timeout`` after it.

    A stream-stream left outer join on the file and the interval: a start is
    given out, once, when the watermark has passed its deadline, whatever the
    micro-batches are; an end before its start, a repeated start or an end
    after the deadline need no care of their own."""
    s = starts.withWatermark("started", delay).alias("s")
    e = ends.withWatermark("ended", delay).alias("e")
    within = F.expr(f"s.file_id = e.file_id AND ended >= started AND ended <= started + INTERVAL {timeout}")
    return s.join(e, within, "leftOuter").where("e.file_id IS NULL").select(
        F.col("s.file_id"), "started", F.lit("timeout").alias("reason"))


def stream_stalled(spark: SparkSession, folder: str, name: str = "tessera_stream_stalled",
                   max_files: int | None = None) -> DataFrame:
    """K7: files that started but did not finish within 300 s of event time."""
    def orders():
        return source(spark, folder, "orders", max_files)
    key, began = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    starts = orders().select(key.alias("file_id"), began.alias("started"))
    ends = orders().where("o_orderstatus != 'P' OR o_orderkey % 2 = 0").select(
        key.alias("file_id"), F.timestamp_add("SECOND", key % 3600, began).alias("ended"))
    return drained(stalled_items(starts, ends), name)


# --------------------------------------------------------------------- K8
def drop_late(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """K8 core: events without those behind the watermark, row by row."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def stream_late(spark: SparkSession, folder: str, name: str = "tessera_stream_late", progress: "ProgressLog | None" = None) -> DataFrame:
    """K8: a tenth of the events arrives after the others, when these have
    been taken and have left their watermark; those behind it are dropped, and
    counted per hour as what came in less what was kept.  Each part is written
    by all tasks and drained before the next one comes; the checkpoint stays."""
    base = scratch_path(spark, f"streams/{name}-{_run_tag()}")
    landing, name = f"{base}/landing", f"{name}-{_run_tag()}"
    e = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").select("event_id", "ts", "value")
    for i, part in enumerate(("!= 0", "= 0")):
        e.where(f"event_id % 10 {part}").write.parquet(f"{landing}/events{i}")
        stream = with_event_time(spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(landing))
        if progress is not None:
            stream = progress.observed(stream, "ts")
        kept = drained(drop_late(stream), name, fresh=False)
    kept = kept.groupBy(F.date_trunc("hour", "ts").alias("w")).agg(F.count("*").alias("kept"))
    seen = with_event_time(spark.read.schema(e.schema).option("recursiveFileLookup", True).parquet(landing)).groupBy(
        F.date_trunc("hour", "ts").alias("w")).agg(F.count("*").alias("seen"))
    return seen.join(kept, "w", "left").select(
        _ntz("w").alias("window_start"), F.coalesce("kept", F.lit(0)).alias("events"),
        (F.col("seen") - F.coalesce("kept", F.lit(0))).alias("late"))


# --------------------------------------------------------------------- K9
def stream_rates(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """K9: sample rates per job on a stream; each micro-batch computes lags
    within the batch plus the last sample carried from the batches before.

    Rates and carried samples stand in a folder of their batch, which a
    replay overwrites with the same rows."""
    from ..operators.timeseries import sample_rates
    base = scratch_path(spark, "streams/rates-" + _run_tag())
    e = source(spark, folder, "events", max_files).select("event_id", "ts", F.col("user_id").alias("job_id"), "value")
    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("event_id", "ts", "job_id", "value")
        prior = (spark.read.schema(e.schema).parquet(f"{base}/last/batch_id={batch_id - 1}") if batch_id
                 else spark.createDataFrame([], e.schema))
        cur = new.unionByName(prior)
        rates = sample_rates(cur, "job_id", "ts", "value").join(prior.select("event_id"), "event_id", "left_anti")
        rates.write.mode("overwrite").parquet(f"{base}/rates/batch_id={batch_id}")
        last = cur.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
        last.select("m.event_id", "m.ts", "job_id", "m.value").write.mode("overwrite").parquet(
            f"{base}/last/batch_id={batch_id}")

    run_available(e, "tessera_stream_rates", foreach_batch=write)
    schema = sample_rates(spark.createDataFrame([], e.schema), "job_id", "ts", "value").schema
    return _written(spark, f"{base}/rates", schema)


# --------------------------------------------------------------------- K10
class ProgressLog:
    """What streams report about themselves, as a table.

    A StreamingQueryListener writes each batch's progress as one small file
    (named by run and batch, so a repeated report replaces itself); nothing is
    kept in memory.  :meth:`observed` adds counters that the batch itself
    computes while it runs; rows that the watermark has dropped come from the
    stateful operators' own count.
    """

    SCHEMA = ("run string, name string, batch long, rows long, rows_per_second double, watermark string, "
              "late_rows long, state_rows long, observed map<string,string>")

    def __init__(self, spark: SparkSession, folder: str | None = None):
        import json
        import threading

        from pyspark.sql.streaming import StreamingQueryListener

        outer = self
        self.spark = spark
        self.folder = (folder or scratch_path(spark, f"streams/progress-{_run_tag()}")).rstrip("/")
        self._ended = threading.Condition()
        self._open: set[str] = set()

        class _L(StreamingQueryListener):
            def onQueryStarted(self, event):
                with outer._ended:
                    outer._open.add(str(event.runId))

            def onQueryProgress(self, event):
                p = json.loads(event.progress.json)
                seen = (p.get("observedMetrics") or {}).get("seen") or {}
                operators = p.get("stateOperators") or []
                outer._write({
                    "run": p["runId"], "name": p.get("name"), "batch": p["batchId"], "rows": p.get("numInputRows"),
                    "rows_per_second": p.get("processedRowsPerSecond"), "watermark": (p.get("eventTime") or {}).get("watermark"),
                    "late_rows": sum(o.get("numRowsDroppedByWatermark", 0) for o in operators),
                    "state_rows": sum(o.get("numRowsTotal", 0) for o in operators),
                    "observed": {k: None if v is None else str(v) for k, v in seen.items()}})

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                with outer._ended:
                    outer._open.discard(str(event.runId))
                    outer._ended.notify_all()

        self.listener = _L()
        spark.streams.addListener(self.listener)

    def _write(self, row: dict) -> None:
        import json
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{row['run']}-{row['batch']:010d}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def observed(self, df: DataFrame, event_time: str) -> DataFrame:
        """The stream with counters of its batches: rows, earliest and latest
        event (read from the progress, at no extra job)."""
        return df.observe("seen", F.count("*").alias("rows"), F.date_format(F.min(event_time), "yyyy-MM-dd HH:mm:ss").alias("first"),
                          F.date_format(F.max(event_time), "yyyy-MM-dd HH:mm:ss").alias("last"))

    def table(self, wait: float = 30.0) -> DataFrame:
        """All batches reported so far; waits for the reports of queries that
        have just ended."""
        with self._ended:
            self._ended.wait_for(lambda: not self._open, wait)
        return self.spark.read.schema(self.SCHEMA).json(self.folder)

    def close(self) -> None:
        self.spark.streams.removeListener(self.listener)


def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The late-rows stream's account of itself: per drained part its
    rows, earliest and latest event, and the rows its watermark has dropped."""
    log = ProgressLog(spark)
    try:
        stream_late(spark, folder, progress=log)
        rows = log.table()
    finally:
        log.close()
    return rows.where("rows > 0").select("rows", F.col("observed")["first"].alias("first_event"),
                                         F.col("observed")["last"].alias("last_event"),
                                         F.col("observed")["rows"].cast("long").alias("observed_rows"), "late_rows")
