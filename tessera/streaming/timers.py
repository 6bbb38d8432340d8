"""Keyed state with event-time timers (K7): files that start and do not end.

The interval join of :mod:`tessera.streaming.streams` knows a start's deadline
from the start alone.  Here a file's later events move it: a repeated start
resets the deadline, an end closes the run, a start after an end opens the
next one.  State is kept by bucket of files, as calls to the state store cost
more than the rows: a bucket's open runs, and the events that the watermark
has not passed, as packed rows; one timer wakes it at the earliest of their
times, and all its files are replayed at once.  Events are taken in the order
of their time and only up to the watermark, so the rows do not depend on how
the input was cut into batches.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import streams as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS = 1_000_000
#: buckets of files; a checkpoint belongs to one number of them
BUCKETS = 4096
_EVENT = np.dtype([("file_id", "<i8"), ("at", "<i8"), ("rank", "i1")])
_RUN = np.dtype([("file_id", "<i8"), ("at", "<i8"), ("starts", "<i4")])


def replayed(runs: np.ndarray, due: np.ndarray, timeout: int, passed: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that have timed out and runs still open at the time ``passed``,
    after the open ``runs`` of some files and their events up to that time."""
    file = np.concatenate((runs["file_id"], due["file_id"]))
    at = np.concatenate((runs["at"], due["at"]))
    rank = np.concatenate((np.full(len(runs), -1, np.int8), due["rank"]))
    starts = np.concatenate((runs["starts"], due["rank"])).astype(np.int64)  # an end counts none
    order = np.lexsort((rank, at, rank >= 0, file))  # an open run comes before its file's events
    file, at, start, starts = file[order], at[order], rank[order] != 0, starts[order]
    # an event in time closes the run before it, or, if it is a start, goes on with it
    in_time = (file[1:] == file[:-1]) & (at[1:] - at[:-1] <= timeout)
    head = start.copy()
    head[1:] &= ~(in_time & start[:-1])
    last = start.copy()
    last[:-1] &= ~in_time
    total = np.cumsum(starts)
    before = np.maximum.accumulate(np.where(head, total - starts, 0)) if len(total) else total
    out = np.empty(len(at), _RUN)
    out["file_id"], out["at"], out["starts"] = file, at, total - before
    gone = at + timeout < passed
    return out[last & gone], out[last & ~gone]


class Watch(StatefulProcessor):
    """Timeouts of the files of one bucket after another; times are microseconds."""

    def __init__(self, timeout: int):
        self.timeout = timeout * _MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int, known: int | None) -> None:
        """One timer, at ``at`` or the earlier time that is ``known``."""
        if known is not None and known <= at // 1000:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at // 1000)
        self.timer.update((at // 1000,))

    def handleInputRows(self, key, rows, timerValues):
        least = None
        for part in rows:
            events = np.empty(len(part), _EVENT)
            for c in _EVENT.names:
                events[c] = part[c].to_numpy()
            if len(events):
                self.waiting.appendValue((events.tobytes(),))
                first = int(events["at"].min())
                least = first if least is None else min(least, first)
        if least is not None:
            self._wake(least, self.timer.get()[0] if self.timer.exists() else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a timer has whole milliseconds: it may ring up to one too early
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = b"".join(bytes(r[0]) for r in self.waiting.get()) if self.waiting.exists() else b""
        events = np.frombuffer(held, _EVENT)
        is_due = events["at"] <= passed
        due, later = events[is_due], events[~is_due]
        runs = np.frombuffer(bytes(self.runs.get()[0]) if self.runs.exists() else b"", _RUN)
        out, still = replayed(runs, due, self.timeout, passed)
        if len(due):
            if len(later):
                self.waiting.put([(later.tobytes(),)])
            else:
                self.waiting.clear()
        if len(still):
            self.runs.update((still.tobytes(),))
        else:
            self.runs.clear()
        # one millisecond more, for a deadline has to lie before the watermark
        ahead = [int(later["at"].min())] if len(later) else []
        ahead += [int(still["at"].min()) + self.timeout + 1000] if len(still) else []
        self.timer.clear()
        if ahead:
            self._wake(max(min(ahead), passed + 1000), None)
        if len(out):
            yield pd.DataFrame({c: out[c] for c in _RUN.names})

    def close(self) -> None:
        pass


def watched_items(events: DataFrame, timeout: int = 300, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """``events(file_id, at, kind)`` with kind 'start' or 'end' (others are
    ignored) to one row per run that has not ended ``timeout`` seconds after
    its last start: that start, its deadline, and how many starts the run had.

    Of events of one time an end counts before a start; an end without an open
    run, or after its deadline, changes nothing.  A run is given out once the
    watermark (``delay`` behind the newest event) has passed its deadline;
    events that come behind the watermark are dropped.
    """
    rank = F.when(F.col("kind") == "end", 0).when(F.col("kind") == "start", 1)
    e = events.withColumn("rank", rank).where("rank IS NOT NULL AND file_id IS NOT NULL AND at IS NOT NULL")
    e = e.select("file_id", "rank", F.col("at").cast("timestamp").alias("time"))
    e = e.withWatermark("time", delay).withColumn("at", F.unix_micros("time"))
    e = e.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)))
    runs = e.groupBy("bucket").transformWithStateInPandas(
        Watch(timeout), "file_id long, at long, starts int", "Append", "EventTime")
    return runs.select("file_id", F.timestamp_micros("at").alias("started"),
                       F.timestamp_micros(F.col("at") + timeout * _MICROS).alias("deadline"), "starts",
                       F.lit("timeout").alias("reason"))


def with_timers(spark: SparkSession, run):
    """``run()`` while the session's streams keep their state where timers
    can be kept."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stream_watch(spark: SparkSession, folder: str, name: str = "tessera_stream_watch", max_files: int | None = None) -> DataFrame:
    """K7 with repeated starts: every order starts, every fifth starts again
    200 s later, most end."""
    o = S.source(spark, folder, "orders", max_files)
    began, key = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")

    def event(kind, seconds, when):
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.timestamp_add("SECOND", seconds, began).alias("at")))
    events = F.array(event("start", F.lit(0), F.lit(True)), event("start", F.lit(200), key % 5 == 0),
                     event("end", key % 900, (F.col("o_orderstatus") != "P") | (key % 2 == 0)))
    rows = o.select(key.alias("file_id"), F.explode(F.array_compact(events)).alias("e")).select("file_id", "e.at", "e.kind")
    return with_timers(spark, lambda: S.drained(watched_items(rows), name))
