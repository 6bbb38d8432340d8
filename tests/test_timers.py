"""Runs that time out, by keyed state, against a replay; the same rows however the input is cut."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.streaming import streams as S
from tessera.streaming import timers as W

T0 = dt.datetime(2024, 1, 1)


def replay(events, timeout, delay):
    mark = max(a for _, a, _ in events) - delay
    out = []
    for key in sorted({f for f, _, _ in events}):
        run = None
        for at, kind in sorted((a, k) for f, a, k in events if f == key and a <= mark):
            if run and run[0] + timeout < at:
                out.append((key, *run))
                run = None
            run = None if kind == "end" else (at, 1 if run is None else run[1] + 1)
        if run and run[0] + timeout < mark:
            out.append((key, *run))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_same_rows_for_any_batches(spark, tmp_path, batches):
    r = random.Random(7)
    events = []
    for f in range(40):
        at = r.randint(0, 3000)
        for _ in range(r.randint(1, 8)):
            events.append((f, at, r.choice(["start", "start", "end"])))
            at += r.choice([0, 50, 200, 300, 301, 700])
    events.append((99, 6000, "end"))
    # files come in order of time, with disorder within the delay
    order = sorted(events, key=lambda e: e[1] + r.uniform(-250, 250))
    cuts = [len(order) * i // batches for i in range(batches + 1)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = order[a:b]
        pq.write_table(pa.table({"file_id": pa.array([e[0] for e in part], pa.int64()),
                                 "at": pa.array([T0 + dt.timedelta(seconds=e[1]) for e in part], pa.timestamp("us")),
                                 "kind": [e[2] for e in part]}), f"{tmp_path}/log{i:02d}.parquet" if i else f"{tmp_path}/log.parquet")
        import os
        os.utime(f"{tmp_path}/log{i:02d}.parquet" if i else f"{tmp_path}/log.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    rows = S.source(spark, str(tmp_path), "log", max_files=1)
    got = W.with_timers(spark, lambda: S.drained(W.watched_items(rows, 300, "600 seconds"), "watch")).collect()
    seconds = sorted((x.file_id, int((x.started - T0).total_seconds()), x.starts) for x in got)
    assert seconds == replay(events, 300, 600)
    assert all((x.deadline - x.started).total_seconds() == 300 and x.reason == "timeout" for x in got)


def test_state_by_bucket(spark, tmp_path):
    """What the store holds and what it is asked for go by buckets, not by files."""
    r = random.Random(3)
    events = [(f, r.choice([0, 100, 300, 301, 650, 900]) + f % 50, r.choice(["start", "start", "end"]))
              for f in range(3000) for _ in range(3)] + [(-1, 5000, "end")]
    pq.write_table(pa.table({"file_id": pa.array([e[0] for e in events], pa.int64()),
                             "at": pa.array([T0 + dt.timedelta(seconds=e[1]) for e in events], pa.timestamp("us")),
                             "kind": [e[2] for e in events]}), f"{tmp_path}/log.parquet")
    log = S.ProgressLog(spark, f"{tmp_path}/progress")
    try:
        rows = W.watched_items(S.source(spark, str(tmp_path), "log"), 300, "600 seconds", buckets=8)
        got = W.with_timers(spark, lambda: S.drained(rows, "watch")).collect()
        held = log.table().agg({"state_rows": "max"}).first()[0]
    finally:
        log.close()
    assert sorted((x.file_id, int((x.started - T0).total_seconds()), x.starts) for x in got) == replay(events, 300, 600)
    assert 0 < held <= 8 * 8
