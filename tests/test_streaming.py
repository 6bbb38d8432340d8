"""K1 resumable scan and K3 register-once dedup on files written by the test."""

import datetime as dt
import uuid

import pyarrow as pa
import pyarrow.parquet as pq

from tessera.streaming import streams as S


def test_resumable_scan_processes_only_new_files(spark, tmp_path):
    folder = str(tmp_path)
    pq.write_table(pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": ["mail a@b.org", "nothing"]}),
                   folder + "/documents.parquet")
    name = "resume_" + uuid.uuid4().hex[:8]
    first = sorted(r.doc_id for r in S.stream_detect(spark, folder, name=name, fresh=False).collect())
    assert first == [1]
    pq.write_table(pa.table({"doc_id": pa.array([3, 4], pa.int64()), "text": ["call 555-123-4567", "c@d.net"]}),
                   folder + "/documents-2.parquet")
    # the appended table holds each document once: the first file was not read again
    both = sorted(r.doc_id for r in S.stream_detect(spark, folder, name=name, fresh=False).collect())
    assert both == [1, 3, 4]


def test_dedup_drops_repeats_within_watermark(spark, tmp_path):
    folder = str(tmp_path)
    t = pa.table({
        "o_orderkey": pa.array([1, 1, 2], pa.int64()), "o_custkey": pa.array([10, 10, 11], pa.int64()),
        "o_orderstatus": ["O", "O", "F"], "o_totalprice": [1.0, 1.0, 2.0],
        "o_orderdate": pa.array([dt.datetime(1996, 1, 1), dt.datetime(1996, 1, 1, 1), dt.datetime(1996, 1, 2)],
                                pa.timestamp("us")),
        "o_orderpriority": ["1-URGENT", "1-URGENT", "2-HIGH"]})
    pq.write_table(t, folder + "/orders.parquet")
    out = S.stream_dedup(spark, folder, name="dedup_" + uuid.uuid4().hex[:8]).collect()
    assert sorted((r.job_id, r.file_path) for r in out) == [(2, "/corpus/job2/d1/f1"), (3, "/corpus/job3/d2/f2")]


def test_progress_is_a_table(spark, tmp_path):
    """Every batch is reported once, with observed counters and late rows."""
    base = dt.datetime(2024, 1, 1)
    hours = [*range(40), *range(40)]
    pq.write_table(pa.table({"event_id": pa.array(range(1, 81), pa.int64()),
                             "ts": pa.array([base + dt.timedelta(hours=h) for h in hours], pa.timestamp("us")),
                             "user_id": pa.array([1] * 80, pa.int64()), "event_type": ["x"] * 80, "value": [1.0] * 80}),
                   f"{tmp_path}/events.parquet")
    log = S.ProgressLog(spark, f"{tmp_path}/progress")
    try:
        per_hour = S.stream_late(spark, str(tmp_path), progress=log).collect()
        rows = [r for r in log.table().collect() if r.rows]
    finally:
        log.close()
    assert sorted((r.rows, r.late_rows, r.observed["rows"]) for r in rows) == [(8, 6, "8"), (72, 0, "72")]
    assert sum(r.late for r in per_hour) == 6 and sum(r.events for r in per_hour) == 74
    again = S.ProgressLog(spark, f"{tmp_path}/progress")  # the table outlives the listener
    again.close()
    assert again.table().count() >= 2


def test_table_of_part_files(spark, tmp_path):
    """A table may be a folder of part files: the stream reads them all."""
    import os
    os.mkdir(f"{tmp_path}/documents.parquet")
    texts = [["mail a@b.org", "nothing"], ["c@d.net and e@f.com"]]
    for i, part in enumerate(texts):
        pq.write_table(pa.table({"doc_id": pa.array([10 * i + j for j in range(len(part))], pa.int64()), "text": part}),
                       f"{tmp_path}/documents.parquet/part-{i}.parquet")
    rows = S.stream_sink(spark, str(tmp_path)).collect()
    assert sorted((r.result_id, r.entity_type, r.text) for r in rows) == [
        (0, "EMAIL_ADDRESS", "a@b.org"), (10, "EMAIL_ADDRESS", "c@d.net"), (10, "EMAIL_ADDRESS", "e@f.com")]
    assert sorted(r.doc_id for r in S.stream_detect(spark, str(tmp_path)).collect()) == [0, 10, 10]


def test_no_rows_give_no_rows(spark, tmp_path):
    """A sink without a span, or without any batch, is an empty table."""
    pq.write_table(pa.table({"doc_id": pa.array([1], pa.int64()), "text": ["nothing"]}), f"{tmp_path}/documents.parquet")
    one = S.stream_sink(spark, str(tmp_path))
    other = tmp_path / "empty"
    other.mkdir()
    (other / "documents.parquet").mkdir()
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}),
                   f"{other}/documents.parquet/part-0.parquet")
    none = S.stream_sink(spark, str(other))
    assert one.count() == none.count() == 0
    assert one.columns == none.columns == ["result_id", "entity_type", "start", "end", "score", "text", "batch_id"]
