"""Simple report, dashboard page, gates, job rows, full reset, scan settings."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tessera.functions.plugins import ScanSettings
from tessera.operators import anonymize as A
from tessera.operators import dashboard as DB
from tessera.operators import ledger as L
from tessera.operators import summary as SM

T0 = dt.datetime(2024, 1, 1)
JOBS = ("job_id long, name string, start_time timestamp_ntz, last_updated timestamp_ntz, status string, command_line string, "
        "total_files long, processed_files long, error_files long, settings string")
FILES = ("file_id long, job_id long, file_path string, file_type string, file_size long, status string, error_message string, "
         "process_start timestamp_ntz, process_end timestamp_ntz, processing_time double")
RESULTS = "result_id long, file_id long, processing_time double, metadata string"
ENTITIES = "result_id long, file_id long, entity_type string, start_index int, end_index int, score double, text string"


def ledger(spark, files=(), entities=(), jobs=((1, "old", T0, T0, "completed", None, 0, 0, 0, None),)):
    r = [(f[0], f[0], 1.0, "{}") for f in files if f[5] == "completed"]
    return (spark.createDataFrame(list(jobs), JOBS), spark.createDataFrame(list(files), FILES),
            spark.createDataFrame(r, RESULTS), spark.createDataFrame(list(entities), ENTITIES))


def file(i, status="completed", kind=".txt", job=1):
    return (i, job, f"/c/f{i}{kind}", kind, 1000 * i, status, None, T0, T0, 1.0)


def test_simple_report(spark):
    e = [(1, 1, "US_SSN", 10 * i, 10 * i + 9, 0.9, f"123-45-678{i}") for i in range(4)] + [
        (1, 1, "CREDIT_CARD", 99, 120, 0.95, "4111111111111111"), (2, 2, "US_SSN", 0, 9, 0.85, "987-65-4321"),
        (3, 3, "NOT_IN_POLICY", 0, 3, 0.99, "abc")]
    rows = spark.createDataFrame([(r[0], r[1], 1, f"/c/f{r[1]}", ".txt", *r[2:]) for r in e],
                                 "result_id long, file_id long, job_id long, file_path string, file_type string, "
                                 "entity_type string, start_index int, end_index int, score double, text string")
    lines = [r.line for r in SM.simple_report_lines(rows).orderBy("file_rank", "ord").collect()]
    assert lines[:2] == [SM.SIMPLE_TITLE, ""]
    assert lines[2:4] == ["File: /c/f1", "Number of sensitive entities: 5"] and lines.count("-" * 80) == 2
    first = lines[2:lines.index("-" * 80)]
    assert sum(x.startswith("    - ") for x in first) == 4  # three of four numbers, one card
    assert "4111111111111111" not in "".join(lines) and any("(confidence: 0.95)" in x for x in first)
    assert "Number of sensitive entities: 1" in lines and not any("f3" in x for x in lines)


def test_page_of_a_job(spark):
    jobs = ((1, "old", T0, T0, "completed", None, 0, 0, 0, None),
            (2, "new", T0, T0 + dt.timedelta(hours=2), "running", None, 0, 0, 0, None))
    files = [file(i, s, k, 2) for i, (s, k) in enumerate([("completed", ".txt"), ("completed", ".pdf"), ("pending", ".txt"),
                                                          ("error", ".txt"), ("processing", "")], 1)] + [file(9, job=1)]
    ents = [(1, 1, "PERSON", 0, 4, 0.9, "John Roe"), (1, 1, "US_SSN", 9, 20, 0.9, "123-45-6789"), (2, 2, "PERSON", 0, 4, 0.9, "Jane"),
            (2, 2, "US_SSN", 0, 4, 0.5, "low"), (9, 9, "PERSON", 0, 1, 0.9, "x")]
    page = DB.job_page(*ledger(spark, files, ents, jobs)).orderBy("section", "place").collect()
    got = {(r.section, r.name): r.value for r in page}
    assert got["job", "id"] == "2" and got["processing", "total_files"] == "5" and got["processing", "progress_percent"] == "60.0"
    assert got["processing", "error_rate"] == "20.0" and got["time", "elapsed"] == "2:00:00"
    assert got["time", "estimated_completion"] == "1 hour" and got["file_type", ".txt"] == "3"
    assert got["entity_type", "PERSON"] == "2" and got["high_risk", "count"] == "1" and got["high_risk", "has_more"] == "false"
    assert [r.name for r in page if r.section == "high_risk_file"] == ["/c/f1.txt"]
    assert [r.label for r in page if r.section == "entity_type"][0] != "PERSON" or got["entity_type", "US_SSN"] == "1"
    older = {(r.section, r.name): r.value for r in DB.job_page(*ledger(spark, files, ents, jobs), job_id=1).collect()}
    assert older["processing", "total_files"] == "1" and older["entity_type", "PERSON"] == "1"


def test_empty_ledger_pages(spark):
    jobs, files, results, ents = ledger(spark)
    page = {(r.section, r.name): r.value for r in DB.job_page(jobs, files, results, ents).collect()}
    assert page["processing", "progress_percent"] == "0.0" and page["high_risk", "count"] == "0"
    r = results.withColumn("extraction_time", F.lit(1.0)).withColumn("analysis_time", F.lit(1.0))
    row = DB.run_summary(files, r, ents).first()
    assert (row.files_analyzed, row.total_entities, row.total_time, row.extraction_share) == (0, 0, 0.0, 0.0)


def test_gate_messages(spark):
    listed = spark.createDataFrame([("/a",), ("/b",), ("/c",), ("/d",)], "file_path string")
    found = spark.createDataFrame([("/b", 5, None), ("/c", 300 << 20, None), ("/d", 7, "denied")],
                                  "file_path string, file_size long, access_error string")
    got = {r.file_path: (r.checked_size, r.error_message, r.success) for r in L.file_gate(listed, found).collect()}
    assert got == {"/a": (0, "File not found: /a", False), "/b": (5, None, True),
                   "/c": (300 << 20, "File too large: 300.00MB (max 100MB)", False), "/d": (0, "File access error: denied", False)}


def test_new_jobs_and_a_full_reset(spark):
    jobs, files, results, ents = ledger(spark, [file(1), file(2, "error")], [(1, 1, "PERSON", 0, 1, 0.9, "x")])
    d = spark.createDataFrame([("/x/b",), ("/x/a",)], "directory string")
    new, meta = L.create_jobs(jobs, d, F.lit(T0), "scan", {"k": [1, 2]}, {"owner": "me"})
    rows = {r.job_id: r for r in new.collect()}
    assert [rows[i].name for i in (2, 3)] == ["PII Analysis - a", "PII Analysis - b"]
    assert rows[2].start_time == rows[2].last_updated == T0 and json.loads(rows[2].settings) == {"k": [1, 2]}
    assert rows[2].command_line == "scan" and rows[2].status == "created"
    assert sorted((r.job_id, r.key, r.value) for r in meta.collect()) == [
        (2, "directory", "/x/a"), (2, "owner", "me"), (3, "directory", "/x/b"), (3, "owner", "me")]
    assert L.create_jobs(jobs, d)[0].first().settings is None
    j, f, r, e = L.reset_everything(jobs, files, results, ents, F.lit(T0).cast("timestamp_ntz"))
    assert {x.status for x in f.collect()} == {"pending"} and r.count() == e.count() == 0
    assert [(x.status, x.processed_files, x.error_files) for x in j.collect()] == [("created", 0, 0)]
    assert j.schema.simpleString() == jobs.schema.simpleString()


def test_settings_choose_files_and_tiers(spark):
    texts = [("/a.txt", "ssn: 536-22-8726"), ("/b.TXT", "mail a@b.org"), ("/c.pdf", "ssn: 536-22-8726"), ("/d.txt", "nothing"),
             ("/e.txt", "ssn: 536-22-8726 " + "x" * 999), ("/f.txt", None)]
    df = spark.createDataFrame(texts, "file_path string, text string")
    s = ScanSettings(threshold=0.7, max_file_bytes=500, min_tier=1, extensions=["txt"])
    got = {r.file_path: (r.entity_count, r.tier) for r in A.scan_files(df, s).collect()}
    assert got["/a.txt"][0] == 1 and got["/a.txt"][1] >= 2 and set(got) <= {"/a.txt", "/b.TXT"}
    everything = {r.file_path for r in A.scan_files(df, ScanSettings(min_tier=0, extensions=None)).collect()}
    assert everything == {"/a.txt", "/b.TXT", "/c.pdf", "/d.txt", "/e.txt"}
