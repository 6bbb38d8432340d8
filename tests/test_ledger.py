"""Ledger transitions and triage on the reference's golden fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import errors as E
from tessera.operators import ledger as L

T0 = dt.datetime(2025, 1, 1, 12, 0, 0)
T1 = dt.datetime(2025, 1, 1, 12, 1, 0)
FILES = "file_id long, job_id long, file_path string, file_size long, status string, error_message string, " \
        "process_start timestamp, process_end timestamp"


def _retry_fixture(spark):
    rows = [(1, 1, "/path/to/normal.txt", 1000), (2, 1, "/path/to/small.txt", 50),
            (3, 1, "/path/to/~$temp.docx", 1000), (4, 1, "/path/to/another.pdf", 2000),
            (5, 1, "/path/to/zero.txt", 0)]
    return spark.createDataFrame([(i, j, p, s, "error", "Test error", T0, T1) for i, j, p, s in rows], FILES)


def test_retry_default(spark):
    out = {r.file_id: r for r in L.retry_errors(_retry_fixture(spark)).collect()}
    assert sorted(i for i, r in out.items() if r.status == "pending") == [1, 4]
    for i in (1, 4):
        assert out[i].process_start is None and out[i].process_end is None and out[i].error_message is None
    counters = L.job_counters(L.retry_errors(_retry_fixture(spark))).first()
    assert counters.error_files == 3


def test_retry_min_size_10(spark):
    out = L.retry_errors(_retry_fixture(spark), min_size=10).where("status = 'pending'").collect()
    assert sorted(r.file_id for r in out) == [1, 2, 4]


def test_retry_null_size_excluded(spark):
    df = spark.createDataFrame([(9, 1, "/p/x.txt", None, "error", "e", T0, T1)], FILES)
    assert L.retry_errors(df).first().status == "error"


def test_error_cascade(spark):
    rows = [(1, "/path/to/~$temp.docx", 1000, "Temporary file error"),
            (2, "/path/to/empty.pdf", 0, "Empty file or zero bytes"),
            (3, "/path/to/missing.txt", 1000, "File not found at path"),
            (4, "/path/to/noaccess.xlsx", 2000, "Permission denied"),
            (5, "/path/to/corrupt.docx", 3000, "Invalid format or corrupt file"),
            (6, "/a/t.pdf", 10, "Tika timeout"), (7, "/a/o.png", 10, "tesseract failed"),
            (8, "/a/x.pdf", 10, "Processing timeout (exceeded 5 minutes)"), (9, "/a/e.pdf", 10, "could not extract"),
            (10, "/a/b.pdf", 10, "boom"), (11, "/a/n.pdf", None, "whatever")]
    df = spark.createDataFrame([(i, 1, p, s, "error", m, T0, T1) for i, p, s, m in rows], FILES)
    got = {r.file_id: r.category for r in E.categorised(df).collect()}
    assert got == {1: "temp_files", 2: "empty_files", 3: "missing_files", 4: "permission_errors", 5: "format_errors",
                   6: "tika_errors", 7: "ocr_errors", 8: "timeout_errors", 9: "extraction_errors", 10: "other",
                   11: "empty_files"}
    five = df.where(F.col("file_id") <= 5)
    shares = {r.name: (r["count"], r.percentage) for r in E.category_counts(five).collect()}
    assert shares == {"Temp Files": (1, 20.0), "Empty Files": (1, 20.0), "Missing Files": (1, 20.0),
                      "Permission Errors": (1, 20.0), "Format Errors": (1, 20.0)}


def test_routing(spark):
    df = spark.createDataFrame([("a.txt",), ("b.jpg",), ("c.pdf",), ("d.xyz",), ("E.PDF",)], "p string")
    got = [(r.p, r.route, r.forced) for r in df.select(
        "p", L.extract_route(F.col("p")).alias("route"), L.extract_route(F.col("p"), True).alias("forced")).collect()]
    assert got == [("a.txt", "tika", "ocr"), ("b.jpg", "ocr", "ocr"), ("c.pdf", "tika_with_ocr_fallback", "ocr"),
                   ("d.xyz", None, None), ("E.PDF", "tika_with_ocr_fallback", "ocr")]


def test_file_type_like_splitext(spark):
    paths = ["/a/b.TXT", "/a/.bashrc", "/a/noext", "/a/x.tar.gz", "/a/y.", "/a.b/c", "/a/..z"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.t for r in df.select(L.file_type(F.col("p")).alias("t")).collect()]
    import os
    assert got == [os.path.splitext(p)[1].lower() for p in paths]


def test_scan_is_idempotent(spark):
    listing = spark.createDataFrame([(1, f"/d/f{i}{e}") for i, e in enumerate([".txt", ".pdf", ".docx"] * 3)],
                                    "job_id long, file_path string")
    empty = listing.limit(0)
    first = L.register_new(listing, empty)
    assert first.count() == 9
    assert L.register_new(listing, first).count() == 0


def test_interrupt_leaves_no_processing(spark):
    jobs = spark.createDataFrame([(1, "running"), (2, "completed")], "job_id long, status string")
    files = spark.createDataFrame([(i, 1 + i % 2, f"/f{i}", 10, "processing", None, T0, None) for i in range(6)],
                                  FILES)
    j, f = L.interrupt_job(jobs, files, 1)
    assert f.where("job_id = 1 AND status = 'processing'").count() == 0
    assert f.where("job_id = 2 AND status = 'processing'").count() == 3
    assert {r.job_id: r.status for r in j.collect()} == {1: "interrupted", 2: "completed"}


def test_current_state_matches_table(spark):
    files = spark.createDataFrame([(1, 1, "/a", 1, "pending", None, None, None),
                                   (2, 1, "/b", 1, "processing", None, T0, None),
                                   (3, 1, "/c", 1, "completed", None, T0, T1),
                                   (4, 1, "/d", 1, "error", "boom", T0, T1)], FILES)
    st = {r.file_id: (r.status, r.error_message) for r in L.current_state(L.transition_log(files)).collect()}
    assert st == {1: ("pending", None), 2: ("processing", None), 3: ("completed", None), 4: ("error", "boom")}


def test_resumption_point_normalises(spark):
    jobs = spark.createDataFrame([(1, "running", T0), (2, "completed", T1)], "job_id long, status string, start_time timestamp")
    meta = spark.createDataFrame([(1, "directory", "/data/x/"), (2, "directory", "/data//x")],
                                 "job_id long, key string, value string")
    assert [r.job_id for r in L.resumption_point(jobs, meta, "/data/x").collect()] == [1]
    assert [r.job_id for r in L.resumption_point(jobs, meta, "/data/x", force=True).collect()] == [2]
