"""Ledger queries: predicates P1-P17, joins J2-J12, transitions L1-L11."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import ledger_store as LS
from ..operators.parallel import ranked
from ..session import scratch_path
from ..sources.tables import read_table
from ..functions.strings import strip, strip_sql
from . import oracle as O
from .registry import register
from .testbed import Testbed

AS_OF = "1999-01-01 00:00:00"

_FT = "lower(regexp_extract(regexp_extract({p}, '[^/]*$', 0), '^\\.*[^.].*(\\.[^.]*)$', 1))"


def _ft(p="file_path"):
    return _FT.format(p=p)


def _tb(spark, sf):
    return Testbed(spark, sf)


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@register("file_type", O.with_views(
    f"SELECT file_id, file_path, {_ft()} AS file_type, regexp_replace({_ft()}, '^\\.', '') AS extension FROM t_files",
    "t_files"))
def file_type(spark, sf):
    """Extension from the path (with and without the dot)."""
    f = _tb(spark, sf).files
    return f.select("file_id", "file_path", L.file_type(F.col("file_path")).alias("file_type"),
                    L.file_extension(F.col("file_path")).alias("extension"))


SUPPORTED_MIXED = ["pdf", ".docx", "txt", ".json"]


@register("supported_files", O.with_views(
    f"SELECT file_id, {_ft()} AS file_type FROM t_files WHERE {_ft()} IN ('.pdf', '.docx', '.txt', '.json')",
    "t_files"))
def supported_files(spark, sf):
    """Extension list given with and without dots."""
    f = _tb(spark, sf).files
    return f.where(L.is_supported(F.col("file_path"), SUPPORTED_MIXED)).select(
        "file_id", L.file_type(F.col("file_path")).alias("file_type"))


_METHOD_SQL = "CASE regexp_replace({ft}, '^\\.', '') " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in L.EXTRACTION_METHODS.items()) + " END"


def _route_sql(force: bool):
    m = _METHOD_SQL.format(ft=_ft())
    if force:
        return f"CASE WHEN ({m}) IS NULL THEN NULL ELSE 'ocr' END"
    return (f"CASE ({m}) WHEN 'tika' THEN 'tika' WHEN 'ocr' THEN 'ocr' "
            f"WHEN 'tika_or_ocr' THEN 'tika_with_ocr_fallback' END")


@register("extract_route", O.with_views(
    f"SELECT file_id, {_route_sql(False)} AS route, {_route_sql(True)} AS route_forced FROM t_files", "t_files"))
def extract_route(spark, sf):
    """Extractor per file; NULL marks the unsupported error side."""
    f = _tb(spark, sf).files
    p = F.col("file_path")
    return f.select("file_id", L.extract_route(p).alias("route"), L.extract_route(p, True).alias("route_forced"))


@register("needs_ocr", O.with_views(
    f"""SELECT f.file_id, lower(f.file_path) LIKE '%.pdf' AND coalesce(length({strip_sql('d.text')}) < 50, true) AS needs_ocr
       FROM t_files f LEFT JOIN documents d ON f.file_id = d.doc_id""", "t_files"))
def needs_ocr(spark, sf):
    """PDF whose extracted text (the document of the same id) is short."""
    f = _tb(spark, sf).files.select("file_id", "file_path")
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return f.join(d, "file_id", "left").select("file_id", L.needs_ocr(F.col("file_path"), F.col("text"))
                                               .alias("needs_ocr"))


@register("size_gate", O.with_views(
    """SELECT file_id, file_size, CASE WHEN file_size > 104857600
         THEN printf('File too large: %.2fMB (max 100MB)', file_size / 1048576.0) END AS error_message
       FROM t_files""", "t_files"))
def size_gate(spark, sf):
    """P5: rejection message for files above 100 MiB (NULL otherwise)."""
    f = _tb(spark, sf).files
    return f.select("file_id", "file_size", L.size_gate_message(F.col("file_size")).alias("error_message"))


@register("files_by_status", O.with_views(
    "SELECT file_id, status FROM t_files WHERE status IN ('pending', 'processing')", "t_files"))
def files_by_status(spark, sf):
    """Files in the open states."""
    return _tb(spark, sf).files.where(F.col("status").isin("pending", "processing")).select("file_id", "status")


@register("ext_subset", O.with_views(
    "SELECT file_id, file_path FROM t_files WHERE lower(file_path) LIKE '%.docx'", "t_files"))
def ext_subset(spark, sf):
    """P10: only .docx files."""
    return _tb(spark, sf).files.where(F.lower("file_path").endswith(".docx")).select("file_id", "file_path")


@register("temp_files", O.with_views(
    "SELECT file_id, file_path FROM t_files WHERE status = 'error' AND file_path LIKE '%/~$%'", "t_files"))
def temp_files(spark, sf):
    """Error rows of Office lock files (LIKE with a literal ~$)."""
    f = _tb(spark, sf).files
    return f.where((F.col("status") == "error") & L.is_temp(F.col("file_path"))).select("file_id", "file_path")


@register("small_files", O.with_views(
    "SELECT file_id, file_size FROM t_files WHERE status = 'error' AND (file_size IS NULL OR file_size <= 100)",
    "t_files"))
def small_files(spark, sf):
    """Error rows with NULL or small size."""
    f = _tb(spark, sf).files
    return f.where((F.col("status") == "error") & (F.col("file_size").isNull() | (F.col("file_size") <= 100))) \
        .select("file_id", "file_size")


@register("blank_guard", f"SELECT doc_id, length({strip_sql("coalesce(text, '')")}) = 0 AS is_blank FROM documents")
def blank_guard(spark, sf):
    """Blank or whitespace text gets no entities."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", (F.length(strip(F.coalesce(F.col("text"), F.lit("")))) == 0).alias("is_blank"))


@register("job_lookup", O.with_views(
    """SELECT j.job_id, j.name, j.status, j.total_files, m.value AS directory
       FROM t_jobs j LEFT JOIN t_job_metadata m ON j.job_id = m.job_id AND m.key = 'directory'
       WHERE j.job_id = 2""", "t_jobs", "t_job_metadata"))
def job_lookup(spark, sf):
    """One job by id, with its status and its directory metadata value."""
    tb = _tb(spark, sf)
    m = tb.job_metadata.where(F.col("key") == "directory").select("job_id", F.col("value").alias("directory"))
    return tb.jobs.where(F.col("job_id") == 2).join(m, "job_id", "left").select(
        "job_id", "name", "status", "total_files", "directory")


@register("rows_by_key", O.with_views(
    "SELECT file_id, file_path, status FROM t_files WHERE job_id = 1", "t_files"))
def rows_by_key(spark, sf):
    """The files of one job."""
    return _tb(spark, sf).files.where(F.col("job_id") == 1).select("file_id", "file_path", "status")


@register("resumption_point", O.with_views(
    """SELECT j.job_id, j.name, j.status FROM t_jobs j JOIN t_job_metadata m ON j.job_id = m.job_id
       WHERE m.key = 'directory' AND m.value = '/corpus/job2' AND j.status <> 'completed'
       ORDER BY j.start_time DESC, j.job_id DESC LIMIT 1""", "t_jobs", "t_job_metadata"))
def resumption_point(spark, sf):
    """Newest resumable job for a (normalised) directory."""
    tb = _tb(spark, sf)
    return L.resumption_point(tb.jobs, tb.job_metadata, "/corpus//x/../job2/./.").select("job_id", "name", "status")


@register("file_entity_types", O.with_views(
    """SELECT DISTINCT r.file_id, e.entity_type FROM t_entities e JOIN t_results r ON e.result_id = r.result_id""",
    "t_results", "t_entities"))
def file_entity_types(spark, sf):
    """Distinct entity types per file (entities ⨝ results)."""
    tb = _tb(spark, sf)
    return tb.entities.select("result_id", "entity_type").join(tb.results.select("result_id", "file_id"),
                                                               "result_id").select("file_id", "entity_type").distinct()


@register("join_res_file", O.with_views(
    """SELECT f.job_id, round(avg(r.processing_time), 6) AS avg_time, count(*) AS n
       FROM t_results r JOIN t_files f ON r.file_id = f.file_id WHERE f.status = 'completed' GROUP BY f.job_id""",
    "t_files", "t_results"))
def join_res_file(spark, sf):
    """Average processing time of completed files per job."""
    tb = _tb(spark, sf)
    j = tb.results.join(tb.files.where(F.col("status") == "completed").select("file_id", "job_id"), "file_id")
    return j.groupBy("job_id").agg(F.round(F.avg("processing_time"), 6).alias("avg_time"),
                                   F.count(F.lit(1)).alias("n"))


@register("files_left_results", O.with_views(
    "SELECT f.file_id, f.status, r.result_id FROM t_files f LEFT JOIN t_results r ON f.file_id = r.file_id",
    "t_files", "t_results"))
def files_left_results(spark, sf):
    """Every file, with its result when processed."""
    tb = _tb(spark, sf)
    return L.files_left_results(tb.files, tb.results).select("file_id", "status", "result_id")


@register("jobs_by_meta", O.with_views(
    """SELECT job_id, name FROM t_jobs WHERE job_id IN
         (SELECT job_id FROM t_job_metadata WHERE key = 'directory' AND value = '/corpus/job2')""",
    "t_jobs", "t_job_metadata"))
def jobs_by_meta(spark, sf):
    """Jobs whose metadata holds directory = /corpus/job2."""
    tb = _tb(spark, sf)
    return L.jobs_by_meta(tb.jobs, tb.job_metadata, "directory", "/corpus/job2").select("job_id", "name")


@register("jobs_with_meta", O.with_views(
    """SELECT j.job_id, j.name, d.value AS meta_directory, t.value AS meta_threshold, CAST(c.n AS INT) AS meta_keys
       FROM t_jobs j
       LEFT JOIN t_job_metadata d ON j.job_id = d.job_id AND d.key = 'directory'
       LEFT JOIN t_job_metadata t ON j.job_id = t.job_id AND t.key = 'threshold'
       LEFT JOIN (SELECT job_id, count(*) AS n FROM t_job_metadata GROUP BY job_id) c ON j.job_id = c.job_id""",
    "t_jobs", "t_job_metadata"))
def jobs_with_meta(spark, sf):
    """Metadata folded into one map column per job."""
    tb = _tb(spark, sf)
    j = L.jobs_with_meta(tb.jobs, tb.job_metadata)
    return j.select("job_id", "name", F.element_at("metadata", F.lit("directory")).alias("meta_directory"),
                    F.element_at("metadata", F.lit("threshold")).alias("meta_threshold"),
                    F.size("metadata").alias("meta_keys"))


@register("results_for_ids", O.with_views(
    """SELECT r.result_id, r.file_id, r.processing_time, count(e.result_id) AS entity_count
       FROM t_results r LEFT JOIN t_entities e ON r.result_id = e.result_id
       WHERE r.file_id IN (SELECT file_id FROM t_files WHERE job_id = 2 AND file_type = '.pdf')
       GROUP BY r.result_id, r.file_id, r.processing_time""", "t_files", "t_results", "t_entities"))
def results_for_ids(spark, sf):
    """Bulk fetch for an id set (a semi join, not an IN list) with the
    entity count of each result."""
    tb = _tb(spark, sf)
    ids = tb.files.where((F.col("job_id") == 2) & (F.col("file_type") == ".pdf")).select("file_id")
    r = tb.results.join(ids, "file_id", "left_semi")
    counts = tb.entities.join(r.select("result_id"), "result_id", "left_semi").groupBy("result_id").agg(
        F.count(F.lit(1)).alias("entity_count"))
    return r.join(counts, "result_id", "left").select(
        "result_id", "file_id", "processing_time", F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


@register("register_new", O.with_views(
    """SELECT job_id, file_path FROM t_files l WHERE NOT EXISTS (
         SELECT 1 FROM t_files e WHERE e.process_start < TIMESTAMP '1995-01-01 00:00:00'
           AND e.job_id = l.job_id AND e.file_path = l.file_path)""", "t_files"))
def register_new(spark, sf):
    """Listing ▷ ledger on (job_id, path): the files to register."""
    f = _tb(spark, sf).files
    existing = f.where(F.col("process_start") < F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))
    return L.register_new(f.select("job_id", "file_path"), existing)


@register("mark_missing", O.with_views(
    """SELECT file_id, 'error' AS status, 'File no longer exists' AS error_message FROM t_files l
       WHERE NOT EXISTS (SELECT 1 FROM t_files k WHERE k.status <> 'error' AND k.job_id = l.job_id
                         AND k.file_path = l.file_path)""", "t_files"))
def mark_missing(spark, sf):
    """Ledger files absent from the new listing become errors."""
    f = _tb(spark, sf).files
    listing = f.where(F.col("status") != "error").select("job_id", "file_path")
    return L.mark_missing(f, listing).select("file_id", "status", "error_message")


@register("jobs_pending", O.with_views(
    "SELECT job_id FROM t_jobs WHERE job_id IN (SELECT job_id FROM t_files WHERE status = 'pending')",
    "t_jobs", "t_files"))
def jobs_pending(spark, sf):
    """Jobs having any pending file (semi join)."""
    tb = _tb(spark, sf)
    return tb.jobs.join(tb.files.where(F.col("status") == "pending"), "job_id", "left_semi").select("job_id")


@register("clear_job", O.with_views(
    """SELECT 'files' AS table_name, count(*) AS row_count FROM t_files WHERE job_id <> 2
       UNION ALL SELECT 'results', count(*) FROM t_results r WHERE r.file_id NOT IN (SELECT file_id FROM t_files WHERE job_id = 2)
       UNION ALL SELECT 'entities', count(*) FROM t_entities e WHERE e.result_id NOT IN (
           SELECT result_id FROM t_results WHERE file_id IN (SELECT file_id FROM t_files WHERE job_id = 2))""",
    "t_files", "t_results", "t_entities"))
def clear_job(spark, sf):
    """Rows left in files/results/entities after clearing job 2."""
    tb = _tb(spark, sf)
    f, r, e = L.clear_job(tb.files, tb.results, tb.entities, 2)
    return L.table_counts({"files": f, "results": r, "entities": e})


@register("pending_batch", O.with_views(
    "SELECT file_id, file_path FROM t_files WHERE status = 'pending' ORDER BY file_id LIMIT 50", "t_files"))
def pending_batch(spark, sf):
    """Next batch of 50 pending files (ordered by id)."""
    return L.pending_batch(_tb(spark, sf).files, 50).select("file_id", "file_path")


@register("claim_batch", O.with_views(
    f"""SELECT f.file_id, CASE WHEN b.file_id IS NOT NULL THEN 'processing' ELSE f.status END AS status,
          CASE WHEN b.file_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE f.process_start END AS process_start
        FROM t_files f LEFT JOIN (SELECT file_id FROM t_files WHERE status = 'pending' ORDER BY file_id LIMIT 50) b
        ON f.file_id = b.file_id""", "t_files"))
def claim_batch(spark, sf):
    """L1: claim the next 50 pending files (pending -> processing)."""
    f = _tb(spark, sf).files
    return L.claim_batch(f, L.pending_batch(f, 50), _as_of()).select("file_id", "status", "process_start")


_OUTCOMES_SQL = """SELECT file_id, file_size > 1000 AS ok,
    CASE WHEN file_size > 1000 THEN NULL ELSE 'Processing timeout (exceeded 5 minutes)' END AS error_message,
    process_start + INTERVAL '60' SECOND AS finished_at FROM t_files WHERE status = 'processing'"""


@register("apply_outcomes", O.with_views(
    """SELECT f.file_id,
         CASE WHEN o.ok THEN 'completed' WHEN o.ok IS NOT NULL THEN 'error' ELSE f.status END AS status,
         CASE WHEN o.ok IS NOT NULL AND NOT o.ok THEN o.error_message WHEN o.ok IS NOT NULL THEN NULL
              ELSE f.error_message END AS error_message,
         CASE WHEN o.ok IS NOT NULL THEN o.finished_at ELSE f.process_end END AS process_end
       FROM t_files f LEFT JOIN o ON f.file_id = o.file_id""", "t_files", extra=[("o", _OUTCOMES_SQL)]))
def apply_outcomes(spark, sf):
    """L2/L3: outcomes of the processing files (size > 1000 succeeds)."""
    f = _tb(spark, sf).files
    o = f.where(F.col("status") == "processing").select(
        "file_id", (F.col("file_size") > 1000).alias("ok"),
        F.when(F.col("file_size") > 1000, F.lit(None).cast("string"))
        .otherwise(F.lit("Processing timeout (exceeded 5 minutes)")).alias("error_message"),
        F.timestamp_add("SECOND", F.lit(60), F.col("process_start")).alias("finished_at"))
    return L.apply_outcomes(f, o).select("file_id", "status", "error_message", "process_end")


@register("reset_stalled", O.with_views(
    """SELECT file_id, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status,
         CASE WHEN status = 'processing' THEN NULL ELSE process_start END AS process_start,
         CASE WHEN status = 'processing' THEN NULL ELSE error_message END AS error_message FROM t_files""",
    "t_files"))
def reset_stalled(spark, sf):
    """L4: processing -> pending; start and message cleared."""
    return L.reset_stalled(_tb(spark, sf).files).select("file_id", "status", "process_start", "error_message")


@register("reset_all", O.with_views(
    "SELECT file_id, 'pending' AS status, CAST(NULL AS TIMESTAMP) AS process_start, "
    "CAST(NULL AS VARCHAR) AS error_message FROM t_files", "t_files"))
def reset_all(spark, sf):
    """Every file back to pending."""
    return L.reset_all(_tb(spark, sf).files).select("file_id", "status", "process_start", "error_message")


@register("retry_errors", O.with_views(
    """SELECT file_id, CASE WHEN r THEN 'pending' ELSE status END AS status,
         CASE WHEN r THEN NULL ELSE process_start END AS process_start,
         CASE WHEN r THEN NULL ELSE error_message END AS error_message
       FROM (SELECT *, status = 'error' AND file_path NOT LIKE '%/~$%' AND coalesce(file_size > 100, false) AS r
             FROM t_files) x""", "t_files"))
def retry_errors(spark, sf):
    """Error -> pending unless temp or small (<= 100, NULL)."""
    return L.retry_errors(_tb(spark, sf).files).select("file_id", "status", "process_start", "error_message")


@register("retry_exclusions", O.with_views(
    """SELECT count(*) FILTER (WHERE file_path LIKE '%/~$%') AS temp_files,
         count(*) FILTER (WHERE file_size IS NULL OR file_size <= 100) AS small_files,
         count(*) FILTER (WHERE file_path NOT LIKE '%/~$%' AND file_size > 100) AS reset
       FROM t_files WHERE status = 'error'""", "t_files"))
def retry_exclusions(spark, sf):
    """L6 report: how many error files each exclusion keeps back."""
    return L.retry_exclusions(_tb(spark, sf).files)


@register("job_status", O.with_views(
    """SELECT job_id, count(*) AS total_files, count(*) FILTER (WHERE status = 'completed') AS processed_files,
         count(*) FILTER (WHERE status = 'error') AS error_files,
         count(*) FILTER (WHERE status = 'pending') AS pending_files,
         count(*) FILTER (WHERE status = 'processing') AS processing_files,
         CASE WHEN count(*) FILTER (WHERE status = 'pending') = 0 THEN 'completed' ELSE 'interrupted' END AS status
       FROM t_files GROUP BY job_id""", "t_files"))
def job_status(spark, sf):
    """Counters and final status derived from files."""
    return L.job_counters(_tb(spark, sf).files)


@register("interrupt_job", O.with_views(
    """SELECT f.file_id, CASE WHEN j.status = 'running' AND f.status = 'processing' THEN 'pending' ELSE f.status END AS status,
         CASE WHEN j.status = 'running' AND f.status = 'processing' THEN NULL ELSE f.process_start END AS process_start
       FROM t_files f JOIN t_jobs j ON f.job_id = j.job_id WHERE f.job_id = 2""", "t_files", "t_jobs"))
def interrupt_job(spark, sf):
    """Interrupt job 2 (running): its processing files go back to pending."""
    tb = _tb(spark, sf)
    _, f = L.interrupt_job(tb.jobs, tb.files, 2)
    return f.where(F.col("job_id") == 2).select("file_id", "status", "process_start")


@register("create_job", O.with_views(
    """SELECT DISTINCT regexp_extract(file_path, '^(/corpus/job[0-9]+/d[0-9]+)/', 1) AS directory,
         'PII Analysis - ' || regexp_extract(regexp_extract(file_path, '^(/corpus/job[0-9]+/d[0-9]+)/', 1), '[^/]*$', 0) AS name,
         'created' AS status FROM t_files""", "t_files"))
def create_job(spark, sf):
    """One new job row per scanned directory, with the default name."""
    f = _tb(spark, sf).files
    d = f.select(F.regexp_extract("file_path", "^(/corpus/job[0-9]+/d[0-9]+)/", 1).alias("directory")).distinct()
    return d.select("directory", L.default_job_name(F.col("directory")).alias("name"), F.lit("created").alias("status"))


@register("create_job_rows", O.with_views(
    """SELECT job_id, name, status, total_files, key, directory AS value FROM (
         SELECT (SELECT max(job_id) FROM t_jobs) + row_number() OVER (ORDER BY directory) AS job_id,
           'PII Analysis - ' || regexp_extract(directory, '[^/]*$', 0) AS name, 'created' AS status,
           0 AS total_files, 'directory' AS key, directory
         FROM (SELECT DISTINCT regexp_extract(file_path, '^(/corpus/job[0-9]+/d[0-9]+)/', 1) AS directory FROM t_files) x) y""",
    "t_files", "t_jobs"))
def create_job_rows(spark, sf):
    """The rows of new jobs (the next free ids) and their directory
    metadata, one job per scanned directory."""
    tb = _tb(spark, sf)
    d = tb.files.select(F.regexp_extract("file_path", "^(/corpus/job[0-9]+/d[0-9]+)/", 1).alias("directory")).distinct()
    jobs, meta = L.create_jobs(tb.jobs, d)
    return jobs.select("job_id", "name", "status", F.col("total_files").cast("int").alias("total_files")).join(
        meta.select("job_id", "key", "value"), "job_id")


@register("current_state", O.with_views(
    """SELECT file_id, CASE WHEN status = 'pending' THEN 1 WHEN status = 'processing' THEN 2 ELSE 3 END AS seq,
         status, error_message FROM t_files""", "t_files"))
def current_state(spark, sf):
    """Latest state per file from the append-only transition log."""
    return L.current_state(L.transition_log(_tb(spark, sf).files))


@register("latest_job", O.with_views(
    "SELECT job_id, name, status FROM t_jobs ORDER BY job_id DESC LIMIT 1", "t_jobs"))
def latest_job(spark, sf):
    """Newest job."""
    return L.latest_job(_tb(spark, sf).jobs).select("job_id", "name", "status")


@register("table_counts", O.with_views(
    """SELECT 'jobs' AS table_name, count(*) AS row_count FROM t_jobs
       UNION ALL SELECT 'job_metadata', count(*) FROM t_job_metadata
       UNION ALL SELECT 'files', count(*) FROM t_files
       UNION ALL SELECT 'results', count(*) FROM t_results
       UNION ALL SELECT 'entities', count(*) FROM t_entities""",
    "t_jobs", "t_job_metadata", "t_files", "t_results", "t_entities"))
def table_counts(spark, sf):
    """Row count of every ledger table."""
    tb = _tb(spark, sf)
    return L.table_counts({"jobs": tb.jobs, "job_metadata": tb.job_metadata, "files": tb.files,
                           "results": tb.results, "entities": tb.entities})


@register("src_ledger_latest", O.with_views(
    """SELECT status, count(*) AS files FROM t_files WHERE job_id = (SELECT max(job_id) FROM t_jobs)
       GROUP BY status""", "t_files", "t_jobs"))
def src_ledger_latest(spark, sf):
    """The ledger source defaults to the newest job (a one-row
    aggregate broadcast into the filter)."""
    tb = _tb(spark, sf)
    newest = tb.jobs.agg(F.max("job_id").alias("job_id"))
    return tb.files.join(F.broadcast(newest), "job_id").groupBy("status").agg(F.count(F.lit(1)).alias("files"))


_BATCHES_SQL = """SELECT file_id, CASE WHEN status = 'error' AND file_path NOT LIKE '%/~$%' AND coalesce(file_size > 100, false)
    THEN 'pending' ELSE status END AS status,
  CASE WHEN status = 'error' AND NOT (file_path NOT LIKE '%/~$%' AND coalesce(file_size > 100, false)) THEN error_message END AS error_message
  FROM t_files"""


@register("ledger_log", O.with_views(_BATCHES_SQL, "t_files"))
def ledger_log(spark, sf):
    """The ledger as a bucketed base with deltas: files are
    registered as pending, taken, finished, compacted, and their errors tried
    again; the state is the newest version's."""
    f = _tb(spark, sf).files.select("file_id", "file_path", "file_size", "status", "process_start", "process_end", "error_message")
    store = LS.LedgerStore(spark, scratch_path(spark, f"tessera-ledger-{uuid.uuid4().hex[:12]}"))
    new = f.withColumns({"status": F.lit("pending"), "error_message": F.lit(None).cast("string"),
                         "process_start": F.lit(None).cast("timestamp_ntz"), "process_end": F.lit(None).cast("timestamp_ntz")})
    store.create(new, int(spark.conf.get("spark.sql.shuffle.partitions")))
    begun = f.where("status != 'pending'")
    store.append(begun.withColumn("status", F.lit("processing")).withColumn("error_message", F.lit(None).cast("string")))
    store.append(begun.where("status != 'processing'"))
    store.compact()
    number, _ = store.latest()
    again = L.retry_errors(store.state(number).where("status = 'error'")).where("status = 'pending'")
    store.append(again, number)
    return store.state().select("file_id", "status", "error_message")


_CLAIMS_SQL = """
WITH p AS (SELECT file_id, file_size, status, row_number() OVER (PARTITION BY status = 'pending' ORDER BY file_id) AS rn FROM t_files),
n AS (SELECT *, CASE WHEN status <> 'pending' THEN NULL WHEN rn <= 60 THEN 'a' WHEN rn <= 100 THEN 'b' END AS first FROM p),
c AS (SELECT *, first = 'a' AND rn % 3 <> 0 AS done FROM n),
r AS (SELECT *, CASE WHEN status = 'pending' AND NOT coalesce(done, false) AND coalesce(first, '') <> 'b'
    THEN row_number() OVER (PARTITION BY status = 'pending' AND NOT coalesce(done, false) AND coalesce(first, '') <> 'b' ORDER BY file_id) END AS k FROM c)
SELECT file_id, CASE WHEN done AND file_size > 1000 THEN 'completed' WHEN done THEN 'error' WHEN first = 'b' THEN 'processing'
    WHEN k <= 50 THEN 'processing' WHEN status = 'pending' THEN 'pending' ELSE status END AS status,
  CASE WHEN done OR (first = 'a' AND k > 50) THEN 'a' WHEN first = 'b' OR k <= 50 THEN 'b' END AS worker
FROM r"""


@register("ledger_claims", O.with_views(f"SELECT * FROM ({_CLAIMS_SQL}) x", "t_files"))
def ledger_claims(spark, sf):
    """L1-L3 by two workers: claims under a lease, outcomes of some files, and
    files whose lease has run out going to the other worker."""
    f = LS.leased(_tb(spark, sf).files.select("file_id", "file_size", "status", "process_start", "process_end", "error_message"))
    store = LS.LedgerStore(spark, scratch_path(spark, f"tessera-ledger-{uuid.uuid4().hex[:12]}"))
    store.create(f, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def at(minutes):
        return _as_of() + F.expr(f"INTERVAL {minutes} MINUTES")
    mine = store.claim("a", 60, at(0), "5 minutes")
    store.claim("b", 40, at(2), "5 minutes")
    # two of three files of a's are done in time
    done = ranked(mine, ["file_id"], out="rn").where("rn % 3 != 0").select(
        "file_id", (F.col("file_size") > 1000).alias("ok"), F.lit("too small").alias("error_message"))
    store.finish("a", done, at(4))
    store.claim("b", 50, at(6), "5 minutes")
    # a's report of files that b has now changes nothing
    late = mine.select("file_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error_message"))
    store.finish("a", late, at(7))
    return store.state().select("file_id", "status", "worker")
