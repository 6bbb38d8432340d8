"""Scan ledger: path/type columns, predicates, joins and state transitions
(P1-P17, J2-J12, L1-L11).

The ledger is a set of DataFrames (jobs, job_metadata, files, results,
entities).  A state change is a pure ``DataFrame -> DataFrame`` projection;
writing it back (overwrite of a partition, or an append to a transition log
reduced by :func:`current_state`) is the caller's choice.  Job counters are
never stored: they are always ``groupBy(job_id)`` over files (Q2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import strip

# ---------------------------------------------------------------------------
# fixed values
# ---------------------------------------------------------------------------
# discovery extensions (with dot)
DEFAULT_SUPPORTED_EXTENSIONS = [
    ".txt", ".pdf", ".docx", ".doc", ".rtf",
    ".xlsx", ".xls", ".csv", ".tsv",
    ".pptx", ".ppt",
    ".json", ".xml", ".html", ".htm",
    ".eml", ".msg",
    ".md", ".markdown",
]
# extraction method by extension (without dot)
EXTRACTION_METHODS = {
    "docx": "tika",
    "xlsx": "tika",
    "csv": "tika",
    "rtf": "tika",
    "pdf": "tika_or_ocr",
    "jpg": "ocr",
    "jpeg": "ocr",
    "png": "ocr",
    "tiff": "ocr",
    "tif": "ocr",
    "txt": "tika",
}
ROUTES = {"tika": "tika", "ocr": "ocr", "tika_or_ocr": "tika_with_ocr_fallback"}
MAX_FILE_BYTES = 100 * 1024 * 1024
OCR_MIN_CHARS = 50
RETRY_MIN_SIZE = 100
TEMP_MARKER = "~$"
FILE_STATUSES = ["pending", "processing", "completed", "error"]
MISSING_MESSAGE = "File no longer exists"


# ---------------------------------------------------------------------------
# path columns (P1, S12 helpers)
# ---------------------------------------------------------------------------
def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_type(path: Column) -> Column:
    """Lower-case extension with the dot, '' when none; names that only
    start with dots ('.bashrc') have none — like ``os.path.splitext``."""
    return F.lower(F.regexp_extract(basename(path), "^\\.*[^.].*(\\.[^.]*)$", 1))


def file_extension(path: Column) -> Column:
    """P1 variant: the same extension without its dot."""
    return F.regexp_replace(file_type(path), "^\\.", "")


def stem(path: Column) -> Column:
    b = basename(path)
    ext = F.regexp_extract(b, "^\\.*[^.].*(\\.[^.]*)$", 1)
    return F.substr(b, F.lit(1), F.length(b) - F.length(ext))


def is_supported(path: Column, extensions=DEFAULT_SUPPORTED_EXTENSIONS) -> Column:
    """Extension lists may be written with or without dots."""
    dotted = sorted({e if e.startswith(".") else "." + e for e in extensions})
    return file_type(path).isin(*dotted)


def extract_route(path: Column, force_ocr: Column | bool = False) -> Column:
    """P3: 'tika' | 'ocr' | 'tika_with_ocr_fallback'; NULL when unsupported
    (the error side-output is ``route IS NULL``)."""
    ext = file_extension(path)
    method = F.create_map(*[x for k, v in EXTRACTION_METHODS.items() for x in (F.lit(k), F.lit(v))])
    m = F.element_at(method, ext)
    route = F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.lit(v))])
    force = force_ocr if isinstance(force_ocr, Column) else F.lit(bool(force_ocr))
    return F.when(m.isNull(), F.lit(None).cast("string")).when(force, F.lit("ocr")).otherwise(F.element_at(route, m))


def needs_ocr(path: Column, text: Column) -> Column:
    """A PDF whose extracted text (trimmed) is shorter than 50 chars."""
    short = F.coalesce(F.length(strip(text)) < OCR_MIN_CHARS, F.lit(True))
    return F.lower(path).endswith(".pdf") & short


def size_gate_message(size: Column, limit: int = MAX_FILE_BYTES) -> Column:
    """P5: the rejection message for files above the limit, else NULL."""
    # a tie goes to the even digit, as in the texts that this message has to equal
    mb = F.bround(size / F.lit(1024.0 * 1024.0), 2)
    most = f"{limit / (1024 * 1024):g}"
    return F.when(size > limit, F.format_string(f"File too large: %.2fMB (max {most}MB)", mb))


def file_gate(listed: DataFrame, found: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """P5: every listed ``file_path`` with the reason it cannot be analysed:
    it is not ``found(file_path, file_size, access_error)``, its access
    failed, or it is too large; null for a file that can.  A file that is
    missing or not accessible has size 0."""
    f = found.select("file_path", F.col("file_size").alias("_size"), F.col("access_error").alias("_error"), F.lit(True).alias("_found"))
    j = listed.join(f, "file_path", "left")
    message = (F.when(F.col("_found").isNull(), F.concat(F.lit("File not found: "), F.col("file_path")))
               .when(F.col("_error").isNotNull(), F.concat(F.lit("File access error: "), F.col("_error")))
               .otherwise(size_gate_message(F.col("_size"), limit)))
    size = F.when(F.col("_found").isNull() | F.col("_error").isNotNull(), F.lit(0)).otherwise(F.col("_size"))
    return j.select(*listed.columns, size.cast("long").alias("checked_size"), message.alias("error_message"),
                    message.isNull().alias("success"))


def is_temp(path: Column) -> Column:
    """Office lock files (``~$`` after a slash)."""
    return path.like("%/~$%")


# ---------------------------------------------------------------------------
# joins
# ---------------------------------------------------------------------------
def first_results(results: DataFrame) -> DataFrame:
    """Q6: the lowest result_id per file."""
    return results.groupBy("file_id").agg(F.min("result_id").alias("result_id"))


def files_left_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """Every file, with its (first) result when it has one."""
    r = results.join(first_results(results), ["file_id", "result_id"], "left_semi")
    return files.join(r, "file_id", "left")


def register_new(listing: DataFrame, existing: DataFrame) -> DataFrame:
    """Paths of a listing not yet in the ledger, per job, each once.
    Idempotent: a second run over the same listing and the grown ledger adds
    nothing."""
    return listing.dropDuplicates(["job_id", "file_path"]).join(existing.select("job_id", "file_path"), ["job_id", "file_path"], "left_anti")


def mark_missing(files: DataFrame, listing: DataFrame, job_id=None) -> DataFrame:
    """J9 + L7: ledger rows whose path is no longer listed become errors."""
    scope = files if job_id is None else files.where(F.col("job_id") == job_id)
    gone = scope.join(listing.select("job_id", "file_path"), ["job_id", "file_path"], "left_anti")
    return gone.withColumn("status", F.lit("error")).withColumn("error_message", F.lit(MISSING_MESSAGE))


def jobs_with_meta(jobs: DataFrame, meta: DataFrame) -> DataFrame:
    """The metadata key/value rows folded into one map per job."""
    m = meta.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
                                   .alias("metadata"))
    return jobs.join(m, "job_id", "left")


def jobs_by_meta(jobs: DataFrame, meta: DataFrame, key: str, value: str) -> DataFrame:
    """Jobs whose metadata holds key = value."""
    hit = meta.where((F.col("key") == key) & (F.col("value") == value)).select("job_id")
    return jobs.join(hit, "job_id", "left_semi")


def clear_job(files: DataFrame, results: DataFrame, entities: DataFrame, job_id) -> tuple:
    """The three tables with every row of one job removed."""
    gone_files = files.where(F.col("job_id") == job_id).select("file_id")
    f = files.where(F.col("job_id") != job_id)
    r = results.join(gone_files, "file_id", "left_anti")
    gone_results = results.join(gone_files, "file_id", "left_semi").select("result_id")
    e = entities.join(gone_results, "result_id", "left_anti")
    return f, r, e


# ---------------------------------------------------------------------------
# state transitions
# ---------------------------------------------------------------------------
def pending_batch(files: DataFrame, n: int, job_id=None) -> DataFrame:
    """The next n pending files (order made explicit: file_id)."""
    f = files.where(F.col("status") == "pending")
    if job_id is not None:
        f = f.where(F.col("job_id") == job_id)
    return f.orderBy("file_id").limit(n)


def claim_batch(files: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """L1: the claimed files become 'processing' with a start time."""
    ids = batch.select("file_id", F.lit(True).alias("_claimed"))
    j = files.join(ids, "file_id", "left")
    j = j.withColumn("_claimed", F.coalesce(F.col("_claimed"), F.lit(False)) & (F.col("status") == "pending"))
    claimed = F.col("_claimed")
    return j.withColumn("status", F.when(claimed, F.lit("processing")).otherwise(F.col("status"))) \
        .withColumn("process_start", F.when(claimed, as_of).otherwise(F.col("process_start"))) \
        .drop("_claimed")


def apply_outcomes(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """L2/L3: ``outcomes(file_id, ok, error_message, finished_at)`` turns
    processing files into completed or error rows."""
    o = outcomes.select("file_id", F.col("ok").alias("_ok"), F.col("error_message").alias("_msg"),
                        F.col("finished_at").alias("_end"))
    j = files.join(o, "file_id", "left")
    hit = F.col("_ok").isNotNull()
    return (j.withColumn("status", F.when(hit & F.col("_ok"), F.lit("completed"))
                         .when(hit, F.lit("error")).otherwise(F.col("status")))
            .withColumn("error_message", F.when(hit & ~F.col("_ok"), F.col("_msg"))
                        .when(hit, F.lit(None).cast("string")).otherwise(F.col("error_message")))
            .withColumn("process_end", F.when(hit, F.col("_end")).otherwise(F.col("process_end")))
            .drop("_ok", "_msg", "_end"))


def reset_stalled(files: DataFrame, clear_message: bool = True) -> DataFrame:
    """L4: processing -> pending, start (and message) cleared."""
    stalled = F.col("status") == "processing"
    out = files.withColumn("process_start", F.when(stalled, F.lit(None)).otherwise(F.col("process_start")))
    if clear_message:
        out = out.withColumn("error_message", F.when(stalled, F.lit(None)).otherwise(F.col("error_message")))
    return out.withColumn("status", F.when(stalled, F.lit("pending")).otherwise(F.col("status")))


def reset_all(files: DataFrame) -> DataFrame:
    """Every file pending with cleared times and message (the caller
    writes empty results/entities)."""
    return (files.withColumn("status", F.lit("pending"))
            .withColumn("process_start", F.lit(None).cast(files.schema["process_start"].dataType))
            .withColumn("process_end", F.lit(None).cast(files.schema["process_end"].dataType))
            .withColumn("error_message", F.lit(None).cast("string")))


def reset_everything(jobs: DataFrame, files: DataFrame, results: DataFrame, entities: DataFrame, now: Column) -> tuple:
    """The four tables after a full reset: every file pending, every job
    created anew with its counters at 0, no results and no entities."""
    zero = {c: F.lit(0).cast(jobs.schema[c].dataType) for c in ("processed_files", "error_files")}
    j = jobs.withColumns({**zero, "status": F.lit("created"), "last_updated": now})
    return j, reset_all(files), results.limit(0), entities.limit(0)


def retry_errors(files: DataFrame, min_size: int = RETRY_MIN_SIZE, exclude_temp: bool = True,
                 exclude_small: bool = True) -> DataFrame:
    """Error -> pending, except temp files and files of size <= min_size
    (a NULL size is excluded too: it is 'small'); three fields cleared."""
    ok = F.col("status") == "error"
    if exclude_temp:
        ok = ok & ~is_temp(F.col("file_path"))
    if exclude_small:
        ok = ok & F.coalesce(F.col("file_size") > min_size, F.lit(False))
    return (files.withColumn("_reset", ok)
            .withColumn("status", F.when(F.col("_reset"), F.lit("pending")).otherwise(F.col("status")))
            .withColumn("process_start", F.when(F.col("_reset"), F.lit(None)).otherwise(F.col("process_start")))
            .withColumn("process_end", F.when(F.col("_reset"), F.lit(None)).otherwise(F.col("process_end")))
            .withColumn("error_message", F.when(F.col("_reset"), F.lit(None)).otherwise(F.col("error_message")))
            .drop("_reset"))


def retry_exclusions(files: DataFrame, min_size: int = RETRY_MIN_SIZE) -> DataFrame:
    """L6 report: error files excluded as temp / as small, and reset."""
    err = files.where(F.col("status") == "error")
    small = F.col("file_size").isNull() | (F.col("file_size") <= min_size)
    temp = is_temp(F.col("file_path"))
    return err.agg(F.count_if(temp).alias("temp_files"), F.count_if(small).alias("small_files"),
                   F.count_if(~temp & F.coalesce(~small, F.lit(False))).alias("reset"))


def job_counters(files: DataFrame) -> DataFrame:
    """Counters and final status derived from the files, per job."""
    return files.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "completed").alias("processed_files"),
        F.count_if(F.col("status") == "error").alias("error_files"),
        F.count_if(F.col("status") == "pending").alias("pending_files"),
        F.count_if(F.col("status") == "processing").alias("processing_files"),
    ).withColumn("status", F.when(F.col("pending_files") == 0, F.lit("completed")).otherwise(F.lit("interrupted")))


def interrupt_job(jobs: DataFrame, files: DataFrame, job_id) -> tuple[DataFrame, DataFrame]:
    """Only a running job is interrupted: its processing files go back
    to pending and the job's status becomes 'interrupted'."""
    running = jobs.where((F.col("job_id") == job_id) & (F.col("status") == "running")).select("job_id")
    hit = files.join(running.withColumn("_hit", F.lit(True)), "job_id", "left")
    scope = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("status") == "processing")
    f = (hit.withColumn("process_start", F.when(scope, F.lit(None)).otherwise(F.col("process_start")))
         .withColumn("status", F.when(scope, F.lit("pending")).otherwise(F.col("status"))).drop("_hit"))
    j = jobs.withColumn("status", F.when((F.col("job_id") == job_id) & (F.col("status") == "running"),
                                         F.lit("interrupted")).otherwise(F.col("status")))
    return j, f


def default_job_name(directory: Column) -> Column:
    """The name of a job that was given none."""
    return F.concat(F.lit("PII Analysis - "), basename(directory))


def create_jobs(jobs: DataFrame, directories: DataFrame, now: Column | None = None, command_line: str | None = None,
                settings: dict | None = None, metadata: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Job rows with the next free ids for directories, with both times,
    command line and settings (JSON, null when there are none), and their
    metadata rows: ``directory`` and what ``metadata`` holds."""
    import json

    from .parallel import ranked
    first = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0))).scalar()
    new = ranked(directories, ["directory"], out="_rn").withColumn("job_id", first + F.col("_rn"))
    now = (F.lit(None) if now is None else now).cast("timestamp_ntz")
    rows = new.select("job_id", default_job_name(F.col("directory")).alias("name"), now.alias("start_time"),
                      now.alias("last_updated"), F.lit("created").alias("status"),
                      F.lit(command_line).cast("string").alias("command_line"),
                      *(F.lit(0).alias(c) for c in ("total_files", "processed_files", "error_files")),
                      F.lit(json.dumps(settings) if settings else None).cast("string").alias("settings"))
    pairs = [F.struct(F.lit("directory").alias("key"), F.col("directory").alias("value")), *(
        F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("value")) for k, v in (metadata or {}).items() if k != "directory")]
    return rows, new.select("job_id", F.explode(F.array(*pairs)).alias("m")).select("job_id", "m.*")


def normalise_dir(path: Column) -> Column:
    """No empty or ``.`` parts, each ``..`` takes the part before it
    (normpath)."""
    rooted = F.startswith(path, F.lit("/"))

    def step(acc, part):
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return (F.when(part.isin("", "."), acc)
                .when(up, F.slice(acc, 1, F.size(acc) - 1))
                .when((part == "..") & rooted & (F.size(acc) == 0), acc)
                .otherwise(F.concat(acc, F.array(part))))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def resumption_point(jobs: DataFrame, meta: DataFrame, directory: str, force: bool = False) -> DataFrame:
    """The newest job for a directory; completed jobs only when forced."""
    d = meta.where(F.col("key") == "directory").select("job_id", normalise_dir(F.col("value")).alias("dir"))
    cand = jobs.join(d, "job_id").where(F.col("dir") == normalise_dir(F.lit(directory)))
    if not force:
        cand = cand.where(F.col("status") != "completed")
    return cand.orderBy(F.desc("start_time"), F.desc("job_id")).limit(1)


def transition_log(files: DataFrame) -> DataFrame:
    """An append-only log equivalent to the files table: one row per state a
    file went through (pending, processing, and its final state)."""
    base = files.select("file_id", "job_id", "status", "process_start", "process_end", "error_message")
    p = base.select("file_id", F.lit(1).alias("seq"), F.lit("pending").alias("status"),
                    F.lit(None).cast("string").alias("error_message"))
    s = base.where(F.col("status") != "pending").select(
        "file_id", F.lit(2).alias("seq"), F.lit("processing").alias("status"),
        F.lit(None).cast("string").alias("error_message"))
    e = base.where(F.col("status").isin("completed", "error")).select(
        "file_id", F.lit(3).alias("seq"), "status", "error_message")
    return p.unionByName(s).unionByName(e)


def current_state(log: DataFrame, key: str = "file_id") -> DataFrame:
    """Latest state per file from an append-only transition log.

    ``max_by`` is a partial aggregate: each map task reduces its rows of a
    hot file to one before the shuffle."""
    st = F.max_by(F.struct("status", "error_message"), "seq")
    return log.groupBy(key).agg(st.alias("s"), F.max("seq").alias("seq")).select(
        key, "seq", F.col("s.status").alias("status"), F.col("s.error_message").alias("error_message"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job (max job_id), as the default for reports."""
    return jobs.orderBy(F.desc("job_id")).limit(1)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each ledger table, one row per table."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out
