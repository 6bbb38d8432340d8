"""Whole records where earlier queries compare counts: reports, exports, the
dashboard's page, job rows, gates and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions.plugins import ScanSettings
from ..operators import anonymize as A
from ..operators import classify as C
from ..operators import dashboard as DB
from ..operators import detect as D
from ..operators import ledger as L
from ..operators import summary as SM
from ..sources import metrics as MX
from ..sources import reports as RP
from ..sources import sinks as SK
from ..sources.tables import read_table
from . import evidence as EV
from . import oracle as O
from .q_time import ETA_PENDING_SQL
from .registry import register
from .testbed import Testbed

AS_OF = "1999-01-01 00:00:00"


def _fe(tb):
    return C.ledger_entities(tb.files, tb.results, tb.entities, 0.7)


@register("simple_report_lines", O.ledger_sql(f"""
SELECT CAST(file_rank AS BIGINT) AS file_rank, CAST(ord AS INT) AS ord, line FROM (
  SELECT 0 AS file_rank, 0 AS ord, {O.q(SM.SIMPLE_TITLE)} AS line UNION ALL SELECT 0, 1, ''
  UNION ALL SELECT file_rank, 0, 'File: ' || file_path FROM b
  UNION ALL SELECT file_rank, 1, 'Number of sensitive entities: ' || total FROM b
  UNION ALL SELECT file_rank, {SM.TYPES}, 'Entity types:' FROM b
  UNION ALL SELECT file_rank, {SM.SAMPLES}, 'Sample entities (max 3 per type):' FROM b
  UNION ALL SELECT file_rank, {SM.END}, {O.q(SM.SEPARATOR)} FROM b
  UNION ALL SELECT file_rank, {SM.TYPES} + spot, '  - ' || category || ': ' || n FROM c
  UNION ALL SELECT file_rank, {SM.SAMPLES} + spot * 10, '  ' || category || ':' FROM c
  UNION ALL SELECT c.file_rank, {SM.SAMPLES} + c.spot * 10 + s.rn, '    - ' || s.masked || ' (confidence: ' || printf('%.2f', s.score) || ')'
    FROM s JOIN c ON s.file_id = c.file_id AND s.category = c.category WHERE s.rn <= 3) u""",
    ("e", f"""SELECT *, {O.sql_display('entity_type', P.SIMPLE_CATEGORIES)} AS category, {O.sql_mask_simple('text', 'entity_type')} AS masked
      FROM fe WHERE entity_type IN ({', '.join(O.q(t) for t in P.SIMPLE_CATEGORIES)})"""),
    ("b", """SELECT file_id, file_path, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, file_path, file_id) AS file_rank
      FROM e GROUP BY file_id, file_path"""),
    ("c", """SELECT b.file_rank, e.file_id, category, count(*) AS n,
        row_number() OVER (PARTITION BY e.file_id ORDER BY count(*) DESC, category) AS spot
      FROM e JOIN b ON e.file_id = b.file_id GROUP BY b.file_rank, e.file_id, category"""),
    ("s", """SELECT *, row_number() OVER (PARTITION BY file_id, category
        ORDER BY start_index, end_index, entity_type, text, score) AS rn FROM e""")))
def simple_report_lines(spark, sf):
    """The simple policy's report as ordered line rows."""
    return SM.simple_report_lines(_fe(Testbed(spark, sf)))


_PAGE = f"""
SELECT * FROM (
  SELECT 'job' AS section, 1 AS place, 'id' AS name, NULL AS label, job_id::VARCHAR AS value FROM j
  UNION ALL SELECT 'job', 2, 'name', NULL, name FROM j UNION ALL SELECT 'job', 3, 'status', NULL, status FROM j
  UNION ALL SELECT 'processing', k, n, NULL, v FROM (SELECT unnest(range(1, 8)) AS k, unnest(['total_files', 'completed', 'pending', 'processing',
      'error', 'progress_percent', 'error_rate']) AS n, unnest([total::VARCHAR, completed::VARCHAR, pending::VARCHAR, processing::VARCHAR, error::VARCHAR,
      round((completed + error) * 100.0 / total, 1)::DOUBLE::VARCHAR, round(error * 100.0 / total, 1)::DOUBLE::VARCHAR]) AS v FROM c) x
  UNION ALL SELECT 'time', k, n, NULL, v FROM (SELECT unnest(range(1, 4)) AS k, unnest(['elapsed', 'files_per_hour', 'estimated_completion']) AS n,
      unnest([elapsed_time_formatted, printf('%.2f', files_per_hour), estimated_completion_time]) AS v FROM eta JOIN j USING (job_id)) x
  UNION ALL SELECT 'file_type', row_number() OVER (ORDER BY count(*) DESC, file_type), file_type, NULL, count(*)::VARCHAR FROM f
    WHERE coalesce(file_type, '') <> '' GROUP BY file_type
  UNION ALL SELECT 'entity_type', row_number() OVER (ORDER BY count(*) DESC, entity_type), entity_type,
      {O.sql_display('entity_type', P.STRICT_DISPLAY_NAMES)}, count(*)::VARCHAR FROM fe WHERE file_id IN (SELECT file_id FROM f) GROUP BY entity_type
  UNION ALL SELECT 'high_risk', 1, 'count', NULL, (SELECT count(*) FROM h)::VARCHAR
  UNION ALL SELECT 'high_risk', 2, 'has_more', NULL, ((SELECT count(*) FROM h) > {DB.LISTED})::VARCHAR
  UNION ALL SELECT 'high_risk_file', row_number() OVER (ORDER BY file_id), file_path, NULL, NULL FROM (SELECT * FROM h ORDER BY file_id LIMIT {DB.LISTED}) y) z"""


@register("dashboard_page", O.with_views(
    f"SELECT section, CAST(place AS INT) AS place, name, label, value FROM ({_PAGE}) w", "t_files", "t_results", "t_entities", "t_jobs", extra=[
        ("fe", O.LEDGER_FE), ("fs", O.LEDGER_FS), ("eta", ETA_PENDING_SQL),
        ("j", "SELECT * FROM t_jobs ORDER BY job_id DESC LIMIT 1"), ("f", "SELECT * FROM t_files WHERE job_id = (SELECT job_id FROM j)"),
        ("c", """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'pending') AS pending,
            count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'error') AS error FROM f"""),
        ("h", f"SELECT file_id, file_path FROM fs WHERE {O.sql_trigger('types')} AND file_id IN (SELECT file_id FROM f)")]))
def dashboard_page(spark, sf):
    """The newest job's page: job, processing, time and estimate, types
    with display names, high-risk files and the first 50 of them."""
    tb = Testbed(spark, sf)
    return DB.job_page(tb.jobs, tb.files, tb.results, tb.entities)


_SPLIT = "processing_time * ({f}file_id % 5 + 1) / 10"


@register("run_summary_types", O.with_views(
    f"""SELECT *, extraction_time + analysis_time AS total_time, extraction_time * 100.0 / (extraction_time + analysis_time) AS extraction_share,
         analysis_time * 100.0 / (extraction_time + analysis_time) AS analysis_share FROM (
       SELECT (SELECT count(*) FROM t_files) AS files_analyzed, (SELECT count(*) FROM t_files WHERE status = 'completed') AS files_processed,
         (SELECT count(*) FROM t_files WHERE status = 'error') AS files_failed,
         (SELECT count(*) FROM t_entities WHERE result_id IN (SELECT result_id FROM t_results)) AS total_entities,
         (SELECT '{{' || string_agg('"' || entity_type || '":' || n, ',' ORDER BY entity_type) || '}}' FROM (
            SELECT entity_type, count(*) AS n FROM t_entities WHERE result_id IN (SELECT result_id FROM t_results) GROUP BY 1) x) AS entity_type_counts,
         (SELECT sum({_SPLIT.format(f='')}) FROM t_results) AS extraction_time,
         (SELECT sum(processing_time - {_SPLIT.format(f='')}) FROM t_results) AS analysis_time) y""", "t_files", "t_results", "t_entities"))
def run_summary_types(spark, sf):
    """The run's row with counts by type and the time split."""
    tb = Testbed(spark, sf)
    r = tb.results.withColumn("extraction_time", F.expr(_SPLIT.format(f=""))).withColumn(
        "analysis_time", F.col("processing_time") - F.col("extraction_time"))
    return DB.run_summary(tb.files, r, tb.entities)


@register("job_statistics_maps", O.with_views(
    """SELECT j.job_id, j.name, j.status, j.total_files, t.m AS file_types, e.m AS entity_types, round(coalesce(a.a, 0.0), 9) AS avg_time
       FROM t_jobs j
       LEFT JOIN (SELECT job_id, '{' || string_agg('"' || file_type || '":' || n, ',' ORDER BY file_type) || '}' AS m
                  FROM (SELECT job_id, file_type, count(*) AS n FROM t_files GROUP BY 1, 2) x GROUP BY job_id) t ON t.job_id = j.job_id
       LEFT JOIN (SELECT job_id, '{' || string_agg('"' || entity_type || '":' || n, ',' ORDER BY entity_type) || '}' AS m
                  FROM (SELECT f.job_id, e.entity_type, count(*) AS n FROM t_entities e JOIN t_results r ON e.result_id = r.result_id
                        JOIN t_files f ON f.file_id = r.file_id GROUP BY 1, 2) x GROUP BY job_id) e ON e.job_id = j.job_id
       LEFT JOIN (SELECT f.job_id, avg(r.processing_time) AS a FROM t_results r JOIN t_files f ON f.file_id = r.file_id
                  WHERE f.status = 'completed' GROUP BY f.job_id) a ON a.job_id = j.job_id""", "t_jobs", "t_files", "t_results", "t_entities"))
def job_statistics_maps(spark, sf):
    """Each job's statistics with whole maps."""
    tb = Testbed(spark, sf)
    return DB.job_statistics(tb.jobs, tb.files, tb.results, tb.entities).withColumn("avg_time", F.round("avg_time", 9))


@register("export_header", O.with_views(
    f"""SELECT j.job_id, j.name AS job_name, j.start_time, j.last_updated AS end_time, j.processed_files, c.*,
          e.elapsed_time_formatted AS elapsed_time, e.files_per_hour, e.estimated_completion_time AS estimated_completion
        FROM t_jobs j JOIN ({ETA_PENDING_SQL}) e ON e.job_id = j.job_id, LATERAL (
          SELECT count(*) AS total_registered, count(*) FILTER (WHERE status = 'completed') AS total_completed,
            count(*) FILTER (WHERE status = 'pending') AS pending_files, count(*) FILTER (WHERE status = 'processing') AS processing_files,
            count(*) FILTER (WHERE status = 'error') AS error_files FROM t_files f WHERE f.job_id = j.job_id) c""", "t_jobs", "t_files"))
def export_header(spark, sf):
    """The processing header of every job's export."""
    tb = Testbed(spark, sf)
    return DB.export_header(tb.jobs, tb.files)


@register("export_records", O.ledger_sql(
    """SELECT f.job_id, f.file_path, f.file_type, f.file_size, r.processing_time, json_extract_string(r.metadata, '$.extraction_method') AS extraction_method,
         coalesce(e.n, 0) AS entity_count, coalesce(e.list, '') AS entities
       FROM t_files f JOIN t_results r ON r.file_id = f.file_id
       LEFT JOIN (SELECT file_id, count(*) AS n, string_agg(entity_type || '|' || start_index || '|' || end_index || '|' || printf('%.2f', score) || '|' || text, ';'
                    ORDER BY start_index, end_index, entity_type, text) AS list FROM fe GROUP BY file_id) e ON e.file_id = f.file_id
       WHERE f.status = 'completed'"""))
def export_records(spark, sf):
    """Every exported record whole: file fields, extraction method and
    the list of its entities >= 0.7."""
    tb = Testbed(spark, sf)
    done = tb.files.where(F.col("status") == "completed").join(tb.results.select("file_id"), "file_id", "left_semi")
    rec = RP.nested_records(tb.jobs, done, tb.results, tb.entities, threshold=0.7, mask=False)
    e = F.array_sort(F.transform("entities", lambda x: F.struct(
        x["start"].alias("a"), x["end"].alias("b"), x["entity_type"].alias("t"), x["text"].alias("x"), x["score"].alias("s"))))
    text = F.array_join(F.transform(e, lambda x: F.concat_ws(
        "|", x["t"], x["a"].cast("string"), x["b"].cast("string"), F.format_string("%.2f", x["s"]), x["x"])), ";")
    return rec.select("job_id", "file_path", "file_type", "file_size", "processing_time",
                      F.element_at("metadata", F.lit("extraction_method")).alias("extraction_method"),
                      F.size("entities").cast("long").alias("entity_count"), text.alias("entities"))


@register("create_job_full", O.with_views(
    f"""SELECT j.*, m.key, m.value FROM (
         SELECT (SELECT max(job_id) FROM t_jobs) + row_number() OVER (ORDER BY directory) AS job_id, directory,
           'PII Analysis - ' || regexp_extract(directory, '[^/]*$', 0) AS name, TIMESTAMP '{AS_OF}' AS start_time, TIMESTAMP '{AS_OF}' AS last_updated,
           'created' AS status, 'scan --all' AS command_line, '{{"threshold": 0.7, "method": "mask"}}' AS settings
         FROM (SELECT DISTINCT regexp_extract(file_path, '^(/corpus/job[0-9]+/d[0-9]+)/', 1) AS directory FROM t_files) x) j,
       LATERAL (SELECT 'directory' AS key, j.directory AS value UNION ALL SELECT 'workers', '8' UNION ALL SELECT 'owner', 'ops') m""",
    "t_files", "t_jobs"))
def create_job_full(spark, sf):
    """New jobs with times, command line, settings and all metadata."""
    tb = Testbed(spark, sf)
    d = tb.files.select(F.regexp_extract("file_path", "^(/corpus/job[0-9]+/d[0-9]+)/", 1).alias("directory")).distinct()
    jobs, meta = L.create_jobs(tb.jobs, d, F.lit(AS_OF), "scan --all", {"threshold": 0.7, "method": "mask"}, {"workers": 8, "owner": "ops"})
    directory = meta.where("key = 'directory'").select("job_id", F.col("value").alias("directory"))
    return jobs.drop("total_files", "processed_files", "error_files").join(meta, "job_id").join(directory, "job_id")


@register("reset_everything", O.with_views(
    f"""SELECT 'files' AS table_name, file_id AS id, 'pending' AS status, 0 AS done, NULL::TIMESTAMP AS at FROM t_files
        UNION ALL SELECT 'jobs', job_id, 'created', 0, TIMESTAMP '{AS_OF}' FROM t_jobs
        UNION ALL SELECT 'left', (SELECT 0), 'results and entities', 0, NULL""", "t_files", "t_jobs"))
def reset_everything(spark, sf):
    """Every table after a full reset."""
    tb = Testbed(spark, sf)
    j, f, r, e = L.reset_everything(tb.jobs, tb.files, tb.results, tb.entities, F.lit(AS_OF).cast("timestamp_ntz"))
    none = F.lit(None).cast("timestamp_ntz")
    left = r.select("file_id").unionByName(e.select("file_id")).agg(F.count("*").alias("n"))
    return f.select(F.lit("files").alias("table_name"), F.col("file_id").alias("id"), "status", F.lit(0).alias("done"),
                    F.coalesce("process_start", "process_end", none).alias("at")).union(
        j.select(F.lit("jobs"), "job_id", "status", (F.col("processed_files") + F.col("error_files")).cast("int"), "last_updated")).union(
        left.select(F.lit("left"), F.col("n"), F.lit("results and entities"), F.lit(0), none))


_DISK = "SELECT file_path, file_size * 1000 AS file_size, CASE WHEN file_id % 13 = 0 THEN concat('[Errno 13] Permission denied: ', file_path) END AS access_error FROM t_files WHERE file_id % 11 <> 0"


@register("file_gate", O.with_views(
    f"""SELECT f.file_id, f.file_path, CASE WHEN d.file_path IS NULL OR d.access_error IS NOT NULL THEN 0 ELSE d.file_size END AS checked_size,
         m.error_message, m.error_message IS NULL AS success
       FROM t_files f LEFT JOIN ({_DISK}) d ON d.file_path = f.file_path, LATERAL (SELECT CASE
         WHEN d.file_path IS NULL THEN 'File not found: ' || f.file_path WHEN d.access_error IS NOT NULL THEN 'File access error: ' || d.access_error
         WHEN d.file_size > 104857600 THEN printf('File too large: %.2fMB (max 100MB)', d.file_size / 1048576.0) END AS error_message) m""", "t_files"))
def file_gate(spark, sf):
    """P5: files that are missing, not accessible or too large, each with its
    message."""
    f = Testbed(spark, sf).files
    disk = f.where("file_id % 11 != 0").select("file_path", (F.col("file_size") * 1000).alias("file_size"), F.when(
        F.col("file_id") % 13 == 0, F.concat(F.lit("[Errno 13] Permission denied: "), "file_path")).alias("access_error"))
    return L.file_gate(f.select("file_id", "file_path"), disk)


_SCANNED = "concat('/c/', CAST(doc_id AS {text}), CASE pmod_ WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.xyz' END)"


@register("scan_selected", O.with_views(
    f"""SELECT file_path, entity_count, tier FROM (
         SELECT {_SCANNED.format(text='VARCHAR')} AS file_path, pmod_, CAST(len(types) AS INT) AS entity_count, CAST({O.sql_set_tier('types')} AS INT) AS tier
         FROM (SELECT doc_id, abs(doc_id) % 3 AS pmod_, list(entity_type) AS types FROM spans WHERE doc_id IN (
             SELECT doc_id FROM corpus WHERE strlen(text) <= 5000) GROUP BY doc_id) x) y
       WHERE pmod_ < 2 AND tier >= 2""", extra=O.spans_view(None, 0.8, src="corpus", src_sql=EV.CORPUS_SQL)))
def scan_selected(spark, sf):
    """A scan under all settings: extensions, size, threshold, lowest tier."""
    settings = ScanSettings(threshold=0.8, max_file_bytes=5000, min_tier=2, extensions=["txt", ".pdf"])
    files = EV.corpus(spark, sf).withColumn("pmod_", F.abs("doc_id") % 3).select(
        F.expr(_SCANNED.format(text="STRING")).alias("file_path"), "text")
    return A.scan_files(files, settings)


_TURN = "concat(coalesce(text, ''), ' mail u', CAST(conv_id AS {text}), '@example.org or 555-', lpad(CAST(conv_id % 1000 AS {text}), 3, '0'), '-', lpad(CAST(turn * 37 % 10000 AS {text}), 4, '0'))"


@register("detect_turns", O.with_views(
    'SELECT conv_id, turn, entity_type, start, "end", score, text FROM spans',
    extra=O.spans_view(None, 0.7, src="turns", id_cols=("conv_id", "turn"),
                       src_sql=f"SELECT conv_id, turn, {_TURN.format(text='VARCHAR')} AS text FROM conversations WHERE role = 'user'")))
def detect_turns(spark, sf):
    """D1 on what users say, each turn with an address and a number of its own."""
    c = read_table(spark, sf, "conversations").where("role = 'user'")
    return D.detect_entities(c.select("conv_id", "turn", F.expr(_TURN.format(text="STRING")).alias("text")), id_cols=("conv_id", "turn"))


@register("metric_rates", O.with_views(
    """SELECT host, round(4096 / dt / 1048576.0, 6) AS disk_read_mb_s, round(1024 / dt / 1048576.0, 6) AS disk_write_mb_s,
         round(n / dt / 1048576.0, 9) AS net_sent_mb_s, round(2 * n / dt / 1048576.0, 9) AS net_recv_mb_s,
         round((w - pw) / dt, 6) AS worker_rate, round(t, 6) AS timestamp_epoch FROM (
         SELECT job_id AS host, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER o AS dt,
           floor(value * 1000)::BIGINT AS n, event_id % 5 + 1 AS w, lag(event_id % 5 + 1) OVER o AS pw
         FROM t_log WINDOW o AS (PARTITION BY job_id ORDER BY ts, event_id)) x WHERE dt > 0""", "t_log"))
def metric_rates(spark, sf):
    """All five rates between the samples of a host."""
    r = MX.metric_rates(MX.metrics_from_log(Testbed(spark, sf).log))
    return r.select("host", *(F.round(c, d).alias(c) for c, d in (
        ("disk_read_mb_s", 6), ("disk_write_mb_s", 6), ("net_sent_mb_s", 9), ("net_recv_mb_s", 9), ("worker_rate", 6),
        ("timestamp_epoch", 6))))


@register("copy_manifest_suffixes", O.ledger_sql(
    f"""SELECT file_path, tier, '/clone/' || {O.sql_pick(P.TIER_NAMES, 'tier')} || '/r' || file_id % 40 || CASE WHEN n > 0 THEN '_' || n ELSE '' END
          || '.txt' AS target_path
        FROM (SELECT *, row_number() OVER (PARTITION BY tier, file_id % 40 ORDER BY file_path) - 1 AS n FROM (
          SELECT file_id, '/c/' || file_id || '/r' || file_id % 40 || '.txt' AS file_path, {O.sql_set_tier('types')} AS tier FROM fs) a
          WHERE tier >= 1) b"""))
def copy_manifest_suffixes(spark, sf):
    """Files that share their names, so most targets need a number."""
    tb = Testbed(spark, sf)
    c = C.classified_files(C.ledger_type_counts(tb.files, tb.results, tb.entities))
    named = c.withColumn("file_path", F.concat(F.lit("/c/"), "file_id", F.lit("/r"), F.col("file_id") % 40, F.lit(".txt")))
    return SK.copy_manifest(named, "/clone", min_tier=1)
