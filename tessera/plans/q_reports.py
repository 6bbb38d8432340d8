"""Source and sink queries (S1-S14) and report texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import bags as B
from ..functions import policy as P
from ..operators import classify as C
from ..operators import detect as D
from ..operators import ledger as L
from ..operators import summary as SM
from ..session import scratch_path
from ..sources import bigjson as BJ
from ..sources import files as FS
from ..sources import listing as LS
from ..sources import metrics as MX
from ..sources import reports as RP
from ..sources import sinks as SK
from ..sources import text as TX
from ..sources import versions as VS
from ..sources import walk as WK
from ..sources.tables import TABLES, read_table
from ..functions.strings import strip_sql
from . import oracle as O
from .registry import register
from .testbed import Testbed

AS_OF = "1999-01-01 00:00:00"


def _tb(spark, sf):
    return Testbed(spark, sf)


def _counts(spark, sf):
    tb = _tb(spark, sf)
    return C.ledger_type_counts(tb.files, tb.results, tb.entities)


def _fe(spark, sf):
    tb = _tb(spark, sf)
    return C.ledger_entities(tb.files, tb.results, tb.entities, 0.7)


def _scratch(spark, name):
    return scratch_path(spark, f"tessera-{name}-{uuid.uuid4().hex[:12]}")


@register("src_listing", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS name, '.parquet' AS file_type, count(*) AS n_rows FROM {t}" for t in TABLES))
def src_listing(spark, sf):
    """The tables' files with their lower-case type and the rows that
    each holds, from the metadata that every scanned row carries."""
    out = None
    for t in TABLES:
        path = read_table(spark, sf, t).select(F.col("_metadata.file_path").alias("file_path"))
        out = path if out is None else out.union(path)
    name = F.regexp_extract("file_path", "/([a-z_]+[.]parquet)(?:/[^/]*)?$", 1)
    files = out.groupBy(name.alias("name")).agg(F.count("*").alias("n_rows"))
    return files.select("name", L.file_type(F.col("name")).alias("file_type"), "n_rows")


_TREE = "concat(coalesce({d}lang, 'none'), '/', {d}doc_id % 3, '/', {d}doc_id % 5, '/', {d}source, '/d', {d}doc_id, CASE {d}doc_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' ELSE '' END)"


@register("src_walk", f"""SELECT {_TREE.format(d='')} AS path, CAST(strlen(text) AS BIGINT) AS file_size,
    CASE doc_id % 4 WHEN 0 THEN '.txt' ELSE '.md' END AS file_type, true AS is_dated
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id % 4 < 2""")
def src_walk(spark, sf):
    """A deep tree of the documents' files, written at their own paths and
    scanned by rounds; extension filter, sizes and times."""
    base = _scratch(spark, "tree")
    docs = read_table(spark, sf, "documents").select(F.expr(_TREE.format(d="")).alias("path"), F.col("text").alias("content"))
    FS.write_files(docs.where("path IS NOT NULL"), base)
    found = WK.walk(spark, base, ["txt", ".md"])
    return found.select(F.regexp_extract("file_path", "/tessera-tree-[0-9a-f]+/(.*)$", 1).alias("path"), "file_size", "file_type",
                        (F.col("modified_time") > F.lit("2020-01-01").cast("timestamp")).alias("is_dated"))


@register("src_ledger_versions", O.with_views(
    """SELECT result_id, file_id, processing_time, CASE WHEN file_id % 2 = 0 THEN 1 ELSE 2 END AS schema_version,
         CASE WHEN file_id % 2 = 0 THEN 'unknown' WHEN file_id % 4 = 0 THEN 'ocr' ELSE 'tika' END AS extraction_method
       FROM t_results""", "t_results"))
def src_ledger_versions(spark, sf):
    """Results of two schema versions, the first without metadata, as one
    table with the first one's default."""
    r, path = _tb(spark, sf).results, _scratch(spark, "versions")
    VS.write_version(r.where("file_id % 2 = 0").drop("metadata"), path, 1)
    VS.write_version(r.where("file_id % 2 = 1"), path, 2)
    back = VS.read_versions(spark, path, r.schema, {"metadata": (2, "{}")}, newest=2)
    return back.select("result_id", "file_id", "processing_time", "schema_version", F.coalesce(
        B.field(B.bag(F.col("metadata")), "$.extraction_method"), F.lit("unknown")).alias("extraction_method"))


_BAGS = """CASE event_id % 7 WHEN 0 THEN substr(props, 1, length(props) - 1) WHEN 1 THEN concat('{"k": {"v": ', event_id, '}, "tags": ["a", "b"]}')
    WHEN 2 THEN '' WHEN 3 THEN '[1, 2, 3]' WHEN 4 THEN NULL WHEN 5 THEN '{"k": "7x", "tags": []}' ELSE props END"""


@register("metadata_bags", f"""SELECT event_id, CASE WHEN NOT ok THEN NULL WHEN t = 'UBIGINT' THEN 'number' ELSE lower(t) END AS kind,
    TRY_CAST(json_extract_string(j, '$.k') AS INT) AS k, TRY_CAST(json_extract_string(j, '$.k.v') AS BIGINT) AS v,
    json_extract_string(j, '$.tags[0]') AS first_tag, CASE WHEN NOT ok THEN bag END AS corrupt
  FROM (SELECT *, json_type(j) AS t FROM (SELECT event_id, bag, ok, CASE WHEN ok THEN bag::JSON END AS j FROM (
    SELECT event_id, bag, json_valid(bag) AS ok FROM (SELECT event_id, {_BAGS} AS bag FROM events) a) b) c) d""")
def metadata_bags(spark, sf):
    """JSON bags of no fixed schema: typed fields by path, texts that are no
    JSON kept in a column."""
    rows = B.with_bag(read_table(spark, sf, "events").select("event_id", F.expr(_BAGS).alias("text")), "text")
    bag = F.col("bag")
    return rows.select("event_id", B.kind(bag).alias("kind"), B.field(bag, "$.k", "int").alias("k"),
                       B.field(bag, "$.k.v", "bigint").alias("v"), B.field(bag, "$.tags[0]").alias("first_tag"), "corrupt")


@register("src_file_list", O.with_views(
    """SELECT l.job_id, l.file_path, NOT EXISTS (SELECT 1 FROM t_files k WHERE k.status = 'completed'
         AND k.job_id = l.job_id AND k.file_path = l.file_path) AS is_new
       FROM t_files l WHERE l.file_path IN (SELECT file_path FROM t_files WHERE coalesce(error_message, '') <> 'No such file')
         AND lower(regexp_extract(regexp_extract(l.file_path, '[^/]*$', 0), '^\\.*[^.].*(\\.[^.]*)$', 1))
             IN ('.csv', '.doc', '.docx', '.eml', '.htm', '.html', '.json', '.markdown', '.md', '.msg', '.pdf',
                 '.ppt', '.pptx', '.rtf', '.tsv', '.txt', '.xls', '.xlsx', '.xml')""", "t_files"))
def src_file_list(spark, sf):
    """Explicit file list -> drop missing and unsupported, flag new ones
    (not yet completed in the ledger)."""
    f = _tb(spark, sf).files
    listed = f.select("job_id", "file_path")
    exists = f.where(F.coalesce(F.col("error_message"), F.lit("")) != "No such file").select("file_path")
    done = f.where(F.col("status") == "completed")
    return LS.file_list_source(listed, exists, done)


@register("src_text", f"SELECT doc_id, {strip_sql('text')} AS text FROM documents WHERE length({strip_sql('text')}) > 0")
def src_text(spark, sf):
    """Trimmed, non-blank text rows."""
    return TX.text_rows(read_table(spark, sf, "documents"))


def _html_sql() -> str:
    t = "html"
    for pattern, by in (("(?is)<script[^>]*>.*?</script>", "' '"), ("(?is)<style[^>]*>.*?</style>", "' '"),
                        ("(?s)<!--.*?-->", "' '"), ("(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)[^>]*>", "chr(10)"),
                        ("<[^>]*>", "' '")):
        t = f"regexp_replace({t}, '{pattern}', {by}, 'g')"
    code = """CASE WHEN lower(substr(r, 3, 1)) = 'x' THEN CAST('0x' || replace(substr(r, 4), ';', '') AS INT)
              ELSE CAST(replace(substr(r, 3), ';', '') AS INT) END"""
    char = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) ELSE r END"
    t = f"""(SELECT array_to_string(list_transform(list_zip(string_split_regex(h, '{TX.NUMERIC}'),
        list_append(list_transform(regexp_extract_all(h, '{TX.NUMERIC}'), lambda r: {char}), '')),
        lambda z: z[1] || z[2]), '') FROM (SELECT {t} AS h) x)"""
    for name, by in TX.ENTITIES:
        t = f"replace({t}, '{name}', {O.q(by)})"
    for pattern, by in (("[ \\t\\r\\f]+", "' '"), (" *\\n[ \\n]*", "chr(10)"), ("^[ \\n]+|[ \\n]+$", "''")):
        t = f"regexp_replace({t}, '{pattern}', {by}, 'g')"
    return t


_HTML_SQL = _html_sql()


@register("html_to_text", f"SELECT page_id, {_HTML_SQL} AS text FROM pages")
def html_to_text(spark, sf):
    """Markup to text on the pages table."""
    p = read_table(spark, sf, "pages")
    return p.select("page_id", TX.html_to_text(F.col("html")).alias("text"))


@register("detect_pages", O.with_views(
    'SELECT page_id, entity_type, start, "end", score, text FROM spans',
    extra=O.spans_view(None, 0.7, src="ptext", id_cols=("page_id",),
                       src_sql=f"SELECT page_id, {_HTML_SQL} AS text FROM pages")))
def detect_pages(spark, sf):
    """S6 + D1: detection on the text of web pages."""
    p = read_table(spark, sf, "pages").select("page_id", TX.html_to_text(F.col("html")).alias("text"))
    return D.detect_entities(p, id_cols=("page_id",))


@register("detect_conversations", O.with_views(
    'SELECT conv_id, turn, entity_type, start, "end", score, text FROM spans',
    extra=O.spans_view(None, 0.7, src="conversations", id_cols=("conv_id", "turn"))))
def detect_conversations(spark, sf):
    """D1 on conversation turns (key = conversation, turn)."""
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return D.detect_entities(c, id_cols=("conv_id", "turn"))


@register("src_json_report", O.ledger_sql(
    "SELECT file_path, entity_type, score FROM fe"))
def src_json_report(spark, sf):
    """S8 -> S3 round trip: export the ledger (entities >= 0.7) as JSON
    lines, read it back with an explicit schema and explode to entities."""
    tb = _tb(spark, sf)
    done = tb.files.where(F.col("status") == "completed")
    rec = RP.nested_records(tb.jobs, done, tb.results, tb.entities, threshold=0.7)
    path = _scratch(spark, "report")
    RP.write_report(rec, path)
    back = RP.read_report_lines(spark, path)
    return RP.report_entities(back).select("file_path", "entity_type", "score")


def _large_report(tb):
    """The whole ledger's completed files as one document."""
    done = tb.files.where(F.col("status") == "completed")
    head = done.agg(F.count("*").alias("processed_files")).select(
        F.lit("scan {all} \"jobs\"").alias("command_line"), F.lit("completed").alias("status"), "processed_files")
    files = done.select(F.col("file_id").alias("record"), "file_path", "file_type", "file_size", "status", "processing_time")
    spans = tb.entities.join(done.select(F.col("file_id").alias("result_id")), "result_id", "left_semi").select(
        F.col("result_id").alias("record"), F.col("start_index").alias("entity"), "entity_type",
        F.col("start_index").alias("start"), F.col("end_index").alias("end"), "score", "text")
    return head, files, spans


@register("src_large_report", O.with_views(
    """SELECT f.file_path, f.file_type, f.file_size, e.entity_type, e.score, e.text, e.start_index AS start, e.end_index AS "end",
         c.n AS processed_files, 'scan {all} "jobs"' AS command_line
       FROM t_files f JOIN t_entities e ON e.result_id = f.file_id, (SELECT count(*) AS n FROM t_files WHERE status = 'completed') c
       WHERE f.status = 'completed'""", "t_files", "t_entities"))
def src_large_report(spark, sf):
    """The ledger written as one JSON document by many tasks, and read
    back by many: every entity with its file's and the report's fields."""
    path = _scratch(spark, "document")
    BJ.write_large_report(*_large_report(_tb(spark, sf)), path)
    back = BJ.read_large_report(spark, path, joined=True, plain=False)
    rows = back.entities.drop("doc").join(back.files.drop("doc", "opened"), "record").join(back.header.drop("doc"), "opened")
    return rows.select("file_path", "file_type", "file_size", "entity_type", "score", "text", "start", "end",
                       "processed_files", "command_line")


@register("export_nested", O.with_views(
    """SELECT f.file_path, f.status, CAST(coalesce(c.n, 0) AS INT) AS n_entities, j.command_line
       FROM t_files f JOIN t_jobs j ON f.job_id = j.job_id
       LEFT JOIN (SELECT result_id, count(*) AS n FROM t_entities GROUP BY result_id) c ON c.result_id = f.file_id
         AND f.file_id IN (SELECT file_id FROM t_results) WHERE f.job_id = 2""",
    "t_files", "t_results", "t_entities", "t_jobs"))
def export_nested(spark, sf):
    """Nested export of one job; a file's entity list stands in records
    by part of the file, so counts are summed per file."""
    tb = _tb(spark, sf)
    rec = RP.nested_records(tb.jobs.where(F.col("job_id") == 2), tb.files.where(F.col("job_id") == 2),
                            tb.results, tb.entities)
    return rec.groupBy("file_path", "status", "command_line").agg(
        F.sum(F.size("entities")).cast("int").alias("n_entities"))


@register("export_filtered", O.ledger_sql(
    """SELECT job_id, count(DISTINCT file_path) AS files, count(*) AS entities, round(avg(score), 6) AS avg_score
       FROM fe GROUP BY job_id"""))
def export_filtered(spark, sf):
    """Threshold-filtered export (completed files with results, entities
    >= 0.7) with its processing header, summarised per job."""
    tb = _tb(spark, sf)
    done = tb.files.where(F.col("status") == "completed").join(tb.results.select("file_id"), "file_id", "left_semi")
    rec = RP.nested_records(tb.jobs, done, tb.results, tb.entities, threshold=0.7, mask=False)
    ex = rec.select("job_id", "file_path", F.explode("entities").alias("e"))
    return ex.groupBy("job_id").agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("entities"),
                                    F.round(F.avg("e.score"), 6).alias("avg_score"))


@register("src_metrics_jsonl", O.with_views(
    """SELECT host, round(disk_read_mb_s, 6) AS disk_read_mb_s, round(disk_write_mb_s, 6) AS disk_write_mb_s,
         round(worker_rate, 6) AS worker_rate FROM (
         SELECT job_id AS host, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS dt,
           4096 / (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w) / 1048576.0 AS disk_read_mb_s,
           4096 / 4 / (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w) / 1048576.0 AS disk_write_mb_s,
           (event_id % 5 + 1 - lag(event_id % 5 + 1) OVER w) / (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w) AS worker_rate
         FROM t_log WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) x WHERE dt > 0""", "t_log"))
def src_metrics_jsonl(spark, sf):
    """S7 + W4: metric samples written as JSON lines, read back with an
    explicit nested schema, then per-host rates between samples."""
    samples = MX.metrics_from_log(_tb(spark, sf).log)
    path = _scratch(spark, "metrics")
    samples.write.mode("overwrite").json(path)
    r = MX.metric_rates(MX.read_metrics(spark, path))
    return r.select("host", *(F.round(c, 6).alias(c) for c in ("disk_read_mb_s", "disk_write_mb_s", "worker_rate")))


@register("sink_results", O.with_views(
    """SELECT entity_type, count(*) AS n FROM spans GROUP BY entity_type""", extra=O.spans_view(None, 0.7)))
def sink_results(spark, sf):
    """Append results + entities (partitioned by type) and read the
    entity table back, counted per partition."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    base = _scratch(spark, "sink")
    # results and entities both come from the written spans: one detector run
    D.detect_arrays(docs).write.parquet(f"{base}/spans")
    spans = spark.read.parquet(f"{base}/spans")
    SK.write_results(SK.results_from_spans(spans), SK.entities_from_spans(spans), base, mode="overwrite")
    back = spark.read.parquet(f"{base}/entities")
    return back.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@register("output_path", O.with_views(
    """SELECT file_id,
         '/out/' || substr(regexp_extract(file_path, '[^/]*$', 0), 1, length(regexp_extract(file_path, '[^/]*$', 0))
           - length(regexp_extract(regexp_extract(file_path, '[^/]*$', 0), '^\\.*[^.].*(\\.[^.]*)$', 1))) || '.json' AS json_path,
         regexp_extract(file_path, '^(.*)/[^/]*$', 1) || '/' || substr(regexp_extract(file_path, '[^/]*$', 0), 1,
           length(regexp_extract(file_path, '[^/]*$', 0))
           - length(regexp_extract(regexp_extract(file_path, '[^/]*$', 0), '^\\.*[^.].*(\\.[^.]*)$', 1))) || '.txt' AS beside_path,
         '/out/' || regexp_replace(file_path, '^/corpus/', '') AS mirror_path
       FROM t_files""", "t_files"))
def output_path(spark, sf):
    """Output paths: into a folder with a new extension, beside the
    input with the default .txt, and mirrored relative to the scan root."""
    f = _tb(spark, sf).files
    p = F.col("file_path")
    return f.select("file_id", SK.output_path(p, "/out", "json").alias("json_path"),
                    SK.output_path(p, None).alias("beside_path"),
                    SK.relative_output(p, "/corpus", "/out").alias("mirror_path"))


@register("copy_manifest", O.ledger_sql(
    f"""SELECT file_path, tier, '/clone/' || {O.sql_pick(P.TIER_NAMES, 'tier')} || '/' ||
          CASE WHEN n = 0 THEN base ELSE substr(base, 1, length(base) - length(ext)) || '_' || n || ext END AS target_path
        FROM (SELECT file_path, tier, base, ext,
                row_number() OVER (PARTITION BY tier, base ORDER BY file_path) - 1 AS n
              FROM (SELECT file_path, {O.sql_set_tier('types')} AS tier, regexp_extract(file_path, '[^/]*$', 0) AS base,
                      regexp_extract(regexp_extract(file_path, '[^/]*$', 0), '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext
                    FROM fs) a WHERE tier >= 2) b"""))
def copy_manifest(spark, sf):
    """Copy plan of classified files (tier >= 2) into tier folders,
    with _1, _2 ... suffixes for repeated basenames."""
    c = C.classified_files(_counts(spark, sf))
    return SK.copy_manifest(c, "/clone", min_tier=2)


def _report_lines_sql():
    cat = O.sql_display("entity_type", P.STRICT_DISPLAY_NAMES)
    mask = O.sql_mask_strict("s.text", "s.entity_type")
    t = "b.types"
    reasons = (f"list_filter([CASE WHEN {O.sql_has_name(t)} AND {O.sql_sensitive(t)} THEN "
               f"'  - Contains personally identifiable information AND sensitive data' END, "
               f"CASE WHEN {O.sql_cred(t)} THEN "
               f"'  - Contains credential pair (username/email + password/access code)' END], lambda x: x IS NOT NULL)")
    sep = "-" * 80
    return O.ledger_sql(f"""
SELECT CAST(file_rank AS BIGINT) AS file_rank, CAST(ord AS INT) AS ord, line FROM (
  SELECT 0 AS file_rank, 0 AS ord, {O.q(SM.REPORT_TITLE)} AS line
  UNION ALL SELECT 0, 1, 'Generated: {AS_OF}' UNION ALL SELECT 0, 2, ''
  UNION ALL SELECT 0, 3, {O.q(SM.REPORT_INTRO)} UNION ALL SELECT 0, 4, ''
  UNION ALL SELECT {SM.LAST_RANK}, 0, '' UNION ALL SELECT {SM.LAST_RANK}, 1, 'Found ' || (SELECT count(*) FROM b) || ' {SM.REPORT_FOUND}'
  UNION ALL SELECT {SM.LAST_RANK}, 2, {O.q(SM.REPORT_LAW)}
  UNION ALL SELECT file_rank, 0 AS ord, 'File: ' || file_path AS line FROM b
  UNION ALL SELECT file_rank, 1, 'Number of entities: ' || entity_count FROM b
  UNION ALL SELECT file_rank, 2, 'Classification: ' || label FROM b
  UNION ALL SELECT file_rank, {SM.TYPES}, 'Entity types:' FROM b
  UNION ALL SELECT file_rank, {SM.REASONS}, 'Breach notification trigger reason:' FROM b
  UNION ALL SELECT file_rank, {SM.SAMPLES}, 'Sample entities (max 3 per type):' FROM b
  UNION ALL SELECT file_rank, {SM.END}, '{sep}' FROM b
  UNION ALL SELECT file_rank, CAST({SM.REASONS} + k AS INT), r FROM (
      SELECT file_rank, unnest({reasons}) AS r, generate_subscripts({reasons}, 1) AS k FROM b) x
  UNION ALL SELECT file_rank, CAST(cr + {SM.TYPES} AS INT), '  - ' || category || ': ' || n FROM c
  UNION ALL SELECT file_rank, CAST({SM.SAMPLES} + cr * 10 AS INT), '  ' || category || ':' FROM c
  UNION ALL SELECT s.file_rank, CAST({SM.SAMPLES} + c.cr * 10 + s.sn AS INT),
      '    - ' || {mask} || ' (confidence: ' || printf('%.2f', s.score) || ')'
    FROM s JOIN c ON s.file_rank = c.file_rank AND s.category = c.category WHERE s.sn <= 3
) u""", ("b", f"""SELECT file_id, file_path, entity_count, types, {O.sql_label('types')} AS label,
        row_number() OVER (ORDER BY entity_count DESC, file_path) AS file_rank
      FROM fs WHERE {O.sql_trigger('types')}"""),
        ("e", f"SELECT fe.*, b.file_rank, {cat} AS category FROM fe JOIN b ON fe.file_id = b.file_id"),
        ("c", """SELECT file_rank, category, count(*) AS n,
        row_number() OVER (PARTITION BY file_rank ORDER BY count(*) DESC, category) AS cr
      FROM e GROUP BY file_rank, category"""),
        ("s", """SELECT *, row_number() OVER (PARTITION BY file_rank, category
        ORDER BY start_index, end_index, entity_type, text, score) AS sn FROM e"""))


@register("report_lines", _report_lines_sql())
def report_lines(spark, sf):
    """The detailed strict-policy report as ordered line rows."""
    return SM.breach_report_lines(_fe(spark, sf), AS_OF)


def _tier_lines_sql():
    tier = O.sql_type_tier("entity_type")
    words = "[" + ", ".join(O.q(t.split()[1]) for t in P.TIER_NAMES) + "]"
    sep = O.q(SM.SEPARATOR)
    return O.ledger_sql(f"""
SELECT CAST(tier_order AS INT) AS tier_order, file_path, CAST(ord AS INT) AS ord, line FROM (
  SELECT -1 AS tier_order, '' AS file_path, 0 AS ord, {O.q(SM.DETAIL_TITLE)} AS line
  UNION ALL SELECT -1, '', 1, 'Generated: {AS_OF}' UNION ALL SELECT -1, '', 2, 'Total Files: ' || (SELECT count(*) FROM b)
  UNION ALL SELECT -1, '', 3, {sep}
  UNION ALL SELECT 3 - tier, file_path, 0, 'File: ' || file_path FROM b
  UNION ALL SELECT 3 - tier, file_path, 1, 'Classification: ' || {O.sql_pick(P.TIER_NAMES, 'tier')} FROM b
  UNION ALL SELECT 3 - tier, file_path, 2, 'Entities:' FROM b
  UNION ALL SELECT 3 - tier, file_path, {SM.END}, {sep} FROM b
  UNION ALL SELECT 3 - tier, file_path, spot, '  - ' || {O.sql_display('entity_type', P.TIER_DISPLAY_NAMES)} || ' (' || ({words})[tt + 1] || '):' FROM t
  UNION ALL SELECT 3 - tier, file_path, spot + {SM.DETAIL_EXAMPLES + 1}, '    ... and ' || (n - {SM.DETAIL_EXAMPLES}) || ' more instances'
    FROM t WHERE n > {SM.DETAIL_EXAMPLES}
  UNION ALL SELECT 3 - t.tier, t.file_path, t.spot + x.rn,
      '    ' || {O.sql_mask_tiered('x.text', 'x.entity_type')} || ' (confidence: ' || printf('%.2f', x.score) || ')'
    FROM x JOIN t ON t.file_id = x.file_id AND t.entity_type = x.entity_type WHERE x.rn <= {SM.DETAIL_EXAMPLES}
) u""", ("b", f"SELECT file_id, file_path, {O.sql_set_tier('types')} AS tier FROM fs"),
        ("t", f"""SELECT b.*, g.entity_type, g.n, g.tt, 10 * row_number() OVER (PARTITION BY b.file_id ORDER BY g.tt DESC, g.entity_type) AS spot
      FROM b JOIN (SELECT file_id, entity_type, count(*) AS n, {tier} AS tt FROM fe GROUP BY file_id, entity_type) g
        ON g.file_id = b.file_id"""),
        ("x", """SELECT *, row_number() OVER (PARTITION BY file_id, entity_type
        ORDER BY score DESC, start_index, end_index, text) AS rn FROM fe"""))


@register("tier_report_lines", _tier_lines_sql())
def tier_report_lines(spark, sf):
    """The detailed tier report as ordered line rows."""
    return SM.tier_report_lines(_fe(spark, sf), _counts(spark, sf), AS_OF)


def _summary_head_sql(title: str, label_blocks: str, ctes: list[tuple[str, str]]) -> str:
    from .q_time import ETA_PENDING_SQL
    return O.with_views(f"""
SELECT section, ord, line FROM (
  SELECT 0 AS section, 0 AS ord, {O.q(title)} AS line
  UNION ALL SELECT 0, 1, 'Generated: {AS_OF}' UNION ALL SELECT 0, 2, ''
  UNION ALL SELECT 10, 0, 'Files Registered in Database: ' || reg FROM cnt
  UNION ALL SELECT 10, 1, 'Analysis Progress:' FROM cnt
  UNION ALL SELECT 10, 2, '  Completed: ' || done || ' files (' || printf('%.1f', done * 100.0 / reg) || '% of registered)' FROM cnt
  UNION ALL SELECT 10, 3, '  Pending: ' || pend || ' files' FROM cnt
  UNION ALL SELECT 10, 4, '  In Progress: ' || proc || ' files' FROM cnt
  UNION ALL SELECT 10, 5, '  Error: ' || err || ' files' FROM cnt
  UNION ALL SELECT 10, 6, 'Processing Time Statistics:' FROM eta
  UNION ALL SELECT 10, 7, '  Total Processing Time: ' || elapsed_time_formatted FROM eta
  UNION ALL SELECT 10, 8, '  Processing Rate: ' || printf('%.1f', files_per_hour) || ' files/hour' FROM eta
  UNION ALL SELECT 10, 9, '  Estimated Time to Completion: ' || estimated_completion_time FROM eta
    WHERE estimated_completion_hours > 0
  UNION ALL SELECT 20, 0, 'File Types:'
  UNION ALL SELECT 20, CAST(row_number() OVER (ORDER BY n DESC, file_type) AS INT), '  ' || file_type || ': ' || n || ' files'
    FROM (SELECT file_type, count(*) AS n FROM t_files WHERE file_type IS NOT NULL AND file_type <> '' GROUP BY 1) t
  {label_blocks}
) x""", "t_files", "t_results", "t_entities", "t_jobs", extra=[
        ("fe", O.LEDGER_FE), ("fs", O.LEDGER_FS),
        ("cnt", """SELECT count(*) AS reg, count(*) FILTER (WHERE status = 'completed') AS done,
                  count(*) FILTER (WHERE status = 'pending') AS pend, count(*) FILTER (WHERE status = 'processing') AS proc,
                  count(*) FILTER (WHERE status = 'error') AS err FROM t_files"""),
        *ctes, ("eta", "SELECT * FROM (" + ETA_PENDING_SQL + ") e ORDER BY job_id DESC LIMIT 1")])


def _breach_summary_sql() -> str:
    from ..operators import summary as SMM
    label_order = " ".join(f"WHEN {O.q(lab)} THEN {i}" for i, (_, lab) in enumerate(sorted(P.BREACH_LABELS)))
    risk = " ".join(f"WHEN {O.q(lab)} THEN {i + 1}" for i, (lab, _) in enumerate(SMM.RISK_AREAS))
    risk_txt = " ".join(f"WHEN {O.q(lab)} THEN {O.q(t)}" for lab, t in SMM.RISK_AREAS)
    blocks = f"""
  UNION ALL SELECT 30, 0, ''
  UNION ALL SELECT 30, 1, 'HIGH-RISK FILES: ' || count(*) || ' files contain personal information subject to breach notification' FROM b
  UNION ALL SELECT 31, 0, '' UNION ALL SELECT 31, 1, 'Files by Risk Category:'
  UNION ALL SELECT 40, CASE label {label_order} END, '  ' || label || ': ' || count(*) || ' files' FROM b GROUP BY label
  UNION ALL SELECT 45, 0, '' UNION ALL SELECT 45, 1, 'Top Risk Areas:'
  UNION ALL SELECT 50, CASE label {risk} END, '  • ' || count(*) || ' ' || CASE label {risk_txt} END FROM b
    WHERE label IN ({', '.join(O.q(lab) for lab, _ in SMM.RISK_AREAS)}) GROUP BY label"""
    b = ("b", f"SELECT {O.sql_label('types')} AS label FROM fs WHERE {O.sql_trigger('types')}")
    return _summary_head_sql(SMM.BREACH_TITLE, blocks, [b])


def _tier_summary_sql() -> str:
    from ..operators import summary as SMM
    tier = O.sql_set_tier("types")
    blocks = f"""
  UNION ALL SELECT 30, 0, ''
  UNION ALL SELECT 30, 1, 'Classified Files: ' || count(*) || ' files contain sensitive information' FROM c
  UNION ALL SELECT 31, 0, '' UNION ALL SELECT 31, 1, 'Classification Summary:'
  UNION ALL SELECT 40, tier, '  ' || {O.sql_pick(P.TIER_NAMES, 'tier')} || ': ' || count(*) || ' files' FROM c GROUP BY tier
  UNION ALL SELECT 45, 0, '' UNION ALL SELECT 45, 1, 'Top Sensitive Entity Types by Tier:'
  UNION ALL SELECT DISTINCT 50, (3 - tier) * 100000000, '  ' || {O.sql_pick(P.TIER_NAMES, 'tier')} || ':' FROM tt
  UNION ALL SELECT 50, CAST((3 - tier) * 100000000 + row_number() OVER (PARTITION BY tier ORDER BY name) AS INT), '    • ' || name
    FROM (SELECT DISTINCT tier, name FROM tt) z"""
    c = ("c", f"SELECT file_id, types, {tier} AS tier FROM fs WHERE {tier} >= 1")
    tt = ("tt", f"""SELECT tier, {O.sql_display('t', P.TIER_DISPLAY_NAMES)} AS name
                    FROM (SELECT tier, unnest(types) AS t FROM c) u WHERE {O.sql_type_tier('t')} = tier""")
    return _summary_head_sql(SMM.TIER_TITLE, blocks, [c, tt])


@register("exec_summary_breach", _breach_summary_sql())
def exec_summary_breach(spark, sf):
    """Strict-policy executive summary lines (as_of fixed)."""
    tb = _tb(spark, sf)
    return SM.breach_summary_lines(spark, tb.files, tb.jobs, _counts(spark, sf), AS_OF)


@register("exec_summary_tier", _tier_summary_sql())
def exec_summary_tier(spark, sf):
    """Tier-policy executive summary lines (min tier 1, as_of fixed)."""
    tb = _tb(spark, sf)
    return SM.tier_summary_lines(spark, tb.files, tb.jobs, _counts(spark, sf), AS_OF)
