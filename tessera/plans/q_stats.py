"""Aggregations (G1-G23), top-k (T3-T11), error triage (E1-E3), unions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import masks as M
from ..operators import classify as C
from ..operators import errors as E
from ..operators import ledger as L
from ..functions.strings import strip_sql
from ..operators import timeseries as TS
from . import oracle as O
from .registry import ORACLES, register
from .testbed import Testbed

STATUSES = ["pending", "processing", "completed", "error"]


def _tb(spark, sf):
    return Testbed(spark, sf)


def _fe(spark, sf, threshold=0.7):
    tb = _tb(spark, sf)
    return C.ledger_entities(tb.files, tb.results, tb.entities, threshold)


# ------------------------------------------------------------------ counts
@register("status_counts", O.with_views(
    "SELECT job_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES)
    + ", count(*) AS total_registered FROM t_files GROUP BY job_id", "t_files"))
def status_counts(spark, sf):
    """G1: zero-filled counts of the fixed statuses per job, and the total."""
    f = _tb(spark, sf).files
    return f.groupBy("job_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
                                   F.count(F.lit(1)).alias("total_registered"))


@register("type_counts", O.with_views(
    "SELECT file_type, count(*) AS files FROM t_files WHERE file_type IS NOT NULL AND file_type <> '' "
    "GROUP BY file_type", "t_files"))
def type_counts(spark, sf):
    """Files per type (blank types dropped)."""
    f = _tb(spark, sf).files.where(F.col("file_type").isNotNull() & (F.col("file_type") != ""))
    return f.groupBy("file_type").agg(F.count(F.lit(1)).alias("files"))


@register("inspect_counts", O.with_views(
    """SELECT job_id, status, file_type, CAST(GROUPING(job_id, status, file_type) AS INT) AS gid, count(*) AS files
       FROM t_files GROUP BY GROUPING SETS ((job_id, status), (job_id, file_type), ())""", "t_files"))
def inspect_counts(spark, sf):
    """(job,status), (job,type) and overall counts in one grouping-sets
    aggregate (one scan, one shuffle)."""
    f = _tb(spark, sf).files
    g = f.groupingSets([["job_id", "status"], ["job_id", "file_type"], []], "job_id", "status", "file_type")
    return g.agg(F.grouping_id("job_id", "status", "file_type").cast("int").alias("gid"),
                 F.count(F.lit(1)).alias("files"))


@register("entity_counts", O.ledger_sql("SELECT entity_type, count(*) AS n FROM fe GROUP BY entity_type"))
def entity_counts(spark, sf):
    """Entities >= 0.7 of completed files per type."""
    return _fe(spark, sf).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@register("entity_counts_all", O.with_views(
    """SELECT e.entity_type, count(*) AS n FROM t_entities e JOIN t_results r ON e.result_id = r.result_id
       JOIN t_files f ON r.file_id = f.file_id GROUP BY e.entity_type""", "t_files", "t_results", "t_entities"))
def entity_counts_all(spark, sf):
    """Entity counts per type, any status, no threshold."""
    tb = _tb(spark, sf)
    ents = C.ledger_entities(tb.files, tb.results, tb.entities, None, completed_only=False)
    return ents.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@register("avg_time", O.with_views(
    """SELECT j.job_id, round(coalesce(a.avg_time, 0.0), 6) AS avg_time FROM t_jobs j LEFT JOIN (
         SELECT f.job_id, avg(r.processing_time) AS avg_time FROM t_results r JOIN t_files f ON r.file_id = f.file_id
         WHERE f.status = 'completed' GROUP BY f.job_id) a ON j.job_id = a.job_id""", "t_jobs", "t_files", "t_results"))
def avg_time(spark, sf):
    """Mean processing time of completed files per job, 0 if none."""
    tb = _tb(spark, sf)
    a = tb.results.join(tb.files.where(F.col("status") == "completed").select("file_id", "job_id"), "file_id") \
        .groupBy("job_id").agg(F.avg("processing_time").alias("a"))
    return tb.jobs.select("job_id").join(a, "job_id", "left").select(
        "job_id", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("avg_time"))


@register("job_statistics", O.with_views(
    """SELECT j.job_id, j.total_files, t.n_types, t.pdf_files, e.n_entity_types, e.person_entities,
         round(coalesce(a.avg_time, 0.0), 6) AS avg_time
       FROM t_jobs j
       LEFT JOIN (SELECT job_id, count(DISTINCT file_type) AS n_types,
                    count(*) FILTER (WHERE file_type = '.pdf') AS pdf_files FROM t_files GROUP BY job_id) t
         ON j.job_id = t.job_id
       LEFT JOIN (SELECT f.job_id, count(DISTINCT e.entity_type) AS n_entity_types,
                    count(*) FILTER (WHERE e.entity_type = 'PERSON') AS person_entities
                  FROM t_entities e JOIN t_results r ON e.result_id = r.result_id JOIN t_files f ON r.file_id = f.file_id
                  GROUP BY f.job_id) e ON j.job_id = e.job_id
       LEFT JOIN (SELECT f.job_id, avg(r.processing_time) AS avg_time FROM t_results r
                  JOIN t_files f ON r.file_id = f.file_id WHERE f.status = 'completed' GROUP BY f.job_id) a
         ON j.job_id = a.job_id""", "t_jobs", "t_files", "t_results", "t_entities"))
def job_statistics(spark, sf):
    """Job row + file-type map + entity-type map + mean time.  The maps
    are built per job from bounded (type, count) rows and read back."""
    tb = _tb(spark, sf)
    types = tb.files.groupBy("job_id", "file_type").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("file_type", "n"))).alias("type_map"))
    ents = C.ledger_entities(tb.files, tb.results, tb.entities, None, completed_only=False)
    emap = ents.groupBy("job_id", "entity_type").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "n"))).alias("entity_map"))
    a = avg_time(spark, sf)
    j = tb.jobs.select("job_id", "total_files").join(types, "job_id", "left").join(emap, "job_id", "left") \
        .join(a, "job_id", "left")
    return j.select("job_id", "total_files", F.size("type_map").cast("long").alias("n_types"),
                    F.element_at("type_map", F.lit(".pdf")).alias("pdf_files"),
                    F.size("entity_map").cast("long").alias("n_entity_types"),
                    F.element_at("entity_map", F.lit("PERSON")).alias("person_entities"), "avg_time")


@register("run_summary", O.with_views(
    """SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'completed') AS processed,
         count(*) FILTER (WHERE status = 'error') AS failed,
         (SELECT count(*) FROM t_entities e JOIN t_results r ON e.result_id = r.result_id) AS total_entities,
         round(sum(processing_time) FILTER (WHERE status = 'completed'), 6) AS total_time,
         round(avg(processing_time) FILTER (WHERE status = 'completed'), 6) AS avg_time,
         max(processing_time) FILTER (WHERE status = 'completed') AS max_time
       FROM t_files""", "t_files", "t_results", "t_entities"))
def run_summary(spark, sf):
    """One-row run summary (files, processed, failed, entities, times)."""
    tb = _tb(spark, sf)
    done = F.col("status") == "completed"
    s = tb.files.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(done).alias("processed"),
                     F.count_if(F.col("status") == "error").alias("failed"),
                     F.round(F.sum(F.when(done, F.col("processing_time"))), 6).alias("total_time"),
                     F.round(F.avg(F.when(done, F.col("processing_time"))), 6).alias("avg_time"),
                     F.max(F.when(done, F.col("processing_time"))).alias("max_time"))
    n = tb.entities.join(tb.results.select("result_id"), "result_id").agg(F.count(F.lit(1)).alias("total_entities"))
    return _with_scalars(s, n).select("total_files", "processed", "failed", "total_entities", "total_time",
                                      "avg_time", "max_time")


def _with_scalars(a, b):
    """Attach the columns of the one-row aggregate ``b`` to ``a`` as scalar
    subqueries (no join at all)."""
    for c in b.columns:
        a = a.withColumn(c, b.select(c).scalar())
    return a


@register("entity_share", O.ledger_sql(
    "SELECT entity_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage "
    "FROM fe GROUP BY entity_type"))
def entity_share(spark, sf):
    """Share of each type in all entities >= 0.7 (zero-safe)."""
    c = _fe(spark, sf).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())
    return c.select("entity_type", "n", F.round(F.when(tot > 0, F.col("n") * 100.0 / tot), 6).alias("percentage"))


@register("type_success_rate", O.with_views(
    """SELECT file_type, count(*) FILTER (WHERE status = 'completed') AS success,
         count(*) FILTER (WHERE status = 'error') AS errors,
         round(CASE WHEN count(*) FILTER (WHERE status IN ('completed', 'error')) > 0 THEN
           count(*) FILTER (WHERE status = 'completed') * 100.0 / count(*) FILTER (WHERE status IN ('completed', 'error'))
           ELSE 0.0 END, 6) AS success_rate
       FROM t_files WHERE status IN ('completed', 'error') GROUP BY file_type""", "t_files"))
def type_success_rate(spark, sf):
    """Success, errors and rate per type over the union of keys."""
    f = _tb(spark, sf).files.where(F.col("status").isin("completed", "error"))
    g = f.groupBy("file_type").agg(F.count_if(F.col("status") == "completed").alias("success"),
                                   F.count_if(F.col("status") == "error").alias("errors"))
    tot = F.col("success") + F.col("errors")
    return g.select("file_type", "success", "errors",
                    F.round(F.when(tot > 0, F.col("success") * 100.0 / tot).otherwise(F.lit(0.0)), 6)
                    .alias("success_rate"))


# ------------------------------------------------------------------ errors
def _cat_sql(p="file_path", s="file_size", m="error_message"):
    msg = f"lower(coalesce({m}, ''))"
    parts = [f"WHEN starts_with(regexp_extract({p}, '[^/]*$', 0), '~$') THEN 'temp_files'"]
    for name, pats in E.CASCADE:
        cond = " OR ".join(f"contains({msg}, {O.q(x)})" for x in pats)
        if name == "empty_files":
            cond = f"coalesce({s}, 0) = 0 OR " + cond
        parts.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


def _ft_sql(p="file_path"):
    return f"lower(regexp_extract(regexp_extract({p}, '[^/]*$', 0), '^\\.*[^.].*(\\.[^.]*)$', 1))"


def _title_sql(c):
    return f"(CASE {c} " + " ".join(
        f"WHEN '{k}' THEN '{k.replace('_', ' ').title()}'" for k in E.CATEGORIES) + " END)"


_ERR_CTE = ("ef", f"SELECT *, {_cat_sql()} AS category FROM t_files WHERE status = 'error'")


@register("error_category", O.with_views(
    "SELECT file_id, category FROM ef", "t_files", extra=[_ERR_CTE]))
def error_category(spark, sf):
    """Category of every error file (cascade order)."""
    return E.categorised(_tb(spark, sf).files).select("file_id", "category")


@register("error_categories", O.with_views(
    f"""SELECT {_title_sql('category')} AS name, count(*) AS count,
          round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM ef GROUP BY category""",
    "t_files", extra=[_ERR_CTE]))
def error_categories(spark, sf):
    """Count and share per error category."""
    c = E.category_counts(_tb(spark, sf).files)
    return c.select("name", "count", F.round("percentage", 6).alias("percentage"))


@register("error_extensions", O.with_views(
    f"""SELECT CASE WHEN ext = '' THEN '(no extension)' ELSE ext END AS extension, count, percentage FROM (
          SELECT {_ft_sql()} AS ext,
            count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage
          FROM ef GROUP BY 1 ORDER BY count DESC, ext ASC LIMIT 20) x""", "t_files", extra=[_ERR_CTE]))
def error_extensions(spark, sf):
    """Top 20 extensions of error files with share."""
    c = E.extension_counts(_tb(spark, sf).files)
    return c.select("extension", "count", F.round("percentage", 6).alias("percentage"))


@register("error_samples", O.with_views(
    f"""SELECT {_title_sql('category')} AS category, CAST(rn AS INT) AS rn, file_path, coalesce(error_message, '') AS error FROM (
          SELECT *, row_number() OVER (PARTITION BY category ORDER BY file_path, file_id) AS rn FROM ef) x
        WHERE rn <= 5""", "t_files", extra=[_ERR_CTE]))
def error_samples(spark, sf):
    """First five error files per category by path."""
    return E.samples(_tb(spark, sf).files)


@register("error_patterns", O.with_views(
    f"""SELECT CASE WHEN length({strip_sql("split_part(coalesce(error_message, ''), chr(10), 1)")}) = 0 THEN 'Unknown error'
         ELSE split_part(coalesce(error_message, ''), chr(10), 1) END AS pattern, count(*) AS count
       FROM t_files WHERE status = 'error' GROUP BY 1""", "t_files"))
def error_patterns(spark, sf):
    """Error counts by first message line."""
    return E.error_patterns(_tb(spark, sf).files)


@register("error_display", O.with_views(
    f"""SELECT file_id, {_title_sql('category')} AS category,
          CASE WHEN length(file_path) > 60 THEN left(file_path, 60) || '...' ELSE file_path END AS path_short,
          CASE WHEN length(coalesce(error_message, '')) > 100 THEN left(error_message, 100) || '...'
               ELSE coalesce(error_message, '') END AS message_short FROM ef""", "t_files", extra=[_ERR_CTE]))
def error_display(spark, sf):
    """Title-cased categories and truncated path/message."""
    c = E.categorised(_tb(spark, sf).files)
    return c.select("file_id", E.display_category(F.col("category")).alias("category"),
                    E.truncate(F.col("file_path"), E.PATH_WIDTH).alias("path_short"),
                    E.truncate(F.coalesce(F.col("error_message"), F.lit("")), E.MESSAGE_WIDTH).alias("message_short"))


@register("error_report", O.with_views(
    f"""SELECT (SELECT count(*) FROM ef) AS total_errors, (SELECT count(DISTINCT category) FROM ef) AS n_categories,
          (SELECT count(DISTINCT {_ft_sql()}) FROM ef) AS n_extensions,
          (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY category ORDER BY file_path, file_id) AS rn
                                 FROM ef) s WHERE rn <= 5) AS n_samples""", "t_files", extra=[_ERR_CTE]))
def error_report(spark, sf):
    """The report's headline numbers (total, categories, extensions,
    samples) — the parts are error_categories/error_extensions/error_samples."""
    f = _tb(spark, sf).files
    c = E.categorised(f)
    head = c.agg(F.count(F.lit(1)).alias("total_errors"), F.count_distinct("category").alias("n_categories"),
                 F.count_distinct(L.file_type(F.col("file_path"))).alias("n_extensions"))
    s = E.samples(f).agg(F.count(F.lit(1)).alias("n_samples"))
    return _with_scalars(head, s)


@register("error_report_rows", f"""
SELECT 'category' AS section, name AS item, '' AS detail, count, round(percentage, 6) AS percentage FROM ({ORACLES['error_categories']}) a
UNION ALL SELECT 'extension', extension, '', count, round(percentage, 6) FROM ({ORACLES['error_extensions']}) b
UNION ALL SELECT 'pattern', pattern, '', count, NULL FROM ({ORACLES['error_patterns']}) c
UNION ALL SELECT 'sample', category, file_path || ': ' || error, rn, NULL FROM ({ORACLES['error_samples']}) d""")
def error_report_rows(spark, sf):
    """The whole error report as one result: categories, extensions,
    messages and samples."""
    f = _tb(spark, sf).files
    none = F.lit(None).cast("double")
    shares = F.round("percentage", 6).alias("percentage")
    return (E.category_counts(f).select(F.lit("category").alias("section"), F.col("name").alias("item"),
                                        F.lit("").alias("detail"), "count", shares)
            .unionByName(E.extension_counts(f).select(F.lit("extension").alias("section"), F.col("extension").alias("item"),
                                                      F.lit("").alias("detail"), "count", shares))
            .unionByName(E.error_patterns(f).select(F.lit("pattern").alias("section"), F.col("pattern").alias("item"),
                                                    F.lit("").alias("detail"), "count", none.alias("percentage")))
            .unionByName(E.samples(f).select(
                F.lit("sample").alias("section"), F.col("category").alias("item"),
                F.concat_ws(": ", "file_path", "error").alias("detail"), F.col("rn").cast("long").alias("count"),
                none.alias("percentage"))))


# ------------------------------------------------------------------ top-k
@register("sample_files", O.with_views(
    "SELECT file_id, file_path FROM t_files ORDER BY file_path, file_id LIMIT 10", "t_files"))
def sample_files(spark, sf):
    """First ten files in path order."""
    return _tb(spark, sf).files.orderBy("file_path", "file_id").limit(10).select("file_id", "file_path")


@register("slowest_files", O.with_views(
    "SELECT file_path, processing_time FROM t_files WHERE status = 'completed' "
    "ORDER BY processing_time DESC, file_path LIMIT 10", "t_files"))
def slowest_files(spark, sf):
    """T4: slowest ten completed files (TakeOrderedAndProject)."""
    f = _tb(spark, sf).files.where(F.col("status") == "completed")
    return f.orderBy(F.desc("processing_time"), "file_path").limit(10).select("file_path", "processing_time")


@register("top_entities", O.ledger_sql(
    "SELECT entity_type, count(*) AS n FROM fe GROUP BY entity_type ORDER BY n DESC, entity_type LIMIT 10"))
def top_entities(spark, sf):
    """T5: ten most frequent entity types."""
    c = _fe(spark, sf).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "entity_type").limit(10)


@register("top_highrisk", O.ledger_sql(
    f"""SELECT file_path, entity_count, (SELECT count(*) FROM fs WHERE {O.sql_trigger('types')}) > 50 AS has_more
        FROM fs WHERE {O.sql_trigger('types')} ORDER BY entity_count DESC, file_path LIMIT 50"""))
def top_highrisk(spark, sf):
    """T5: 50 highest-count breach files, plus whether more exist."""
    b = C.breach_files(_fe(spark, sf))
    top = b.orderBy(F.desc("entity_count"), "file_path").limit(50).select("file_path", "entity_count")
    more = b.agg((F.count(F.lit(1)) > 50).alias("has_more"))
    return _with_scalars(top, more)


@register("top9_other", O.ledger_sql(
    """SELECT CASE WHEN rn <= 9 THEN entity_type ELSE 'Other' END AS label, sum(n) AS n FROM (
         SELECT entity_type, n, row_number() OVER (ORDER BY n DESC, entity_type) AS rn FROM (
           SELECT entity_type, count(*) AS n FROM fe GROUP BY entity_type) a) b GROUP BY 1""").replace(
    "sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n"))
def top9_other(spark, sf):
    """Nine largest types and an 'Other' bucket (window over the small,
    aggregated type table)."""
    c = _fe(spark, sf).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.orderBy(F.desc("n"), "entity_type"))
    r = c.withColumn("rn", rn)
    lab = F.when(F.col("rn") <= 9, F.col("entity_type")).otherwise(F.lit("Other"))
    return r.groupBy(lab.alias("label")).agg(F.sum("n").cast("long").alias("n"))


@register("samples3", O.ledger_sql(
    f"""SELECT file_path, category, CAST(rn AS INT) AS rn, masked_text FROM (
          SELECT file_path, {O.sql_display('entity_type', P.STRICT_DISPLAY_NAMES)} AS category,
            {O.sql_mask_strict('text', 'entity_type')} AS masked_text,
            row_number() OVER (PARTITION BY file_id, {O.sql_display('entity_type', P.STRICT_DISPLAY_NAMES)}
                               ORDER BY start_index, end_index, entity_type, text, score) AS rn
          FROM fe) x WHERE rn <= 3"""))
def samples3(spark, sf):
    """First three samples per (file, category) in text order, masked."""
    fe = _fe(spark, sf).withColumn("category", P.display_name(F.col("entity_type"), P.STRICT_DISPLAY_NAMES))
    w = Window.partitionBy("file_id", "category").orderBy("start_index", "end_index", "entity_type", "text", "score")
    r = fe.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 3)
    return r.select("file_path", "category", "rn",
                    M.mask_strict(F.col("text"), F.col("entity_type")).alias("masked_text"))


@register("samples5_more", O.ledger_sql(
    f"""SELECT file_path, entity_type, CAST(rn AS INT) AS rn, masked_text, confidence, n_more FROM (
          SELECT file_path, entity_type, {O.sql_mask_tiered('text', 'entity_type')} AS masked_text, score AS confidence,
            row_number() OVER (PARTITION BY file_id, entity_type ORDER BY score DESC, start_index, text) AS rn,
            greatest(count(*) OVER (PARTITION BY file_id, entity_type) - 5, 0) AS n_more
          FROM fe) x WHERE rn <= 5"""))
def samples5_more(spark, sf):
    """Top five by confidence per (file, type) and how many more."""
    fe = _fe(spark, sf)
    # the group size comes from a partial aggregate; the top five use a
    # window group limit, so a hot (file, type) never sits in one task whole
    n = fe.groupBy("file_id", "entity_type").agg(F.greatest(F.count(F.lit(1)) - 5, F.lit(0)).alias("n_more"))
    w = Window.partitionBy("file_id", "entity_type").orderBy(F.desc("score"), "start_index", "text")
    r = fe.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 5).join(n, ["file_id", "entity_type"])
    return r.select("file_path", "entity_type", "rn",
                                           M.mask_tiered(F.col("text"), F.col("entity_type")).alias("masked_text"),
                                           F.col("score").alias("confidence"), "n_more")


@register("rank_files", O.ledger_sql(
    f"""SELECT file_path, entity_count, {O.sql_set_tier('types')} AS tier,
          row_number() OVER (ORDER BY entity_count DESC, file_path) AS rank_by_count,
          row_number() OVER (ORDER BY {O.sql_set_tier('types')} DESC, file_path) AS rank_by_tier FROM fs"""))
def rank_files(spark, sf):
    """Files by entity count (desc) and by tier (desc) then path.
    A global order is a range-partitioned sort; ranks use one window each."""
    from ..operators.parallel import ranked
    c = C.with_tier(C.entity_sets(_fe(spark, sf))).select("file_path", "entity_count", "tier")
    c = c.withColumn("_nc", -F.col("entity_count")).withColumn("_nt", -F.col("tier"))
    c = ranked(c, ["_nc", "file_path"], out="rank_by_count")
    c = ranked(c, ["_nt", "file_path"], out="rank_by_tier")
    return c.select("file_path", "entity_count", "tier", "rank_by_count", "rank_by_tier")


@register("type_order", O.ledger_sql(
    f"""SELECT DISTINCT file_id, entity_type, {O.sql_type_tier('entity_type')} AS tier,
          CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY {O.sql_type_tier('entity_type')} DESC, entity_type) AS INT) AS pos
        FROM fe"""))
def type_order(spark, sf):
    """Type order inside a file: most sensitive first, then name."""
    d = _fe(spark, sf).select("file_id", "entity_type").distinct().withColumn("tier", P.type_tier(F.col("entity_type")))
    w = Window.partitionBy("file_id").orderBy(F.desc("tier"), "entity_type")
    return d.withColumn("pos", F.dense_rank().over(w))


# ------------------------------------------------------------------ progress
@register("progress", O.with_views(
    """SELECT job_id,
         round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE status IN ('completed', 'error')) * 100.0 / count(*)
               ELSE 0.0 END, 6) AS progress_pct,
         round(count(*) FILTER (WHERE status = 'error') * 100.0 / count(*), 6) AS error_rate
       FROM t_files GROUP BY job_id""", "t_files"))
def progress(spark, sf):
    """Progress percent and error rate per job (zero-safe)."""
    f = _tb(spark, sf).files
    g = f.groupBy("job_id").agg(F.count(F.lit(1)).alias("t"),
                                F.count_if(F.col("status").isin("completed", "error")).alias("d"),
                                F.count_if(F.col("status") == "error").alias("e"))
    return g.select("job_id",
                    F.round(F.when(F.col("t") > 0, F.col("d") * 100.0 / F.col("t")).otherwise(F.lit(0.0)), 6)
                    .alias("progress_pct"),
                    F.round(F.when(F.col("t") > 0, F.col("e") * 100.0 / F.col("t")).otherwise(F.lit(0.0)), 6)
                    .alias("error_rate"))


@register("job_counts", O.with_views(
    "SELECT job_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed "
    "FROM t_files GROUP BY job_id", "t_files"))
def job_counts(spark, sf):
    """Total and completed counts per job."""
    f = _tb(spark, sf).files
    return f.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"),
                                   F.count_if(F.col("status") == "completed").alias("completed"))


@register("speed_stats", O.with_views(
    """SELECT min(processing_time) AS min_time, max(processing_time) AS max_time,
         round(avg(processing_time), 6) AS avg_time, round(avg(file_size), 6) AS avg_size,
         round(avg(n), 6) AS avg_entities, max(n) AS max_entities,
         count(*) FILTER (WHERE file_id % 5 <> 4) AS valid_timestamps, count(*) FILTER (WHERE file_id % 5 = 4) AS format_issues
       FROM t_files f LEFT JOIN (SELECT r.file_id AS fid, count(*) AS n FROM t_entities e
         JOIN t_results r ON e.result_id = r.result_id GROUP BY r.file_id) c ON c.fid = f.file_id
       WHERE status = 'completed'""", "t_files", "t_results", "t_entities"))
def speed_stats(spark, sf):
    """Time, size and entity statistics of completed files, and how many
    end times can be read; these are written in three known forms and one
    unknown."""
    tb = _tb(spark, sf)
    n = tb.entities.select("result_id").join(tb.results.select("result_id", "file_id"), "result_id").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"))
    f = tb.files.where(F.col("status") == "completed").join(n, "file_id", "left")
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss",
             "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yy HH'h'mm")
    text = F.element_at(F.array(*(F.date_format("process_end", p) for p in forms)), (F.col("file_id") % 5 + 1).cast("int"))
    f = f.withColumn("process_end", TS.parse_time(text))
    return f.agg(F.min("processing_time").alias("min_time"), F.max("processing_time").alias("max_time"),
                 F.round(F.avg("processing_time"), 6).alias("avg_time"), F.round(F.avg("file_size"), 6).alias("avg_size"),
                 F.round(F.avg("n"), 6).alias("avg_entities"), F.max("n").alias("max_entities"),
                 F.count("process_end").alias("valid_timestamps"),
                 (F.count(F.lit(1)) - F.count("process_end")).alias("format_issues"))


@register("union_runs", O.with_views(
    "SELECT job_id, file_type, count(*) AS files FROM t_files GROUP BY job_id, file_type", "t_files"))
def union_runs(spark, sf):
    """Results of all runs in one table, summarised by run and type."""
    f = _tb(spark, sf).files
    open_, closed = f.where("status IN ('pending', 'processing')"), f.where("status NOT IN ('pending', 'processing')")
    return open_.unionByName(closed).groupBy("job_id", "file_type").agg(F.count(F.lit(1)).alias("files"))
