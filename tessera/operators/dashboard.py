"""The dashboard of one job (G23) and whole-run statistics (G7, G8) as rows.

Everything a page shows comes from the ledger's tables by partial aggregates;
the only lists are bounded by a vocabulary (types) or by the page (the first
files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from . import classify as C
from . import timeseries as TS

#: high-risk files that a page lists
LISTED = 50


def counts_json(counts: DataFrame, keys: list[str], name: str, n: str = "n", out: str = "counts") -> DataFrame:
    """One JSON object per group of ``keys``, name to count, by name.  The
    names are a vocabulary, so an object is small."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col(n).alias("v"))))
    return counts.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias(out))


def _numbered(df: DataFrame, section: str, order: list, name: Column, label: Column, value: Column) -> DataFrame:
    place = F.row_number().over(Window.orderBy(*order))
    return df.select(F.lit(section).alias("section"), place.alias("place"), name.cast("string").alias("name"),
                     label.cast("string").alias("label"), value.cast("string").alias("value"))


def job_page(jobs: DataFrame, files: DataFrame, results: DataFrame, entities: DataFrame, job_id=None,
             threshold: float = P.HIGH_CONFIDENCE_THRESHOLD, listed: int = LISTED) -> DataFrame:
    """``(section, place, name, label, value)`` of a job (by default the
    newest): its row, processing counts with progress and error rate, elapsed
    time and completion estimate, file types and entity types by count (with
    display names), how many high-risk files there are and the first
    ``listed`` of them by id."""
    newest = jobs.agg(F.max("job_id")).scalar() if job_id is None else F.lit(job_id)
    job, f = jobs.where(F.col("job_id") == newest), files.where(F.col("job_id") == newest)
    known = (F.count_if(F.col("status") == s).alias(s) for s in ("completed", "pending", "processing", "error"))
    c = f.agg(F.count(F.lit(1)).alias("total"), *known)

    def share(n):
        return F.when(F.col("total") > 0, F.round(n * 100.0 / F.col("total"), 1)).otherwise(F.lit(0.0))

    def listed_fields(df, section, fields):
        return df.select(F.posexplode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("string").alias("value"))
                                                for k, v in fields)))).select(
            F.lit(section).alias("section"), (F.col("pos") + 1).alias("place"), "col.name", F.lit(None).cast("string").alias("label"),
            "col.value")
    time = TS.eta_pending(job, f)
    rows = listed_fields(job, "job", [("id", F.col("job_id")), ("name", F.col("name")), ("status", F.col("status"))]).unionByName(
        listed_fields(c, "processing", [
            ("total_files", F.col("total")), *((s, F.col(s)) for s in ("completed", "pending", "processing", "error")),
            ("progress_percent", share(F.col("completed") + F.col("error"))), ("error_rate", share(F.col("error")))])).unionByName(
        listed_fields(time, "time", [
            ("elapsed", F.col("elapsed_time_formatted")), ("files_per_hour", F.format_string("%.2f", "files_per_hour")),
            ("estimated_completion", F.col("estimated_completion_time"))]))
    types = f.where(F.coalesce("file_type", F.lit("")) != "").groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))
    fe = C.ledger_entities(f, results, entities, threshold).groupBy("file_id", "file_path", "entity_type").agg(
        F.count(F.lit(1)).alias("n"))
    found = fe.groupBy("entity_type").agg(F.sum("n").alias("n"))
    risky = C.with_breach(fe.groupBy("file_id", "file_path").agg(F.collect_set("entity_type").alias("entity_types"))).where("breach_trigger")
    top = risky.orderBy("file_id").limit(listed)
    return rows.unionByName(
        _numbered(types, "file_type", [F.desc("n"), "file_type"], F.col("file_type"), F.lit(None), F.col("n"))).unionByName(
        _numbered(found, "entity_type", [F.desc("n"), "entity_type"], F.col("entity_type"),
                  P.display_name(F.col("entity_type"), P.STRICT_DISPLAY_NAMES), F.col("n"))).unionByName(
        listed_fields(risky.agg(F.count(F.lit(1)).alias("n")), "high_risk", [
            ("count", F.col("n")), ("has_more", F.col("n") > listed)])).unionByName(
        _numbered(top, "high_risk_file", ["file_id"], F.col("file_path"), F.lit(None), F.lit(None)))


def run_summary(files: DataFrame, results: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for a run: files analysed, processed and failed, entities
    and their counts by type, and the time split into extraction and
    analysis with their shares.  ``results`` hold ``extraction_time`` and
    ``analysis_time``; only the results of completed files count."""
    done = files.where(F.col("status") == "completed").select("file_id")
    r = results.join(done, "file_id", "left_semi")
    times = r.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("extraction_time", "analysis_time")))
    n = files.agg(F.count(F.lit(1)).alias("files_analyzed"), F.count_if(F.col("status") == "completed").alias("files_processed"),
                  F.count_if(F.col("status") == "error").alias("files_failed"))
    per = entities.join(r.select("result_id"), "result_id", "left_semi").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    total, by_type = per.agg(F.coalesce(F.sum("n"), F.lit(0))), counts_json(per, [], "entity_type")
    whole = F.col("extraction_time") + F.col("analysis_time")
    out = n.withColumns({"total_entities": total.scalar(), "entity_type_counts": by_type.scalar(),
                         **{c: times.select(c).scalar() for c in times.columns}})
    return out.withColumn("total_time", whole).withColumns({
        f"{c}_share": F.when(F.col("total_time") > 0, F.col(f"{c}_time") * 100.0 / F.col("total_time")).otherwise(F.lit(0.0))
        for c in ("extraction", "analysis")})


def job_statistics(jobs: DataFrame, files: DataFrame, results: DataFrame, entities: DataFrame) -> DataFrame:
    """Per job its file-type counts, entity-type counts (any status) and
    mean processing time of completed files, whole."""
    types = counts_json(files.groupBy("job_id", "file_type").agg(F.count(F.lit(1)).alias("n")), ["job_id"], "file_type", out="file_types")
    ents = C.ledger_entities(files, results, entities, None, completed_only=False).groupBy("job_id", "entity_type").agg(
        F.count(F.lit(1)).alias("n"))
    mean = results.join(files.where(F.col("status") == "completed").select("file_id", "job_id"), "file_id").groupBy("job_id").agg(
        F.avg("processing_time").alias("avg_time"))
    return jobs.join(types, "job_id", "left").join(counts_json(ents, ["job_id"], "entity_type", out="entity_types"), "job_id", "left").join(
        mean, "job_id", "left").select("job_id", "name", "status", "total_files", "file_types", "entity_types",
                                       F.coalesce("avg_time", F.lit(0.0)).alias("avg_time"))


def export_header(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """The processing header of each job's filtered export."""
    c = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_registered"), *(
        F.count_if(F.col("status") == s).alias(o) for s, o in (("completed", "total_completed"), ("pending", "pending_files"),
                                                               ("processing", "processing_files"), ("error", "error_files"))))
    t = TS.eta_pending(jobs, files).select("job_id", F.col("elapsed_time_formatted").alias("elapsed_time"), "files_per_hour",
                                           F.col("estimated_completion_time").alias("estimated_completion"))
    return jobs.select("job_id", F.col("name").alias("job_name"), "start_time", F.col("last_updated").alias("end_time"),
                       "processed_files").join(c, "job_id").join(t, "job_id")
