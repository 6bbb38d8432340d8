"""Nested JSON reports: export (S8, S9) and read back (S3).

Export writes one JSON line per file record (``{job header fields..., file
fields..., entities: [...]}``), so the output is split into as many files as
there are tasks.  The reference's single-document form (one object per job
holding every file) is accepted by the reader (``multi_line=True``), but never
produced: one record per job would put a whole job into one row.

A file's entity list is built per (file, part): a file with n entities is
salted by hash over ceil(n / 50,000) parts (the counts come from a
partially aggregated count), so every list is bounded whatever the file
size, a file with a third of all entities is spread over many tasks, small
files stay one record, and readers simply explode every part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import masks as M

SPAN_STRUCT = T.StructType([
    T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType()),
])

FILE_RECORD = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("entities", T.ArrayType(SPAN_STRUCT)),
])

REPORT = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("command_line", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_files", T.LongType()),
    T.StructField("processed_files", T.LongType()),
    T.StructField("error_files", T.LongType()),
    T.StructField("results", T.ArrayType(FILE_RECORD)),
])

# one line per file record (our export form)
FILE_LINE = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("part", T.IntegerType())]
                         + FILE_RECORD.fields)

PART_CHARS = 65_536


def nested_records(jobs: DataFrame, files: DataFrame, results: DataFrame, entities: DataFrame,
                   threshold: float | None = None, include_entities: bool = True, mask: bool = True) -> DataFrame:
    """Per-file records with job header, file fields, metadata map
    (bad JSON -> NULL map, Q9) and the entity list (masked by default).  A
    record covers ``part``, a window of PART_CHARS characters of the file, so
    no list grows with the file; parts without entities have no record."""
    # only the results and entities of the exported files are aggregated
    results = results.join(files.select("file_id"), "file_id", "left_semi")
    r = results.groupBy("file_id").agg(F.min_by(F.struct("result_id", "processing_time", "metadata"),
                                                F.col("result_id")).alias("r"))
    r = r.select("file_id", F.col("r.result_id").alias("result_id"), F.col("r.processing_time").alias("rt"),
                 F.from_json(F.col("r.metadata"), T.MapType(T.StringType(), T.StringType())).alias("metadata"))
    f = files.join(r, "file_id", "left")
    header = jobs.select("job_id", "command_line", F.col("start_time").cast("string").alias("start_time"),
                         F.col("last_updated").cast("string").alias("end_time"),
                         F.col("status").alias("job_status"), "total_files", "processed_files", "error_files")
    rec = f.select("job_id", "file_id", "result_id", "file_path", "file_type", "file_size", "status",
                   F.coalesce(F.col("rt"), F.col("processing_time")).alias("processing_time"), "metadata")
    if include_entities:
        e = entities.join(r.select("result_id"), "result_id", "left_semi")
        if threshold is not None:
            e = e.where(F.col("score") >= F.lit(float(threshold)))
        txt = M.mask_tiered(F.col("text"), F.col("entity_type")) if mask else F.col("text")
        part = F.floor(F.coalesce("start_index", F.lit(0)) / PART_CHARS).cast("int")
        lists = e.select("result_id", part.alias("part"), F.struct(
            "entity_type", F.col("start_index").alias("start"), F.col("end_index").alias("end"), "score",
            txt.alias("text")).alias("s")).groupBy("result_id", "part").agg(
            F.array_sort(F.collect_list("s")).alias("entities"))
        rec = rec.join(lists, "result_id", "left")
        rec = rec.withColumn("part", F.coalesce(F.col("part"), F.lit(0)))
        rec = rec.withColumn("entities", F.coalesce(F.col("entities"), F.array().cast(T.ArrayType(SPAN_STRUCT))))
    else:
        rec = rec.withColumn("part", F.lit(0)).withColumn("entities", F.array().cast(T.ArrayType(SPAN_STRUCT)))
    return rec.join(header, "job_id")


def write_report(records: DataFrame, path: str) -> None:
    """S8 sink: JSON lines, one per file record part, partitioned by job."""
    records.drop("file_id", "result_id").write.mode("overwrite").partitionBy("job_id").json(path)


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3 over our export: file records with typed fields."""
    schema = T.StructType([f for f in FILE_LINE.fields if f.name != "job_id"] + [
        T.StructField("command_line", T.StringType()), T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()), T.StructField("job_status", T.StringType())])
    return spark.read.schema(schema).json(path)


def read_nested_report(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S3 over the reference's form: one JSON object per job with a
    ``results`` array.  (A multi-line JSON document is read whole by one
    task; that is inherent to the format.)"""
    return spark.read.schema(REPORT).option("multiLine", multi_line).json(path)


def report_entities(files: DataFrame) -> DataFrame:
    """S3: explode file records to entity rows with the reference defaults
    ('' for a missing type/text, 0.0 for a missing score)."""
    e = files.select("file_path", F.explode_outer("entities").alias("e"))
    return e.where(F.col("e").isNotNull()).select(
        "file_path", F.coalesce(F.col("e.entity_type"), F.lit("")).alias("entity_type"),
        F.coalesce(F.col("e.score"), F.lit(0.0)).alias("score"), F.coalesce(F.col("e.text"), F.lit("")).alias("text"),
        F.col("e.start").alias("start"), F.col("e.end").alias("end"))


def flatten_nested(report: DataFrame) -> DataFrame:
    """S3: the reference form to file records (one row per file)."""
    return report.select("job_id", F.explode("results").alias("r")).select("job_id", "r.*")
