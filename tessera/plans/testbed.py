"""Ledger views derived from the driver tables.

The reference keeps its scan ledger in five tables (jobs, job_metadata,
files, results, entities).  The driver gives TPC-H-like tables instead, so
the ledger is *derived* from them with plain projections: ``orders`` becomes
the file ledger, ``lineitem`` the entity rows, ``events`` a processing log.
Every view is lazy; Catalyst prunes unused columns down to the parquet scan.
The same definitions exist as SQL text in ``plans/oracle.py`` for DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

# fixed values: extension cycle, the 42-type cycle of the entity view, and
# the error texts per order priority (FIXTURES §11)
EXTENSIONS = [".pdf", ".docx", ".txt", ".xlsx", ".csv", ".jpg", ".json", ""]
ENTITY_CYCLE = [
    "PERSON", "US_SSN", "CREDIT_CARD", "EMAIL_ADDRESS", "ACCESS_CODE", "PHONE_NUMBER", "IP_ADDRESS",
    "US_PASSPORT", "US_DRIVER_LICENSE", "MEDICAL_RECORD_NUMBER", "HEALTH_INSURANCE_POLICY_NUMBER",
    "IBAN_CODE", "US_BANK_NUMBER", "BANK_ACCOUNT", "US_BANK_ROUTING", "PIN_CODE", "PASSWORD", "USERNAME",
    "FIRST_NAME", "LAST_NAME", "STUDENT_ID", "EMPLOYEE_ID", "GOV_ID", "GRANT_ID", "DONOR_NAME",
    "SWIFT_CODE", "ORG", "LOCATION", "NRP", "ADDRESS", "US_POSTAL_CODE", "AWS_SECRET_KEY", "US_ITIN",
    "UK_NHS", "AU_TFN", "AU_MEDICARE", "MEDICAL_LICENSE", "ITAR_CONTROLLED", "DIGITAL_SIGNATURE",
    "BIOMETRIC_IDENTIFIER", "SECURITY_ANSWER", "US_SOCIAL_SECURITY_NUMBER",
]
ERROR_BY_PRIORITY = [
    ("1-URGENT", "No such file"),
    ("2-HIGH", "Permission denied"),
    ("3-MEDIUM", "Tika timeout"),
    ("4-NOT SPECIFIED", "Processing timeout (exceeded 5 minutes)"),
]
OTHER_ERROR = "boom"


def _lits(values):
    return F.array(*[F.lit(v) for v in values])


def t_files(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    key = F.col("o_orderkey")
    job = (F.col("o_custkey") % 3 + 1)
    ext = F.element_at(_lits(EXTENSIONS), (key % 8 + 1).cast("int"))
    path = F.concat(F.lit("/corpus/job"), job.cast("string"), F.lit("/d"), (key % 7).cast("string"), F.lit("/"),
                    F.when(key % 50 == 0, F.lit("~$")).otherwise(F.lit("")), F.lit("f"), key.cast("string"), ext)
    size = (F.when(key % 20 == 4, F.lit(0).cast("long")).when(key % 20 == 2, F.lit(50).cast("long"))
            .otherwise(F.floor("o_totalprice").cast("long")))
    status = (F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending")
              .when(key % 2 == 0, "error").otherwise("processing"))
    msg = F.lit(None).cast("string")
    by_prio = F.lit(OTHER_ERROR)
    for prio, text in reversed(ERROR_BY_PRIORITY):
        by_prio = F.when(F.col("o_orderpriority") == prio, F.lit(text)).otherwise(by_prio)
    msg = F.when((F.col("o_orderstatus") == "P") & (key % 2 == 0), by_prio)
    end = F.timestamp_add("SECOND", key % 3600, F.col("o_orderdate"))
    return o.select(
        key.alias("file_id"), job.alias("job_id"), path.alias("file_path"), ext.alias("file_type"),
        size.alias("file_size"), status.alias("status"), msg.alias("error_message"),
        F.col("o_orderdate").alias("process_start"), end.alias("process_end"),
        ((key % 3600) / F.lit(10.0)).alias("processing_time"))


def t_results(spark: SparkSession, sf: str) -> DataFrame:
    """One result per completed file; metadata JSON names the extractor."""
    f = t_files(spark, sf).where(F.col("status") == "completed")
    meta = F.when(F.col("file_id") % 4 == 0, F.lit('{"extraction_method": "ocr"}')) \
        .otherwise(F.lit('{"extraction_method": "tika"}'))
    return f.select(F.col("file_id").alias("result_id"), "file_id", "processing_time", meta.alias("metadata"))


def t_entities(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    k = (F.col("l_partkey") + F.col("l_suppkey")) % 42
    etype = F.element_at(_lits(ENTITY_CYCLE), (k + 1).cast("int"))
    text = (F.when(k == 3, F.concat(F.lit("user"), F.col("l_partkey").cast("string"), F.lit("@mail"),
                                   F.col("l_suppkey").cast("string"), F.lit(".example.com")))
            .when(k.isin(0, 18, 19), F.concat(F.lit("John Q"), (F.col("l_partkey") % 10).cast("string"),
                                               F.lit(" Smith")))
            .otherwise(F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))))
    score = (F.lit(50) + F.round(F.col("l_discount") * 500)).cast("int") / F.lit(100.0)
    return li.select(
        F.col("l_orderkey").alias("result_id"), F.col("l_orderkey").alias("file_id"), etype.alias("entity_type"),
        (F.col("l_linenumber") * 10).cast("int").alias("start_index"),
        (F.col("l_linenumber") * 10 + 8).cast("int").alias("end_index"),
        score.alias("score"), text.alias("text"))


def t_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs with counters *derived* from the file ledger (never stored)."""
    f = t_files(spark, sf)
    agg = f.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "completed").alias("processed_files"),
        F.count_if(F.col("status") == "error").alias("error_files"),
        F.count_if(F.col("status").isin("pending", "processing")).alias("open_files"),
        F.min("process_start").alias("start_time"), F.max("process_end").alias("last_updated"))
    return agg.select(
        "job_id", F.concat(F.lit("job"), F.col("job_id").cast("string")).alias("name"), "start_time",
        "last_updated",
        F.when(F.col("open_files") == 0, F.lit("completed")).otherwise(F.lit("running")).alias("status"),
        F.concat(F.lit("scan /corpus/job"), F.col("job_id").cast("string")).alias("command_line"),
        "total_files", "processed_files", "error_files",
        F.lit('{"threshold": 0.7}').alias("settings"))


def t_job_metadata(spark: SparkSession, sf: str) -> DataFrame:
    j = t_jobs(spark, sf).select("job_id")
    d = j.select((F.col("job_id") * 10 + 1).alias("metadata_id"), "job_id", F.lit("directory").alias("key"),
                 F.concat(F.lit("/corpus/job"), F.col("job_id").cast("string")).alias("value"))
    t = j.select((F.col("job_id") * 10 + 2).alias("metadata_id"), "job_id", F.lit("threshold").alias("key"),
                 F.lit("0.7").alias("value"))
    return d.unionByName(t)


def t_log(spark: SparkSession, sf: str) -> DataFrame:
    """Processing log from ``events``; ts made a real TIMESTAMP (UTC)."""
    e = read_table(spark, sf, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"),
                    "event_type", "value", "props")


def t_docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


@dataclass
class Testbed:
    spark: SparkSession
    sf: str

    @property
    def files(self):
        return t_files(self.spark, self.sf)

    @property
    def results(self):
        return t_results(self.spark, self.sf)

    @property
    def entities(self):
        return t_entities(self.spark, self.sf)

    @property
    def jobs(self):
        return t_jobs(self.spark, self.sf)

    @property
    def job_metadata(self):
        return t_job_metadata(self.spark, self.sf)

    @property
    def log(self):
        return t_log(self.spark, self.sf)

    @property
    def docs(self):
        return t_docs(self.spark, self.sf)

    def table(self, name):
        return read_table(self.spark, self.sf, name)
