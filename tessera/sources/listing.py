"""File listing sources.

The listing is Spark's ``binaryFile`` source with the content column pruned:
only path, length and modification time are read from the file system
metadata, in parallel over the directory tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import DEFAULT_SUPPORTED_EXTENSIONS, file_type, is_supported


def list_files(spark: SparkSession, directory: str, extensions=DEFAULT_SUPPORTED_EXTENSIONS,
               recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(file_path, file_size, modified_time, file_type) of supported files."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(directory).select(F.regexp_replace("path", "^file:", "").alias("file_path"),
                                  F.col("length").alias("file_size"),
                                  F.col("modificationTime").alias("modified_time"))
    df = df.withColumn("file_type", file_type(F.col("file_path")))
    if extensions is not None:
        df = df.where(is_supported(F.col("file_path"), extensions))
    return df


def file_list_source(listed: DataFrame, existing: DataFrame, ledger: DataFrame,
                     extensions=DEFAULT_SUPPORTED_EXTENSIONS) -> DataFrame:
    """An explicit list ``(job_id, file_path)`` -> keep paths that exist
    (semi join with a listing) and are supported; flag those not yet in the
    ledger as new."""
    ok = listed.join(existing.select("file_path").distinct(), "file_path", "left_semi")
    ok = ok.where(is_supported(F.col("file_path"), extensions))
    known = ledger.select("job_id", "file_path").withColumn("_known", F.lit(True))
    return ok.join(known, ["job_id", "file_path"], "left").select(
        "job_id", "file_path", F.col("_known").isNull().alias("is_new"))
