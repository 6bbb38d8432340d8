"""Error triage.

The category cascade is one CASE expression evaluated per error row; all
reports are single aggregates or per-category windows over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import strip

from .ledger import file_type

# ---------------------------------------------------------------------------
# fixed values: categories in cascade order with their message substrings
# ---------------------------------------------------------------------------
TEMP_PREFIX = "~$"
CASCADE = [
    ("empty_files", ["empty", "no output file", "zero", "0 bytes"]),
    ("missing_files", ["not found", "no such file", "does not exist"]),
    ("permission_errors", ["permission denied", "access denied"]),
    ("format_errors", ["unsupported", "invalid format", "format error", "corrupt"]),
    ("tika_errors", ["tika", "connection refused", "service unavailable"]),
    ("ocr_errors", ["ocr", "tesseract", "recognition failed"]),
    ("timeout_errors", ["timeout", "timed out", "time limit"]),
    ("extraction_errors", ["extraction failed", "could not extract", "no text"]),
]
CATEGORIES = ["temp_files"] + [c for c, _ in CASCADE] + ["other"]
MAX_SAMPLES = 5
TOP_EXTENSIONS = 20
PATH_WIDTH = 60
MESSAGE_WIDTH = 100


def category(path: Column, size: Column, message: Column) -> Column:
    """First matching category, in cascade order (Q13)."""
    msg = F.lower(F.coalesce(message, F.lit("")))
    base = F.regexp_extract(path, "[^/]*$", 0)
    out = F.when(base.startswith(TEMP_PREFIX), F.lit("temp_files"))
    for name, pats in CASCADE:
        hit = F.lit(False)
        for p in pats:
            hit = hit | msg.contains(p)
        if name == "empty_files":
            hit = (F.coalesce(size, F.lit(0)) == 0) | hit
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("other"))


def display_category(c: Column) -> Column:
    """E3: 'permission_errors' -> 'Permission Errors'."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def truncate(c: Column, width: int) -> Column:
    """Cut to ``width`` characters and mark with '...'."""
    return F.when(F.length(c) > width, F.concat(F.substr(c, F.lit(1), F.lit(width)), F.lit("..."))).otherwise(c)


def categorised(files: DataFrame) -> DataFrame:
    err = files.where(F.col("status") == "error")
    return err.withColumn("category", category(F.col("file_path"), F.col("file_size"), F.col("error_message")))


def category_counts(files: DataFrame) -> DataFrame:
    """Count and share per category (share unrounded, Q15)."""
    c = categorised(files).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return c.select(display_category(F.col("category")).alias("name"), "count",
                    (F.col("count") * 100.0 / total).alias("percentage"))


def extension_counts(files: DataFrame, top: int = TOP_EXTENSIONS) -> DataFrame:
    """Error counts per extension, top 20, '(no extension)' for ''."""
    e = categorised(files).withColumn("ext", file_type(F.col("file_path")))
    c = e.groupBy("ext").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    ranked = c.select("ext", "count", (F.col("count") * 100.0 / total).alias("percentage"))
    top_rows = ranked.orderBy(F.desc("count"), F.asc("ext")).limit(top)
    return top_rows.select(F.when(F.col("ext") == "", F.lit("(no extension)")).otherwise(F.col("ext"))
                           .alias("extension"), "count", "percentage")


def samples(files: DataFrame, n: int = MAX_SAMPLES) -> DataFrame:
    """The first n error files per category, by path."""
    w = Window.partitionBy("category").orderBy("file_path", "file_id")
    c = categorised(files).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return c.select(display_category(F.col("category")).alias("category"), "rn", "file_path",
                    F.coalesce(F.col("error_message"), F.lit("")).alias("error"))


def error_patterns(files: DataFrame) -> DataFrame:
    """First line of each message, blank -> 'Unknown error'."""
    first = F.substring_index(F.coalesce(F.col("error_message"), F.lit("")), "\n", 1)
    pat = F.when(F.length(strip(first)) == 0, F.lit("Unknown error")).otherwise(first)
    return files.where(F.col("status") == "error").groupBy(pat.alias("pattern")).agg(
        F.count(F.lit(1)).alias("count"))
