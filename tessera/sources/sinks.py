"""Sinks (S10, S12, S13, S14).

Writes are plain DataFrame writers (parquet / json / text), partitioned by a
low-cardinality key so a rerun overwrites only what it produced.  Nothing is
funnelled through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as P
from ..operators.ledger import basename, dirname, stem


def write_results(results: DataFrame, entities: DataFrame, base: str, mode: str = "append") -> None:
    """Append results and their entities (entities partitioned by
    type, the column the reports filter on)."""
    results.write.mode(mode).parquet(f"{base}/results")
    # a type's rows in a few files, however many tasks hold some
    entities = entities.repartition("entity_type", F.pmod(F.xxhash64("result_id"), F.lit(8)))
    entities.write.mode(mode).partitionBy("entity_type").parquet(f"{base}/entities")


def results_from_spans(spans: DataFrame, processing_time: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """Result rows (entity_count = number of spans, metadata JSON) from
    detected span arrays; defaults for missing keys as in the reference."""
    pt = processing_time if processing_time is not None else F.lit(0.0)
    return spans.select(F.col(id_col).alias("result_id"), F.col(id_col).alias("file_id"),
                        F.size("entities").cast("long").alias("entity_count"), pt.alias("processing_time"),
                        F.to_json(F.create_map(F.lit("extraction_method"), F.lit("table"))).alias("metadata"))


def entities_from_spans(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    e = spans.select(F.col(id_col).alias("result_id"), F.explode_outer("entities").alias("s")).where(
        F.col("s").isNotNull())
    return e.select("result_id", F.coalesce("s.entity_type", F.lit("")).alias("entity_type"),
                    F.coalesce("s.text", F.lit("")).alias("text"),
                    F.coalesce("s.start", F.lit(0)).alias("start_index"), F.coalesce("s.end", F.lit(0)).alias("end_index"),
                    F.coalesce("s.score", F.lit(0.0)).alias("score"))


def output_path(input_path: Column, output: str | None, extension: str | None = None,
                output_is_dir: bool = True) -> Column:
    """Output file for an input file.  A directory (or no output) gets
    ``<stem>.<ext>`` (default .txt) in it (or beside the input); a file path
    is used as given."""
    if output and not output_is_dir:
        return F.lit(output)
    ext = "." + extension if extension else ".txt"
    name = F.concat(stem(input_path), F.lit(ext))
    folder = dirname(input_path) if not output else F.lit(output.rstrip("/"))
    return F.concat(folder, F.lit("/"), name)


def relative_output(path: Column, directory: str, output: str) -> Column:
    """S12 (directory mode): ``output/relpath(path, directory)``; a path that
    is not below the directory keeps its whole name."""
    prefix = directory.rstrip("/") + "/"
    rel = F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    return F.concat(F.lit(output.rstrip("/") + "/"), rel)


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered report lines as text files; a distributed sort, whose
    part files follow each other in the order of their names."""
    keys = [c for c in lines.columns if c != "line"]
    lines.orderBy(*keys).select("line").write.mode("overwrite").text(path)


def copy_manifest(classified: DataFrame, clone_dir: str, min_tier: int | None = None) -> DataFrame:
    """Where each classified file would be copied: tier folder, and a
    ``_1, _2 ...`` suffix when several files of a tier share a basename
    (the first by path keeps the plain name).  A number is left out when a
    file of that very name stands in the tier, so no two files get one
    target."""
    from ..operators.parallel import ranked
    c = classified if min_tier is None else classified.where(F.col("tier") >= min_tier)
    b = basename(F.col("file_path"))
    c = c.withColumn("_base", b).withColumn("_stem", stem(F.col("file_path"))) \
        .withColumn("_ext", F.regexp_extract(b, "^\\.*[^.].*(\\.[^.]*)$", 1))
    # numbering inside a (tier, basename) group is a distributed rank, so a
    # basename shared by a third of all files is still spread over tasks
    c = ranked(c, ["file_path"], ["tier", "_base"], out="_n").withColumn("_n", F.col("_n") - 1)
    number = F.regexp_extract("_stem", "^.*_([1-9][0-9]{0,8})$", 1)
    taken = c.where((F.col("_n") == 0) & (number != "")).select(
        "tier", F.concat(F.regexp_extract("_stem", "^(.*)_[1-9][0-9]{0,8}$", 1), "_ext").alias("_base"),
        number.cast("long").alias("_taken")).groupBy("tier", "_base").agg(
        F.sort_array(F.collect_set("_taken")).alias("_taken"))
    c = c.join(taken, ["tier", "_base"], "left")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_n"),
                       lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    name = F.when(F.col("_n") == 0, F.col("_base")).otherwise(
        F.concat(F.col("_stem"), F.lit("_"), free.cast("string"), F.col("_ext")))
    folder = P.tier_name(F.col("tier"))
    return c.select("file_path", "tier", F.concat(F.lit(clone_dir.rstrip("/") + "/"), folder, F.lit("/"), name)
                    .alias("target_path"))
