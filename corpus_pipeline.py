"""Cleans and packs the table ``documents``, stage by stage.

Toxic documents go, repeated lines go, one document of each group of
near-duplicates stays, passages that an earlier document holds are cut, and
what is left is packed into token sequences.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, linededup, packing, substring, toxicity
from tessera.llm.scratch import stored, unused


def _recounted(docs: DataFrame, before: DataFrame, removed: str) -> DataFrame:
    """Columns of ``before`` with n_chars of the new text, where ``removed``
    counts what went; a document of which nothing is left goes, one that was
    empty from the start stays."""
    left = docs.where(F.expr(f"text IS NULL OR `{removed}` = 0 OR btrim(text, ' \\t\\n\\x0B\\f\\r') != ''"))
    if "n_chars" in before.columns:
        n = F.when(F.col(removed) > 0, F.length("text").cast(before.schema["n_chars"].dataType))
        left = left.withColumn("n_chars", n.otherwise(F.col("n_chars")))
    return left.select(*before.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores below its threshold."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.train(docs, labels, learn=~toxicity.held_out())
    return toxicity.clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats."""
    removed, = unused(docs.columns, "n_removed")
    return _recounted(linededup.dedup_lines(docs, removed_col=removed), docs, removed)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of word-shingle neighbours."""
    return jaccard.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds."""
    removed, = unused(docs.columns, "n_removed")
    cut = substring.cut_passages(docs, substring.repeated_passages(docs), removed_col=removed)
    return _recounted(cut, docs, removed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_near_duplicates),
          ("substring_dedup", cut_repeated_passages), ("packing", pack)]

#: no SQL expresses the conditional random field or the chaining
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
