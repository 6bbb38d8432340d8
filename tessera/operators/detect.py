"""Detection: text rows -> span rows.

The whole detector is one projection per document row: every lane adds an
``array<span>`` expression, the arrays are concatenated, thresholded and (for
the long form) exploded.  No shuffle, no Python worker, and the text column
is dropped before the explode so span rows do not carry it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recognizers as R
from .parallel import spread
from .terms import detect_terms  # noqa: F401  (D7)

DEFAULT_THRESHOLD = 0.7


_SPANS_CACHE: dict = {}


def spans_column(text: str, entities=None, threshold: float | None = DEFAULT_THRESHOLD) -> Column:
    """array<struct<entity_type,start,end,score,text>> for one text column,
    parsed once and cached per session.

    ``entities`` prunes recognizers (and so regex passes) from the plan;
    ``threshold`` keeps spans with ``score >= threshold`` (None keeps all,
    0.0 is honoured as a real threshold).  Spans are ordered by start, end
    and type.
    """
    from pyspark import SparkContext

    from ..functions.detector_sql import spans_sql
    sc = SparkContext._active_spark_context
    key = (sc.applicationId if sc is not None else None, text,
           None if entities is None else tuple(sorted(entities)), threshold)
    if key not in _SPANS_CACHE:
        _SPANS_CACHE[key] = F.expr(spans_sql(text, entities, threshold))
    return _SPANS_CACHE[key]


def detect_arrays(df: DataFrame, text_col: str = "text", id_cols=("doc_id",), entities=None,
                  threshold: float | None = DEFAULT_THRESHOLD, out_col: str = "entities") -> DataFrame:
    """One sorted span array per input row ([] for blank text)."""
    return spread(df, id_cols).select(*id_cols, spans_column(text_col, entities, threshold).alias(out_col))


def detect_entities(df: DataFrame, text_col: str = "text", id_cols=("doc_id",), entities=None,
                    threshold: float | None = DEFAULT_THRESHOLD) -> DataFrame:
    """Long form ``(id..., entity_type, start, end, score, text)``, the
    exploded rows of :func:`detect_arrays`.

    ``explode_outer`` + a null filter instead of ``explode``: for a plain
    explode Catalyst infers ``size(array) > 0`` and pushes it below the
    projection, which would evaluate the whole detector two more times."""
    arr = detect_arrays(df, text_col, id_cols, entities, threshold, "_spans")
    return (arr.select(*id_cols, F.explode_outer("_spans").alias("s")).where(F.col("s").isNotNull())
            .select(*id_cols, "s.*"))


def doc_entity_counts(df: DataFrame, text_col: str = "text", id_cols=("doc_id",), entities=None,
                      threshold: float | None = DEFAULT_THRESHOLD) -> DataFrame:
    """Per-document entity count and text length (code points)."""
    spans = spans_column(text_col, entities, threshold)
    return spread(df, id_cols).select(*id_cols, F.size(spans).alias("entity_count"),
                     F.length(text_col).cast("long").alias("text_length"))


def supported_entities(spark) -> DataFrame:
    """D3: recognizer catalogue as a DataFrame."""
    rows = [(r.entity_type, r.lane, float(r.score), r.check_name, r.context) for r in R.RECOGNIZERS]
    return spark.createDataFrame(rows, "entity_type string, lane string, base_score double, "
                                       "checksum string, context string")


def span_islands(spans: DataFrame, id_cols=("doc_id",), plain: bool | None = None) -> DataFrame:
    """Merge overlapping spans of a document into islands.

    An island's label is the highest score, then the longest span, then the
    earliest start, then the type name.  Order-independent, so SQL can check
    it.  A span opens a new island when its start is >= the largest end seen
    before it; both running values (max end, island count) are two-level
    prefix scans, so a document holding a third of all spans is still spread
    over every task.  (One document id column is expected.)
    """
    from .parallel import _window_scan, fits_one_task, scan_split, split_for_scan
    key = list(id_cols)
    order = ["start", "end", "entity_type", "_tie"]
    s = spans.withColumn("_tie", F.xxhash64(*spans.columns))
    new = F.when(F.col("_prev_end").isNull() | (F.col("start") >= F.col("_prev_end")), 1).otherwise(0)
    if fits_one_task(spans) if plain is None else plain:
        s = _window_scan(s, order, key, {}, {"end": "_prev_end"}, False).withColumn("_new", new)
        s = _window_scan(s, order, key, {"_new": "island"}, {}, True)
    else:
        s = split_for_scan(s, order, key)             # one checkpointed split, two passes
        s = scan_split(s, order, key, maxes={"end": "_prev_end"}, inclusive=False).withColumn("_new", new)
        s = scan_split(s, order, key, sums={"_new": "island"}).drop("_pid")
    best = F.max(F.struct(F.col("score"), (F.col("end") - F.col("start")).alias("len"),
                          (-F.col("start")).alias("neg_start"), F.col("entity_type")))
    return (s.groupBy(*id_cols, "island")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("b"),
                 F.count(F.lit(1)).alias("n_spans"))
            .select(*id_cols, "island", F.col("b.entity_type").alias("entity_type"), "start", "end",
                    F.col("b.score").alias("score"), "n_spans"))


def span_overlaps(spans: DataFrame, id_cols=("doc_id",), bucket: int = 32) -> DataFrame:
    """Pairs of spans of different type that share characters.

    A bucketed range join: each span is listed under the fixed-width
    position buckets it covers, the equi-join key is (doc, bucket), and a
    pair is kept only in the bucket where its overlap begins, so it appears
    once.  Work per key is bounded by the spans of one bucket, not by the
    spans of a whole document, and no pair is formed across buckets.
    """
    first = F.floor(F.col("start") / bucket)
    last = F.floor(F.greatest(F.col("end") - 1, F.col("start")) / bucket)

    def side(p):
        return spans.select(*id_cols, F.col("entity_type").alias(p + "entity_type"),
                            F.col("start").alias(p + "start"), F.col("end").alias(p + "end"),
                            F.explode(F.sequence(first, last)).alias("_bk"))

    a, b = side("a_"), side("b_")
    j = a.join(b, [*id_cols, "_bk"])
    keep = ((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
            & (F.col("a_entity_type") < F.col("b_entity_type"))
            & (F.col("_bk") == F.floor(F.greatest(F.col("a_start"), F.col("b_start")) / bucket)))
    return j.where(keep).select(*id_cols, "a_entity_type", "a_start", "a_end", "b_entity_type", "b_start", "b_end")
