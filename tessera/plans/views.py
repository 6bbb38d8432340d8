"""SQL surface: register the ledger views and detection output as temp
views, so a SQL user can write ``spark.sql("SELECT ... FROM doc_spans")``.

Every view is a lazy DataFrame (nothing is computed at registration)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.detector_sql import spans_sql
from ..operators import detect as D
from ..sources.tables import TABLES, read_table
from .testbed import Testbed


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    tb = Testbed(spark, sf_dir)
    views = {
        "t_files": tb.files, "t_results": tb.results, "t_entities": tb.entities, "t_jobs": tb.jobs,
        "t_job_metadata": tb.job_metadata, "t_log": tb.log,
        "doc_spans": D.detect_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text")),
        "doc_span_arrays": D.detect_arrays(read_table(spark, sf_dir, "documents").select("doc_id", "text")),
    }
    for t in TABLES:
        views.setdefault(t, read_table(spark, sf_dir, t))
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in views]


def register_functions(spark: SparkSession, threshold: float | None = D.DEFAULT_THRESHOLD) -> None:
    """The table function ``detect_spans(text)`` for lateral joins:
    ``SELECT d.doc_id, s.* FROM documents d, LATERAL detect_spans(d.text) s``.

    It is a SQL function, so the optimizer puts the detector's own expression
    into the query: no join, no Python worker."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION detect_spans(document STRING)
      RETURNS TABLE(entity_type STRING, start INT, end INT, score DOUBLE, text STRING)
      RETURN SELECT s.entity_type, s.start, s.end, s.score, s.text FROM (SELECT explode({spans_sql('document', None, threshold)}) AS s) x""")
