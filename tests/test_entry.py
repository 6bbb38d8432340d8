"""Driver contract: entry() runs, every oracle key has a query, the
queries of each family run on the smallest data set."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["doc_id", "tier", "tier_name", "entity_count", "entity_types", "breach_label"]
    assert len(rows) >= 1


def test_oracle_keys_are_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 150


SMOKE = ["detect_all", "doc_tier", "breach_files", "classified_files", "redact_replace", "retry_errors",
         "error_categories", "eta_pending", "inspect_counts", "span_overlaps", "export_nested", "stream_per_hour",
         "stream_stalled", "exec_summary_tier", "report_lines", "copy_manifest"]


@pytest.mark.parametrize("key", SMOKE)
def test_query_runs_small(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    df.collect()
    assert len(df.columns) > 0


def test_sql_views(spark):
    from tessera.plans.views import register_views
    names = register_views(spark, SF_SMALL, prefix="v_")
    assert "v_doc_spans" in names
    n = spark.sql("SELECT count(*) AS n FROM v_t_files WHERE status = 'completed'").first().n
    assert n > 0
    spans = spark.sql("SELECT entity_type, count(*) AS n FROM v_doc_spans GROUP BY entity_type").collect()
    assert {r.entity_type for r in spans} >= {"EMAIL_ADDRESS"}
