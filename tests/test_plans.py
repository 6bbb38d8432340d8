"""Plan shape guards: the detector is evaluated once per row, scans are
pruned, and detection adds no shuffle beyond the source spread."""

from conftest import SF_SMALL
from tessera.functions import recognizers as R
from tessera.operators import detect as D
from tessera.plans.q_policy import doc_tier
from tessera.sources.tables import read_table


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detector_evaluated_once(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    lanes = len(R.lanes(list(R.RECOGNIZERS)))
    for df in (D.detect_entities(docs), D.detect_arrays(docs), doc_tier(spark, SF_SMALL)):
        assert _optimized(df).count("split(text") == lanes


def test_scan_reads_only_needed_columns(spark):
    plan = _executed(doc_tier(spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_detection_has_no_shuffle_but_the_spread(spark):
    plan = _executed(D.detect_entities(read_table(spark, SF_SMALL, "documents")))
    assert plan.count("Exchange") <= 1
