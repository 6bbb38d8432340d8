"""Properties from SURVEY §5.3 on the small driver tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.operators import anonymize as A
from tessera.operators import detect as D
from tessera.operators import ledger as L
from tessera.plans.testbed import Testbed
from tessera.sources.tables import read_table
from tessera.streaming import streams as S


def _docs(spark):
    return read_table(spark, SF_SMALL, "documents").select("doc_id", "text")


def test_redact_then_detect_finds_nothing(spark):
    docs = _docs(spark)
    spans = D.detect_arrays(docs)
    red = A.redact(docs.join(spans, "doc_id")).select("doc_id", F.col("redacted").alias("text"))
    assert spans.where(F.size("entities") > 0).count() > 0
    assert D.detect_entities(red).count() == 0


def test_islands_never_overlap_on_documents(spark):
    spans = D.detect_entities(_docs(spark), threshold=None)
    isl = D.span_islands(spans).select("doc_id", "start", "end").collect()
    by_doc = {}
    for r in isl:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.end))
    for lst in by_doc.values():
        lst.sort()
        assert all(a[1] <= b[0] for a, b in zip(lst, lst[1:]))


def test_transitions_keep_row_counts(spark):
    f = Testbed(spark, SF_SMALL).files
    n = f.count()
    for op in (L.reset_stalled, L.reset_all, L.retry_errors):
        assert op(f).count() == n
    assert L.claim_batch(f, L.pending_batch(f, 10), F.current_timestamp().cast("timestamp_ntz")).count() == n


def test_batch_equals_drained_stream(spark):
    batch = sorted(tuple(r) for r in D.detect_entities(_docs(spark)).collect())
    stream = sorted(tuple(r) for r in S.stream_detect(spark, SF_SMALL, name="prop_stream").collect())
    assert batch == stream
