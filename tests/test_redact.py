"""Redaction (A1-A8) on the reference's shape fixture."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import anonymize as A

TEXT = "John Smith has email john.smith@example.com and phone 555-123-4567."
SPANS = [("PERSON", 0, 10, 0.85, "John Smith"), ("EMAIL_ADDRESS", 21, 43, 0.85, "john.smith@example.com"),
         ("PHONE_NUMBER", 54, 66, 0.85, "555-123-4567")]
SCHEMA = "doc_id long, text string, entities array<struct<entity_type:string,start:int,end:int,score:double,text:string>>"


def _df(spark, text=TEXT, spans=SPANS):
    return spark.createDataFrame([(1, text, spans)], SCHEMA)


def test_replace(spark):
    r = A.redact(_df(spark)).first()
    assert r.redacted == "<PERSON> has email <EMAIL_ADDRESS> and phone <PHONE_NUMBER>."


def test_mask_and_remove(spark):
    assert A.redact(_df(spark), method="mask").first().redacted == \
        "********** has email ********************** and phone ************."
    assert A.redact(_df(spark), method="redact").first().redacted == " has email  and phone ."


def test_hash_matches_sha256(spark):
    import hashlib
    r = A.redact(_df(spark, "id 555-123-4567", [("PHONE_NUMBER", 3, 15, 0.9, "555-123-4567")]), method="hash").first()
    assert r.redacted == "id " + hashlib.sha256(b"555-123-4567").hexdigest()


def test_empty_and_no_entities_unchanged(spark):
    assert A.redact(_df(spark, "", [])).first().redacted == ""
    assert A.redact(_df(spark, "nothing here", [])).first().redacted == "nothing here"


def test_invalid_method_raises(spark):
    with pytest.raises(ValueError):
        A.redact(_df(spark), method="shred")


def test_overlaps_merge_before_replace(spark):
    spans = [("US_BANK_ROUTING", 3, 12, 0.8, "011000015"), ("AU_TFN", 3, 12, 0.9, "011000015")]
    r = A.redact(_df(spark, "no 011000015!", spans)).first()
    assert r.redacted == "no <AU_TFN>!"


def test_audit_offsets(spark):
    rows = A.audit(_df(spark)).orderBy("pos").collect()
    assert [(r.start, r.end, r.new_start, r.new_end) for r in rows] == [(0, 10, 0, 8), (21, 43, 19, 34),
                                                                         (54, 66, 45, 59)]
    red = A.redact(_df(spark)).first().redacted
    assert all(red[r.new_start:r.new_end] == r.replacement for r in rows)


def test_batch_missing_list_unchanged(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "keep me")], "doc_id long, text string")
    lists = _df(spark).select("doc_id", "entities")
    out = {r.doc_id: r.redacted for r in A.redact_batch(docs, lists).collect()}
    assert out[2] == "keep me" and out[1].startswith("<PERSON>")


def test_per_type_operators(spark):
    r = A.redact(_df(spark), operators={"EMAIL_ADDRESS": "mask"}).first()
    assert r.redacted == "<PERSON> has email ********************** and phone <PHONE_NUMBER>."
