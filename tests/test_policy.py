"""Policy truth table (FIXTURES §7) and report masks."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import masks as M
from tessera.functions import policy as P

TRUTH = [
    (["PERSON", "US_SSN"], True, "PII-SSN", 3),
    (["FIRST_NAME", "LAST_NAME", "CREDIT_CARD"], True, "PII-FIN", 3),
    (["FIRST_NAME", "US_SSN"], False, "UNKNOWN", 3),
    (["PERSON", "US_PASSPORT"], True, "PII-GOV", 3),
    (["PERSON", "MEDICAL_RECORD_NUMBER"], True, "PII-MED", 3),
    (["PERSON", "PIN_CODE"], True, "PII-GEN", 3),
    (["EMAIL_ADDRESS", "ACCESS_CODE"], True, "CREDS", 3),
    (["PERSON", "PIN_CODE", "USERNAME", "PASSWORD"], True, "CREDS", 3),
    (["PERSON", "US_SSN", "CREDIT_CARD"], True, "HIGH-RISK", 3),
    (["PERSON", "STUDENT_ID"], False, "UNKNOWN", 2),
    (["PERSON", "IBAN_CODE"], True, "PII-FIN", 2),
    (["EMAIL_ADDRESS"], False, "UNKNOWN", 1),
    (["LOCATION"], False, "UNKNOWN", 0),
]


def test_truth_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_rest) in enumerate(TRUTH)], "i int, t array<string>")
    out = {r.i: r for r in df.select("i", P.breach_trigger(F.col("t")).alias("trig"),
                                     P.breach_label(F.col("t")).alias("label"),
                                     P.set_tier(F.col("t")).alias("tier")).collect()}
    for i, (_, trig, label, tier) in enumerate(TRUTH):
        assert (out[i].trig, out[i].label, out[i].tier) == (trig, label, tier), TRUTH[i]


MASKS = [
    ("US_SSN", "123-45-6789", "****6789", "********", "****6789"),
    ("EMAIL_ADDRESS", "john.smith@example.com", "j***@example.com", "j********h@example.com", "jo***@example.com"),
    ("EMAIL_ADDRESS", "jo@x.org", "***@x.org", "jo@x.org", "***@x.org"),
    ("PERSON", "John Q Smith", "J. Q. S.", "J*** Q S****", "J. Smith"),
    ("PERSON", "Madonna", "M.", "M******", "Madonna"),
    ("PHONE_NUMBER", "(555) 123-4567", "(***7", "(************7", "***-***-4567"),
    ("US_PASSPORT", "X1234567", "****4567", "****4567", "X***7"),
    ("ORG", "ACME", "****", "A**E", "****"),
    ("USERNAME", "jsmith", "j***h", "j****h", "j***h"),
]


@pytest.mark.parametrize("etype,text,strict,tiered,simple", MASKS)
def test_masks(spark, etype, text, strict, tiered, simple):
    df = spark.createDataFrame([(etype, text)], "t string, x string")
    r = df.select(M.mask_strict(F.col("x"), F.col("t")).alias("a"), M.mask_tiered(F.col("x"), F.col("t")).alias("b"),
                  M.mask_simple(F.col("x"), F.col("t")).alias("c")).first()
    assert (r.a, r.b, r.c) == (strict, tiered, simple)


def test_display_name_defaults_to_key(spark):
    df = spark.createDataFrame([("CREDIT_CARD",), ("SOMETHING_NEW",)], "t string")
    got = [r.n for r in df.select(P.display_name(F.col("t")).alias("n")).collect()]
    assert got == ["Credit Card Number", "SOMETHING_NEW"]
