"""Detection: golden sample text, offsets, checksums, pruning, blank guard."""

import random

from pyspark.sql import functions as F

from tessera.functions import checksums as ck
from tessera.operators import detect as D

SAMPLE = ("Name: John Smith\nEmail: john.smith@example.com\nPhone: (555) 123-4567\n"
          "SSN: 123-45-6789\nAddress: 123 Main Street, Springfield\nCredit Card: 4111-1111-1111-1111\n"
          "token = \"0123456789abcdef0123\" and password: hunter22 and username: jsmith\n"
          "IBAN GB82WEST12345698765432, host 192.168.10.254, bad ip 999.1.1.1\n")


def _spans(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {(r.entity_type, r.text): r for r in D.detect_entities(df, **kw).collect()}


def test_sample_text_types(spark):
    s = _spans(spark, SAMPLE)
    got = {t for t, _ in s}
    for t in ["PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "ADDRESS", "CREDIT_CARD", "ACCESS_CODE",
              "PASSWORD", "USERNAME", "IBAN_CODE", "IP_ADDRESS"]:
        assert t in got, t
    assert ("PERSON", "John Smith") in s
    assert ("CREDIT_CARD", "4111-1111-1111-1111") in s
    assert ("IP_ADDRESS", "192.168.10.254") in s
    assert not any(t == "IP_ADDRESS" and x.startswith("999") for t, x in s)


def test_offsets_slice_the_text(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "é" * 5 + " mail a.b@c.de ünï 4111111111111111")],
                               "doc_id long, text string")
    texts = {1: SAMPLE, 2: "é" * 5 + " mail a.b@c.de ünï 4111111111111111"}
    rows = D.detect_entities(df, threshold=None).collect()
    assert rows
    for r in rows:
        assert texts[r.doc_id][r.start:r.end] == r.text


def test_threshold_inclusive_and_zero_honoured(spark):
    df = spark.createDataFrame([(1, "call 555-123-4567 now")], "doc_id long, text string")
    assert D.detect_entities(df, threshold=0.85).count() == 1     # score 0.85 >= 0.85
    assert D.detect_entities(df, threshold=0.0).count() >= 1


def test_blank_text_has_no_entities(spark):
    df = spark.createDataFrame([(1, "   "), (2, ""), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.entities for r in D.detect_arrays(df).collect()}
    assert all(v == [] for v in out.values())


def test_entity_pruning(spark):
    s = _spans(spark, SAMPLE, entities=["EMAIL_ADDRESS"])
    assert {t for t, _ in s} == {"EMAIL_ADDRESS"}


def test_token_edges(spark):
    s = _spans(spark, "x4111111111111111 4111111111111111y 4111111111111111", threshold=None)
    cards = [v for (t, v) in s if t == "CREDIT_CARD"]
    assert cards == ["4111111111111111"]


def _luhn(d):
    tot = 0
    for i, ch in enumerate(reversed(d)):
        x = int(ch)
        if i % 2 == 1:
            x = x * 2 - 9 if x * 2 > 9 else x * 2
        tot += x
    return tot % 10 == 0


def _iban(s):
    r = s[4:] + s[:4]
    n = int("".join(str(int(c, 36)) for c in r))
    return n % 97 == 1


def test_checksums_against_python(spark):
    rnd = random.Random(7)
    cards = ["".join(rnd.choice("0123456789") for _ in range(16)) for _ in range(300)] + ["4111111111111111"]
    ibans = ["GB82WEST12345698765432", "DE89370400440532013000", "GB82WEST12345698765433"]
    df = spark.createDataFrame([(c,) for c in cards], "c string")
    got = {r.c: r.ok for r in df.select("c", ck.luhn_ok(F.col("c")).alias("ok")).collect()}
    assert all(got[c] == _luhn(c) for c in cards)
    df = spark.createDataFrame([(c,) for c in ibans], "c string")
    got = {r.c: r.ok for r in df.select("c", ck.iban_ok(F.col("c")).alias("ok")).collect()}
    assert all(got[c] == _iban(c) for c in ibans)
    assert got["GB82WEST12345698765432"] and not got["GB82WEST12345698765433"]


def test_routing_nhs_tfn_medicare(spark):
    rows = [("011000015", "aba", True), ("011000016", "aba", False), ("9434765919", "nhs", True),
            ("9434765918", "nhs", False), ("123456782", "tfn", True), ("123456789", "tfn", False),
            ("2123456701", "medicare", True), ("2123456711", "medicare", False)]
    df = spark.createDataFrame(rows, "v string, k string, want boolean")
    f = {"aba": ck.aba_routing_ok, "nhs": ck.nhs_ok, "tfn": ck.au_tfn_ok, "medicare": ck.au_medicare_ok}
    for k, fn in f.items():
        res = df.where(F.col("k") == k).select("want", fn(F.col("v")).alias("ok")).collect()
        assert all(r.want == r.ok for r in res), k


def test_terms_of_any_length(spark):
    docs = spark.createDataFrame([
        (1, "Her fingerprint and a retina scan; ITAR rules. Retina-scan again."),
        (2, "The United States Department of Commerce, New York City and York; united states of all."), (3, None),
        (4, ""), (5, "fingerprints x2retina scan")], "doc_id long, text string")
    terms = spark.createDataFrame([
        ("BIO", "fingerprint"), ("BIO", "retina scan"), ("ITAR", "ITAR"), ("ORG", "United States Department of Commerce"),
        ("ORG", "united states"), ("ORG", "united states of a"), ("CITY", "York"), ("CITY", "New York City")],
        "entity_type string, term string")
    got = sorted((r.doc_id, r.entity_type, r.text) for r in D.detect_terms(docs, terms).collect())
    assert got == sorted([
        (1, "BIO", "fingerprint"), (1, "BIO", "retina scan"), (1, "ITAR", "ITAR"), (1, "BIO", "Retina-scan"),
        (2, "ORG", "United States Department of Commerce"), (2, "ORG", "united states"),
        (2, "CITY", "New York City"), (2, "CITY", "York")])
    for r in D.detect_terms(docs, terms).join(docs.withColumnRenamed("text", "t"), "doc_id").collect():
        assert r.t[r.start:r.end] == r.text
    many = spark.range(6000).selectExpr("'N' AS entity_type", "concat('term', id) AS term").union(terms)
    assert D.detect_terms(docs, many).count() == len(got)


def test_islands_do_not_overlap(spark):
    df = spark.createDataFrame(
        [(1, "A", 0, 10, 0.5), (1, "B", 5, 12, 0.9), (1, "C", 12, 14, 0.6), (1, "D", 20, 30, 0.7),
         (1, "E", 20, 30, 0.7)], "doc_id long, entity_type string, start int, end int, score double")
    isl = sorted((r.start, r.end, r.entity_type, r.n_spans) for r in D.span_islands(df).collect())
    assert isl == [(0, 12, "B", 2), (12, 14, "C", 1), (20, 30, "E", 2)]


def test_overlap_pairs_bucketed_equal_bruteforce(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        s = rnd.randrange(0, 5000)
        rows.append((i % 3, rnd.choice("ABCD"), s, s + rnd.randrange(1, 300)))
    df = spark.createDataFrame(rows, "doc_id long, entity_type string, start int, end int")
    got = sorted(tuple(r) for r in D.span_overlaps(df, bucket=256).collect())
    want = sorted((a[0], a[1], a[2], a[3], b[1], b[2], b[3]) for a in rows for b in rows
                  if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[1] < b[1])
    assert got == want


def test_long_text_in_long_and_array_form(spark):
    import time
    rnd = random.Random(5)
    parts = [rnd.choice(["lorem ipsum ", f"mail a{i}@x.org ", "4111111111111111 ", f"ip 10.0.0.{i % 250} ",
                         f'token = "abcdef{i:04d}" ', f"call 555-123-{i % 10000:04d} ", "zip: 27514 "]) for i in range(20000)]
    text = "".join(parts) + "password: " + "p" * 3000
    df = spark.createDataFrame([(1, text), (2, "short a@b.co")], "doc_id long, text string")
    began = time.time()
    rows = D.detect_entities(df).collect()
    assert time.time() - began < 60
    assert sorted((r.doc_id, r.entity_type, r.start, r.end) for r in rows) == sorted(
        (r.doc_id, s.entity_type, s.start, s.end) for r in D.detect_arrays(df).collect() for s in r.entities)
    assert all(text[r.start:r.end] == r.text for r in rows if r.doc_id == 1)
    assert max(r.end - r.start for r in rows) == 3000 and len(rows) > 15000


def test_islands_two_level_equals_window(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 1, 1, 2]), rnd.choice("ABC"), s, s + rnd.randrange(1, 40), rnd.choice([0.5, 0.7, 0.9]))
            for s in (rnd.randrange(0, 3000) for _ in range(800))]
    df = spark.createDataFrame(rows, "doc_id long, entity_type string, start int, end int, score double")
    a = sorted(tuple(r) for r in D.span_islands(df).collect())
    b = sorted(tuple(r) for r in D.span_islands(df, plain=False).collect())
    assert a == b


def test_sql_checks_equal_column_checks(spark):
    from tessera.functions.detector_sql import check_sql
    rnd = random.Random(13)
    vals = ["".join(rnd.choice("0123456789") for _ in range(n)) for n in (9, 10, 16) for _ in range(150)]
    vals += ["011000015", "9434765919", "123456782", "2123456701", "4111-1111-1111-1111", "123-45-6789",
             "912-70-1234", "192.168.1.1", "256.1.1.1", "GB82WEST12345698765432", "DE89370400440532013000"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    pairs = {"luhn": ck.luhn_ok, "aba": ck.aba_routing_ok, "nhs": ck.nhs_ok, "tfn": ck.au_tfn_ok,
             "medicare": ck.au_medicare_ok, "ssn": ck.ssn_ok, "itin": ck.itin_ok}
    cols = [F.expr(check_sql(k, "v")).alias("s_" + k) for k in pairs] + [fn(F.col("v")).alias("c_" + k)
                                                                         for k, fn in pairs.items()]
    for r in df.select("v", *cols).collect():
        for k in pairs:
            assert bool(r["s_" + k]) == bool(r["c_" + k]), (k, r.v)
    ip = df.where(F.col("v").rlike("^[0-9]{1,3}(\\\\.[0-9]{1,3}){3}$"))
    for r in ip.select("v", F.expr(check_sql("ipv4", "v")).alias("s"), ck.ipv4_ok(F.col("v")).alias("c")).collect():
        assert r.s == r.c
    ib = df.where(F.col("v").rlike("^[A-Z]{2}"))
    for r in ib.select("v", F.expr(check_sql("iban", "v")).alias("s"), ck.iban_ok(F.col("v")).alias("c")).collect():
        assert r.s == r.c
