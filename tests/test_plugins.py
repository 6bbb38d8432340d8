"""Model plug-in spans join native spans; custom operators."""

from pyspark.sql import functions as F

from tessera.functions import plugins as X
from tessera.operators import anonymize as A
from tessera.operators import detect as D


def test_model_plugin_spans_flow_into_redaction(spark):
    def caps_pairs(texts, model):
        # a stand-in "model": two capitalised words in a row are a PERSON
        import re as rx
        return [[{"entity_type": "PERSON", "start": m.start(), "end": m.end(), "score": model}
                 for m in rx.finditer(r"[A-Z][a-z]+ [A-Z][a-z]+", t or "")] for t in texts]

    det = X.model_detector(caps_pairs, name="caps", loader=lambda: 0.8)
    df = spark.createDataFrame([(1, "mail Ada Lovelace at ada@example.org")], "doc_id long, text string")
    both = df.select("doc_id", "text", F.concat(D.spans_column("text"), det("text")).alias("entities"))
    out = A.redact(both).first().redacted
    assert out == "mail <PERSON> at <EMAIL_ADDRESS>"


def test_custom_operator(spark):
    X.register_operator("initials", lambda s, t: F.concat(F.substr(s, F.lit(1), F.lit(1)), F.lit(".")))
    df = spark.createDataFrame([(1, "x john@x.org", [("EMAIL_ADDRESS", 2, 12, 0.9, "john@x.org")])],
                               "doc_id long, text string, entities array<struct<entity_type:string,start:int,"
                               "end:int,score:double,text:string>>")
    assert A.redact(df, method="initials").first().redacted == "x j."


def test_settings_threshold_zero_is_honoured():
    assert X.ScanSettings(threshold=0.0).effective_threshold() == 0.0
    assert X.ScanSettings(threshold=None).effective_threshold() == 0.7
