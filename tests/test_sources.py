"""Sources: the reference's nested JSON report, markup to text, listing."""

import json

from pyspark.sql import functions as F

from tessera.sources import listing as LS
from tessera.sources import reports as RP
from tessera.sources import text as TX

REPORT = {
    "job_id": 7, "command_line": "scan /data", "start_time": "2025-01-01 12:00:00", "end_time": None,
    "status": "completed", "total_files": 2, "processed_files": 2, "error_files": 0,
    "results": [
        {"file_path": "/data/a.txt", "file_type": ".txt", "entities": [
            {"entity_type": "EMAIL_ADDRESS", "start": 0, "end": 5, "score": 0.9, "text": "a@b.c"},
            {"start": 7, "end": 9},
        ]},
        {"file_path": "/data/b.pdf", "entities": []},
    ],
}


def test_reference_report_reader_defaults(spark, tmp_path):
    path = tmp_path / "report.json"
    path.write_text(json.dumps(REPORT, indent=2))
    files = RP.flatten_nested(RP.read_nested_report(spark, str(path)))
    assert files.count() == 2
    ents = sorted(tuple(r) for r in RP.report_entities(files).select("file_path", "entity_type", "score", "text")
                  .collect())
    assert ents == [("/data/a.txt", "", 0.0, ""), ("/data/a.txt", "EMAIL_ADDRESS", 0.9, "a@b.c")]


def test_html_to_text(spark):
    html = ("<html><head><title>T&amp;C</title><style>p{x:1}</style><script>var a='<p>';</script></head>"
            "<body><p>Mail <b>me</b> at a@b.org</p><!-- hidden --><div>x &lt; y</div></body></html>")
    df = spark.createDataFrame([(html,)], "h string")
    out = df.select(TX.html_to_text(F.col("h")).alias("t")).first().t
    assert out == "T&C\nMail me at a@b.org\nx < y"


def test_listing_filters_extensions(spark, tmp_path):
    for name in ["a.txt", "b.PDF", "c.exe", "sub/d.docx", "sub/e.zip", ".hidden"]:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * 10)
    df = LS.list_files(spark, str(tmp_path))
    got = sorted((r.file_path.split("/")[-1], r.file_size, r.file_type) for r in df.collect())
    assert got == [("a.txt", 10, ".txt"), ("b.PDF", 10, ".pdf"), ("d.docx", 10, ".docx")]


def test_nested_export_records_cover_parts(spark, monkeypatch):
    from tessera.plans.testbed import Testbed
    from conftest import SF_SMALL
    tb = Testbed(spark, SF_SMALL)
    monkeypatch.setattr(RP, "PART_CHARS", 20)
    rec = RP.nested_records(tb.jobs, tb.files, tb.results, tb.entities)
    per_file = rec.groupBy("file_path").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.size("entities")).alias("n"))
    rows = per_file.collect()
    assert all(r.parts > 1 for r in rows if r.n >= 6)
    for r in rec.select("part", "entities").collect():
        assert all(e.start // 20 == r.part for e in r.entities)
    monkeypatch.undo()
    whole = RP.nested_records(tb.jobs, tb.files, tb.results, tb.entities)
    a = {r.file_path: r.n for r in per_file.collect()}
    b = {r.file_path: r.n for r in whole.groupBy("file_path").agg(F.sum(F.size("entities")).alias("n")).collect()}
    assert a == b
