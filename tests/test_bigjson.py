"""The reader of one large JSON report against json.loads."""

import json
import random

import pytest

from tessera.sources import bigjson as B


def doc(seed, files, tricky):
    r = random.Random(seed)

    def text():
        return "".join(r.choice(tricky) for _ in range(r.randint(0, 12)))
    out = {"job_id": seed, "command_line": text(), "status": "completed", "total_files": files,
           "extra": {"entities": [{"entity_type": "NO"}], "results": [{"file_path": "no", "entities": [{"text": "no"}]}]},
           "results": []}
    for i in range(files):
        f = {"file_path": f"/a/{seed}/{i}{text()}", "file_size": i, "metadata": {"note": text()},
             "entities": [{"entity_type": r.choice("XYZ"), "start": j, "end": j + 1, "score": r.random(), "text": text(),
                           "more": {"entities": [{"x": 1}], "deep": [[{}]]}}
                          for j in range(r.choice([0, 1, 2, 30]))]}
        if r.random() < 0.2:
            del f["entities"]
        out["results"].append(f)
    if seed % 2:
        out["tail"] = [{"a": [{"b": {}}]}]
    return out


def want(docs):
    files = sorted((d["job_id"], f["file_path"], f["file_size"], f["metadata"]["note"]) for d in docs for f in d["results"])
    spans = sorted((d["job_id"], f["file_path"], e["entity_type"], e["start"], e["score"], e["text"])
                   for d in docs for f in d["results"] for e in f.get("entities", []))
    return files, spans


def got(spark, path, **options):
    report = B.read_large_report(spark, path, **options)
    head = {(r.doc, r.opened): r for r in report.header.collect()}
    files = {(r.doc, r.record): (head[r.doc, r.opened].job_id, r) for r in report.files.collect()}
    rows = sorted((j, r.file_path, r.file_size, r.metadata["note"]) for j, r in files.values())
    spans = sorted((files[e.doc, e.record][0], files[e.doc, e.record][1].file_path, e.entity_type, e.start, e.score, e.text)
                   for e in report.entities.collect())
    return list(head.values()), rows, spans


TRICKY = ["{", "}", "[", "]", '"', "\\", ",", ":", "a", "é", "\n", '"entities": [', "}]}", "\\\"", " "]


@pytest.mark.parametrize("plain,indent,end", [(True, None, ""), (False, 2, "\n"), (False, None, "\n\n"), (False, None, "")])
def test_one_document_in_many_tasks(spark, tmp_path, plain, indent, end):
    d = doc(1, 60, TRICKY)
    path = tmp_path / "report.json"
    path.write_text(json.dumps(d, indent=indent, ensure_ascii=False) + end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        fragments = B._fragments(spark, str(path), False)
        assert fragments.rdd.getNumPartitions() > 4 or fragments.select("block").distinct().count() > 4
        head, files, spans = got(spark, str(path), plain=plain)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(h.job_id, h.command_line, h.status, h.total_files) for h in head] == [(1, d["command_line"], "completed", 60)]
    assert (files, spans) == want([d])


def test_several_documents_and_odd_ones(spark, tmp_path):
    docs = [doc(i, 5, TRICKY) for i in range(2, 6)]
    (tmp_path / "many.json").write_text("\n".join(json.dumps(d) for d in docs))
    _, files, spans = got(spark, str(tmp_path / "many.json"))
    assert (files, spans) == want(docs)
    for i, text in enumerate(('{"job_id": 7, "results": []}', '{"job_id": 7}', '{"job_id": 7, "results": [null, 3, "x"]}',
                              '{"job_id": 7, "results": [{}]}', '{"job_id": 7, "results": [{"entities": [null, {}]}]}', '')):
        path = tmp_path / f"odd{i}.json"
        path.write_text(text)
        report = B.read_large_report(spark, str(path))
        assert [r.job_id for r in report.header.collect()] == ([7] if text else [])
        assert report.files.count() == (i in (3, 4))
        assert [(r.entity_type, r.score, r.text) for r in report.entities.collect()] == ([("", 0.0, "")] if i == 4 else [])


def test_write_and_read_back(spark, tmp_path):
    d = doc(9, 40, TRICKY)
    head = spark.createDataFrame([(9, d["command_line"])], "job_id long, command_line string")
    files = spark.createDataFrame([(i, f["file_path"], f["file_size"], f["metadata"]) for i, f in enumerate(d["results"])],
                                  "record long, file_path string, file_size long, metadata map<string,string>").repartition(3)
    spans = spark.createDataFrame([(i, j, e["entity_type"], e["start"], e["score"], e["text"]) for i, f in enumerate(d["results"])
                                   for j, e in enumerate(f.get("entities", []))],
                                  "record long, entity long, entity_type string, start int, score double, text string").repartition(3)
    out = tmp_path / "out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        B.write_large_report(head, files, spans, str(out))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(out.glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and want([{**whole, "job_id": 9}])[1] == want([d])[1]
    _, rows, entities = got(spark, str(out), joined=True, plain=False)
    assert (rows, entities) == want([d])
    none = files.limit(0)
    B.write_large_report(head, none, spans.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))["results"] == []


def test_running_values_without_shuffles(spark, tmp_path):
    """The stored parts are read in place: their texts are not joined or sorted again."""
    path = tmp_path / "report.json"
    path.write_text(json.dumps(doc(1, 20, TRICKY)))
    plan = B.report_pieces(spark, str(path), plain=False)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Join", "Window", "Exchange", "Sort"))
