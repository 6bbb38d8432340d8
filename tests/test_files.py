"""Documents written to their own paths: whole, once, and nothing after a failure."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as FS
from tessera.sources import sinks as SK


def on_disk(base):
    return {os.path.relpath(os.path.join(d, f), base): open(os.path.join(d, f), encoding="utf-8", newline="").read()
            for d, _, names in os.walk(base) for f in names if "/_" not in d[len(base):] and not f.startswith(".")}


def test_files_stand_at_their_paths(spark, tmp_path):
    docs = {f"a/{i % 7}/f {i}.txt": f"text {i}\nÄ\r\nend" for i in range(40)} | {"top.json": "", "ünï/c++ (old)/x.y.txt": "z\n"}
    df = spark.createDataFrame([*docs.items(), ("none.txt", None)], "path string, content string").repartition(5)
    base = str(tmp_path / "out")
    written = {r.path: r.bytes for r in FS.write_files(df, base).collect()}
    assert on_disk(base) == docs and written == {p: len(c.encode()) for p, c in docs.items()}
    assert not [n for n in os.listdir(base) if n.startswith("_staging")]
    # a second run replaces what it writes and leaves the rest
    FS.write_files(spark.createDataFrame([("top.json", "new")], "path string, content string"), base)
    assert on_disk(base) == docs | {"top.json": "new"}
    FS.write_files(df.limit(0), base)
    assert on_disk(base) == docs | {"top.json": "new"}


def test_read_back(spark, tmp_path):
    docs = {f"a/{i % 3}/f{i}.txt": f"text {i}\nlast" for i in range(9)}
    FS.write_files(spark.createDataFrame(list(docs.items()), "path string, content string"), str(tmp_path / "out"))
    assert {r.path: r.content for r in FS.read_files(spark, str(tmp_path / "out")).collect()} == docs


@pytest.mark.parametrize("bad", ["/etc/x", "../x", "a/../../x", "", None, "a//b"])
def test_paths_stay_below_the_folder(spark, tmp_path, bad):
    df = spark.createDataFrame([(f"f{i}", "x") for i in range(20)] + [(bad, "x")], "path string, content string").repartition(4)
    with pytest.raises(Exception, match="not a path below"):
        FS.write_files(df, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or on_disk(str(tmp_path / "out")) == {}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.range(50).repartition(5).select(
        F.concat(F.lit("f"), "id").alias("path"),
        F.when(F.col("id") == 33, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="broken row"):
        FS.write_files(df, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or on_disk(str(tmp_path / "out")) == {}


def test_one_path_one_document(spark, tmp_path):
    df = spark.createDataFrame([("a/x", "1"), ("a/y", "2"), ("a/x", "3")], "path string, content string").repartition(3)
    with pytest.raises(ValueError, match="a/x"):
        FS.write_files(df, str(tmp_path / "out"))
    assert on_disk(str(tmp_path / "out")) == {}


def test_redacted_documents(spark, tmp_path):
    from tessera.operators import anonymize as A
    from tessera.operators import detect as D
    docs = spark.createDataFrame([(1, "/in/a/b.txt", "mail a@b.org now"), (2, "/in/c.txt", "nothing")],
                                 "doc_id long, file_path string, text string")
    red = A.redact(D.detect_arrays(docs, id_cols=("doc_id", "file_path", "text")), keep_islands=True)
    rel = F.substr(SK.relative_output(F.col("file_path"), "/in", ""), F.lit(2))
    FS.write_redacted(red, str(tmp_path / "t"), rel)
    assert on_disk(str(tmp_path / "t")) == {"a/b.txt": "mail <EMAIL_ADDRESS> now"}
    FS.write_redacted(red, str(tmp_path / "j"), rel, as_json=True)
    assert json.loads(on_disk(str(tmp_path / "j"))["a/b.txt"]) == {
        "file_path": "a/b.txt", "original_text_length": 16, "anonymized_text_length": 24, "entities_redacted": 1,
        "anonymize_method": "replace", "anonymized_text": "mail <EMAIL_ADDRESS> now"}


def test_relative_paths_take_the_folder_as_it_is(spark):
    rows = [("/data/c++ (old)/a/b.txt",), ("/data/c++ (old)",), ("/other/x.txt",), ("/data/cxx (old)/y",)]
    df = spark.createDataFrame(rows, "p string").select(SK.relative_output(F.col("p"), "/data/c++ (old)/", "/out").alias("o"))
    assert [r.o for r in df.collect()] == ["/out/a/b.txt", "/out//data/c++ (old)", "/out//other/x.txt", "/out//data/cxx (old)/y"]
