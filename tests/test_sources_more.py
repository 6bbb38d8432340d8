"""Directory rounds, schema versions, JSON bags and the SQL table function."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import bags as B
from tessera.sources import versions as VS
from tessera.sources import walk as WK


def test_walk_equals_the_file_system(spark, tmp_path):
    want = {}
    for i in range(60):
        folder = tmp_path / "root" / f"a{i % 3}" / f"b {i % 4}" / ("é" if i % 2 else "") / f"c{i % 5}"
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / f"f{i}{['.txt', '.PDF', '.exe', ''][i % 4]}"
        path.write_text("x" * i)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
        want[str(path)] = (i, 1_700_000_000 + i)
    (tmp_path / "root" / "empty").mkdir()
    (tmp_path / "root" / "a0" / "loop").symlink_to(tmp_path / "root")
    got = {r.file_path: (r.file_size, int(r.modified_time.replace(tzinfo=dt.timezone.utc).timestamp())) for r in WK.walk(
        spark, str(tmp_path / "root"), None).collect()}
    assert got == want
    some = WK.walk(spark, f"file:{tmp_path}/root/", ["txt", ".pdf"]).collect()
    assert {r.file_path for r in some} == {p for p in want if p.lower().endswith((".txt", ".pdf"))}
    assert {r.file_type for r in some} == {".txt", ".pdf"}
    assert WK.walk(spark, str(tmp_path / "root"), None, recursive=False).count() == 0
    assert WK.walk(spark, str(tmp_path / "none"), None).count() == 0


def test_versions_are_read_as_one(spark, tmp_path):
    path = str(tmp_path / "t")
    VS.write_version(spark.createDataFrame([(1, "a")], "id int, name string"), path, 1)
    VS.write_version(spark.createDataFrame([(2, "b", None), (3, None, "new")], "id long, name string, extra string"), path, 2)
    schema = "id long, name string, extra string, later double"
    rows = VS.read_versions(spark, path, schema, {"extra": (2, "old"), "later": (3, 0.5)}, newest=2).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", "old", 0.5, 1), (2, "b", None, 0.5, 2), (3, None, "new", 0.5, 2)]
    assert [r.extra for r in VS.read_versions(spark, path, schema).orderBy("id").collect()] == [None, None, "new"]
    VS.write_version(spark.createDataFrame([(4,)], "id long"), path, 7)
    with pytest.raises(Exception, match="schema version 7 is newer than 2"):
        VS.read_versions(spark, path, schema, newest=2).collect()


def test_bags(spark):
    texts = ['{"a": {"b": [1, "x", 2.5]}}', "[]", '"s"', "true", "null", "12", '{"a": 1', "", None, "nope"]
    df = B.with_bag(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    rows = df.select("i", B.kind(F.col("bag")).alias("kind"), B.field(F.col("bag"), "$.a.b[1]").alias("x"),
                     B.field(F.col("bag"), "$.a.b[1]", "int").alias("n"), B.field(F.col("bag"), "$.a.b[2]", "double").alias("d"),
                     "corrupt").orderBy("i").collect()
    assert [r.kind for r in rows] == ["object", "array", "string", "boolean", "null", "number", None, None, None, None]
    assert [r.corrupt for r in rows] == [None] * 6 + ['{"a": 1', "", None, "nope"]
    assert (rows[0].x, rows[0].n, rows[0].d) == ("x", None, 2.5)


def test_the_table_function_needs_no_join(spark):
    from tessera.plans.views import register_functions
    register_functions(spark)
    spark.createDataFrame([(1, "mail a@b.org and c@d.org"), (2, ""), (3, None)], "doc_id long, text string").createOrReplaceTempView("some_docs")
    df = spark.sql("SELECT doc_id, s.text FROM some_docs, LATERAL detect_spans(text) s")
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a@b.org"), (1, "c@d.org")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
