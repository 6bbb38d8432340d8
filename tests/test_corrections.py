"""Inputs on which earlier versions went wrong."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.strings import strip
from tessera.operators import ledger as L
from tessera.sources import sinks as SK, text as TX
from tessera.streaming import streams as S


def _one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw", [" \n\t ", "\n", "a b", "\u00a0 x\u3000\r\n", "\x1c\x85y ", "", "\u2003z z\x0b"])
def test_strip(spark, raw):
    assert _one(spark, raw, strip) == raw.strip()


@pytest.mark.parametrize("path", ["/corpus/x/../job2/./.", "/a//b/", "/", "//", "a/../..", "../a", "/../a", "a/./b/..", "", "."])
def test_normalise_dir(spark, path):
    import posixpath
    want = posixpath.normpath(path)
    assert _one(spark, path, L.normalise_dir) == (want[1:] if want.startswith("//") else want)


def test_html_entities_and_scripts(spark):
    html = "<p>&#169; a&hellip;&#x41;&amp;lt;&#0;</p><script>x</style>y</script><style>p{}</style>&eacute"
    assert _one(spark, html, TX.html_to_text) == "\u00a9 a\u2026A&lt;&#0;\n&eacute"


def test_copy_targets_are_unique(spark):
    rows = [("/a/f.txt",), ("/b/f.txt",), ("/c/f_1.txt",), ("/d/f.txt",), ("/e/f_1.txt",), ("/f/f_3.txt",), ("/g/f.txt",)]
    df = spark.createDataFrame(rows, "file_path string").withColumn("tier", F.lit(2))
    got = {r.file_path: r.target_path.rsplit("/", 1)[1] for r in SK.copy_manifest(df, "/clone").collect()}
    assert got == {"/a/f.txt": "f.txt", "/b/f.txt": "f_2.txt", "/c/f_1.txt": "f_1.txt", "/d/f.txt": "f_4.txt",
                   "/e/f_1.txt": "f_1_1.txt", "/f/f_3.txt": "f_3.txt", "/g/f.txt": "f_5.txt"}


def test_register_new_lists_a_path_once(spark):
    listing = spark.createDataFrame([(1, "/a"), (1, "/a"), (2, "/a"), (1, "/b")], "job_id int, file_path string")
    known = spark.createDataFrame([(1, "/b")], "job_id int, file_path string")
    assert sorted(tuple(r) for r in L.register_new(listing, known).collect()) == [(1, "/a"), (2, "/a")]


def test_size_gate_names_its_limit(spark):
    got = _one(spark, 3 * 1024 * 1024, lambda c: L.size_gate_message(c, 2 * 1024 * 1024), "long")
    assert got == "File too large: 3.00MB (max 2MB)"


def _files(spark, path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return (spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
            .parquet(str(path)))


def test_stalled_files_do_not_depend_on_batches(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)

    def at(s):
        return t0 + dt.timedelta(seconds=s)
    starts = [(1, at(0)), (2, at(0)), (3, at(10)), (4, at(20)), (4, at(30)), (9, at(90000))]
    ends = [(1, at(200)), (2, at(3000)), (3, at(5)), (9, at(90001))]
    want = {(2, at(0)), (3, at(10)), (4, at(20)), (4, at(30))}
    for name, a, b in (("one", [starts], [ends]), ("many", [[x] for x in starts], [[x] for x in ends])):
        s = _files(spark, tmp_path / name / "s", a, "file_id long, started timestamp")
        e = _files(spark, tmp_path / name / "e", b, "file_id long, ended timestamp")
        got = [(r.file_id, r.started) for r in S.drained(S.stalled_items(s, e), "test_stalled").collect()]
        assert sorted(got) == sorted(want), name


def test_last_window_values_do_not_depend_on_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "value").orderBy("ts").collect()
    schema = "event_id long, ts timestamp, value double"

    def counts(name, parts):
        e = _files(spark, tmp_path / name, parts, schema).withWatermark("ts", "1 hour")
        agg = e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events"))
        return sorted(tuple(r) for r in S.latest(agg.select("w.start", "events"), "test_latest", ["start"]).collect())
    n = len(events) // 4 + 1
    one = counts("one", [events])
    assert one and one == counts("many", [events[i:i + n] for i in range(0, len(events), n)])


def test_replayed_rates_batch_changes_nothing(spark):
    rows = S.stream_rates(spark, "/root/testdata/sf0.001")
    assert rows.groupBy("event_id").count().where("count > 1").count() == 0
