"""The log-structured ledger against a replay in plain Python."""

import datetime as dt
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import ledger_store as LS

FIELDS = ("file_id long, status string, error_message string, process_start timestamp_ntz, process_end timestamp_ntz, "
          "worker string, lease_until timestamp_ntz")
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return F.lit(T0 + dt.timedelta(seconds=seconds)).cast("timestamp_ntz")


def image(i, status, message=None):
    return (i, status, message, None, None, None, None)


def store(spark, tmp_path, n=200, buckets=5):
    s = LS.LedgerStore(spark, str(tmp_path / "ledger"))
    s.create(spark.createDataFrame([image(i, "pending") for i in range(n)], FIELDS), buckets)
    return s


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_state_equals_a_replay(spark, tmp_path):
    s, replay = store(spark, tmp_path), {i: image(i, "pending") for i in range(200)}
    r = random.Random(1)
    for batch in range(9):
        changed = [image(i, r.choice(["processing", "completed", "error"]), f"batch {batch}") for i in r.sample(range(230), 40)]
        replay |= {c[0]: c for c in changed}
        s.append(spark.createDataFrame(changed, FIELDS))
        if batch in (0, 4, 8):
            assert rows(s.state()) == sorted(replay.values())
        if batch == 5:
            before = rows(s.state())
            s.compact()
            assert rows(s.state()) == before == sorted(replay.values())
    assert not s.due() and rows(s.state(1)) == [image(i, "pending") for i in range(200)]  # old versions can be read
    s.compact()
    again = LS.LedgerStore(spark, str(tmp_path / "ledger"))
    spark.sql(f"DROP TABLE {again._table(again.latest()[1]['base'])}")  # another session does not know the table
    assert rows(again.state()) == sorted(replay.values())


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_the_base_is_never_shuffled(spark, tmp_path, threshold):
    s = store(spark, tmp_path, buckets=7)
    s.append(spark.createDataFrame([image(3, "error", "x")], FIELDS))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = s.state()._jdf.queryExecution().toString()
        plan = plan[plan.index("== Physical Plan =="):]
        lines = plan.splitlines()
        scan = next(i for i, x in enumerate(lines) if "Scan parquet" in x and "tessera_base" in x)
        depth = re.match(r"[\s:]*(\+-|:-)?", lines[scan]).end()
        # everything above the scan, up to the join
        for line in reversed(lines[:scan]):
            level = re.match(r"[\s:]*(\+-|:-)?", line).end()
            if level < depth:
                depth = level
                assert "Exchange" not in line
                if "Join" in line:
                    break
        assert rows(s.state())[3] == image(3, "error", "x")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_of_two_writers_one_commits(spark, tmp_path):
    s = store(spark, tmp_path)
    number, _ = s.latest()
    s.append(spark.createDataFrame([image(1, "completed")], FIELDS), number)
    with pytest.raises(LS.Conflict):
        s.append(spark.createDataFrame([image(1, "error")], FIELDS), number)
    assert rows(s.state())[1] == image(1, "completed") and s.latest()[0] == number + 1


def test_claimers_never_share_a_row(spark, tmp_path):
    s = store(spark, tmp_path)
    got = {}

    def work(name):
        mine = LS.LedgerStore(spark, str(tmp_path / "ledger"))
        got[name] = [[r.file_id for r in mine.claim(name, 15, at(0), "10 minutes").collect()] for _ in range(2)]
    threads = [threading.Thread(target=work, args=(f"w{i}",)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    all_ids = sorted(i for claims in got.values() for c in claims for i in c)
    assert all_ids == list(range(90))  # each row once, in order of the key
    assert sum(r.status == "processing" for r in s.state().collect()) == 90


def test_a_lost_lease_returns(spark, tmp_path):
    s = store(spark, tmp_path, n=10)
    assert [r.file_id for r in s.claim("a", 4, at(0), "5 minutes").collect()] == [0, 1, 2, 3]
    assert [r.file_id for r in s.claim("b", 2, at(100), "5 minutes").collect()] == [4, 5]
    # a is late with two files: b takes what its lease has let go
    late = s.finish("a", spark.createDataFrame([(0, True, None), (1, False, "broken")], "file_id long, ok boolean, error_message string"), at(200))
    assert late.count() == 0
    assert sorted(r.file_id for r in s.claim("b", 3, at(301), "5 minutes").collect()) == [2, 3, 6]
    lost = s.finish("a", spark.createDataFrame([(2, True, None), (0, True, None)], "file_id long, ok boolean, error_message string"), at(310))
    assert sorted(tuple(r) for r in lost.collect()) == [(0, "not in process"), (2, "claimed by another worker")]
    lost = s.finish("b", spark.createDataFrame([(4, True, None), (6, True, None)], "file_id long, ok boolean, error_message string"), at(450))
    assert [tuple(r) for r in lost.collect()] == [(4, "lease has run out")]
    by = {r.file_id: (r.status, r.error_message, r.worker) for r in s.state().collect()}
    assert by[0] == ("completed", None, "a") and by[1] == ("error", "broken", "a") and by[2] == ("processing", None, "b")
    assert by[6] == ("completed", None, "b") and by[7] == ("pending", None, None)
