"""Two-level scans on a hot key agree with brute force."""

import random

from pyspark.sql import functions as F

from tessera.operators.parallel import lagged, prefix_scan, ranked


def _rows():
    rnd = random.Random(11)
    # key 0 holds ~2/3 of the rows (the hot group)
    return [(0 if rnd.random() < 0.66 else rnd.randrange(1, 6), i, rnd.randrange(0, 1000)) for i in range(3000)]


def test_ranked_and_scans_match_bruteforce(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k long, ord long, v long")
    out = prefix_scan(df, ["ord"], ["k"], sums={"v": "run_sum"}, maxes={"v": "prev_max"}, inclusive=True, parts=7,
                      plain=False)
    got = {r.ord: (r.run_sum, r.prev_max) for r in out.collect()}
    want = {}
    acc = {}
    for k, o, v in sorted(rows, key=lambda x: (x[0], x[1])):
        s, m = acc.get(k, (0, None))
        s, m = s + v, v if m is None else max(m, v)
        acc[k] = (s, m)
        want[o] = (s, m)
    assert got == want
    rk = {r.ord: r.rn for r in ranked(df, ["ord"], ["k"], parts=5, plain=False).collect()}
    pos = {}
    for k, o, v in sorted(rows, key=lambda x: (x[0], x[1])):
        pos[k] = pos.get(k, 0) + 1
        assert rk[o] == pos[k]


def test_exclusive_max_and_lag(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k long, ord long, v long")
    ex = {r.ord: r.pm for r in prefix_scan(df, ["ord"], ["k"], maxes={"v": "pm"}, inclusive=False, parts=6,
                                           plain=False).collect()}
    lg = {r.ord: r.prev_v for r in lagged(df, "k", ["ord"], ["v"], plain=False).collect()}
    last, best = {}, {}
    for k, o, v in sorted(rows, key=lambda x: (x[0], x[1])):
        assert ex[o] == best.get(k)
        assert lg[o] == last.get(k)
        best[k] = v if k not in best else max(best[k], v)
        last[k] = v


def test_forced_two_level_equals_window(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k long, ord long, v long")
    a = sorted(tuple(r) for r in prefix_scan(df, ["ord"], ["k"], sums={"v": "s"}, maxes={"v": "m"},
                                             inclusive=False, plain=False).collect())
    b = sorted(tuple(r) for r in prefix_scan(df, ["ord"], ["k"], sums={"v": "s"}, maxes={"v": "m"},
                                             inclusive=False).collect())
    assert a == b
    c = sorted(tuple(r) for r in lagged(df, "k", ["ord"], ["v"], plain=False).collect())
    d = sorted(tuple(r) for r in lagged(df, "k", ["ord"], ["v"]).collect())
    assert c == d
