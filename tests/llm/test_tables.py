"""Chat formatting, sharding, nearest neighbours and the pipeline."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, chat, components, sharding

from .conftest import DOC_COLUMNS, clashing, prose


def test_chat_round_trip():
    r = random.Random(1)
    parts = ["\\", "###", "</turn>", "\n", "### user:\n", "a", "#", "\\###", "é"]
    for _ in range(300):
        messages = [(r.choice(["user", "assistant", "a:\\n#\nb", ""]), "".join(r.choice(parts) for _ in range(r.randint(0, 9))))
                    for _ in range(r.randint(0, 4))]
        text, mask = chat.render(messages)
        assert chat.parse(text) == messages
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for role, t in messages if role == "assistant"]


def test_events_fold(spark):
    log = [(1, 1, "start", 1, "user", "Hi"), (1, 2, "start", 2, "assistant", None), (1, 3, "delta", 2, None, "wro"),
           (1, 4, "regenerate", 2, None, None), (1, 5, "delta", 2, None, "rig"), (1, 6, "delta", 2, None, "ht"),
           (1, 7, "edit", 1, None, "Hello"), (1, 8, "start", 3, "user", "gone"), (1, 9, "delete", 3, None, None),
           (2, 1, "delta", 5, "assistant", "late"), (None, 1, "start", 1, None, None)]
    r = random.Random(2)
    r.shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, seq int, kind string, message long, role string, text string")
    got = {x.conv_id: x for x in chat.format_chats(clashing(df)).collect()}
    assert chat.parse(got[1].formatted) == [("user", "Hello"), ("assistant", "right")]
    assert chat.parse(got[2].formatted) == [("assistant", "late")] and chat.parse(got[None].formatted) == [("", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_turns_stream_in_deltas(spark):
    text = "".join(chr(97 + i % 26) for i in range(2 * chat.DELTA_CHARS + 5))
    turns = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", None), (1, 1, "user", None)],
                                  "conv_id long, turn long, role string, text string")
    assert chat.events_of_turns(turns).where("kind = 'delta'").count() == 5
    row = chat.chat_digests(chat.events_of_turns(turns)).first()
    assert row.n_turns == 3 and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"assistant\n{text}\nuser\n\nuser\n\n".encode()).hexdigest()


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (2, 1), (3, 4), (1, 3)])
def test_hilbert_curve(spark, n, bits):
    side = 1 << bits
    cells = spark.range(side ** n).select(*(F.expr(f"cast(id div {side ** i} % {side} AS int)").alias(f"x{i}") for i in range(n)))
    array = "array(" + ", ".join(f"x{i}" for i in range(n)) + ")"
    rows = sorted(cells.withColumn("at", sharding.hilbert_index(array, n, bits)).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in rows] == list(range(side ** n))
    if n > 1:
        assert all(sum(abs(p[i] - q[i]) for i in range(n)) == 1 for p, q in zip(rows, rows[1:]))


def test_shards(spark, odd_docs, no_docs, tmp_path):
    rows = [(i, f"text {i % 90}", ["en", "de", None][i % 3], f"s{i % 7}", i % 11) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC_COLUMNS).withColumn("size", sharding.text_size())
    got = sharding.assign_shards(docs, ["text"], shards=40).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(40)) and {len(x) for x in shards.values()} == {10}
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in shards.values())
    runs = [r.text for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(x != y for x, y in zip(runs, runs[1:])) == 89  # equal texts stand together
    odd = sharding.assign_shards(odd_docs.withColumn("size", sharding.text_size()), ["text"], shards=5).collect()
    assert len(odd) == odd_docs.count()
    sizes = [sum(r.shard == s for r in odd) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.assign_shards(no_docs.withColumn("size", F.lit(1)), ["text"]).count() == 0
    sharding.write_shards(odd_docs, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()


def test_strings_with_a_common_prefix_get_cells_of_their_own(spark):
    """Shards of rows by host: each holds few of the hosts, whatever they begin with."""
    r = random.Random(5)
    rows = [(i, f"https://www.example.org/{r.choice('abcdefghijklmnop')}/{i % 3}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, url string")
    cells = {x._h_value: x._h_cell for x in sharding._string_cells(docs, "url", 3).collect()}
    assert set(cells.values()) == set(range(8)) and sorted(cells, key=lambda v: (cells[v], v)) == sorted(cells)
    got = sharding.assign_shards(docs, ["doc_id"], dimensions=("url",), shards=16).collect()
    hosts = {}
    for x in got:
        hosts.setdefault(x.shard, set()).add(x.url)
    assert max(map(len, hosts.values())) < len(cells) / 4  # a shard is a run of two cells or three
    assert sharding._string_cells(docs.limit(0), "url", 3).count() == 0


def test_pipeline_stages_keep_any_columns(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (clashing(odd_docs), clashing(no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and all(r.n_removed == r._gone == r._id == 7 for r in rows)


def test_nearest_beside_a_huge_vector(spark):
    x = np.random.default_rng(11).standard_normal((3000, 16))
    x[7] *= 1e12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df.repartition(3), "vec_id % 100 = 0").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * 30


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 8)).round(2)
    x[50:90] = x[3]  # copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [math.nan] * 8), (1003, [1.0, None] * 4), (1004, [math.inf] * 8),
             (1005, [1.0] * 5), (None, [1.0] * 8), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for row in ann.nearest(clashing(df), "vec_id % 20 = 0").collect():
        got.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, answers in got.items():
        score = x @ x[q]
        want = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        assert sorted(answers) == list(range(1, 21))
        assert all(abs(score[i] - s) < 1e-9 for i, s in answers.values())
        hits += len(set(want) & {i for i, _ in answers.values()})
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    few = ann.nearest(df.where("vec_id < 4"), "vec_id = 0").collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]


def test_copies_in_ties(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100, [3.0, 6.0]), (101, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.nearest(df, "vec_id = 40").orderBy("rank").collect()]
    assert got == [100, *range(19)]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    """Planted cases against what each stage promises."""
    r = random.Random(9)
    clean = {i: ". ".join(prose(10_000 + i * 50 + j, 12) for j in range(12)) for i in range(200)}
    texts, labels = dict(clean), []
    for i in range(200, 260):
        w = prose(5000 + i, 100).split()
        for _ in range(4):
            w[r.randrange(100)] = r.choice(["zounds", "fiddle-dee", "blasted"])
        texts[i] = " ".join(w)
    for i in texts:
        labels.append((i, int(i >= 200)))
    passage = prose(99, 60)
    texts[300], texts[301] = clean[0], clean[1] + " tail"
    texts[302], texts[303] = prose(31, 80) + " " + passage + " " + prose(32, 70), prose(33, 70) + " " + passage + " " + prose(34, 90)
    texts[304] = prose(35, 20) + "\n" + "a line that comes again\n" + prose(36, 30)
    texts[305] = prose(37, 20) + "\n" + "a line that comes again\n" + prose(38, 30)
    texts[306], texts[307] = "", None
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DOC_COLUMNS).write.parquet(
        f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{sf}/out-{name}"
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in DOC_COLUMNS.split(", ")]
            kept[name] = {x.doc_id: x.text for x in docs.collect()}
    assert not [i for i in kept["toxicity"] if 200 <= i < 260] and set(clean) <= set(kept["toxicity"])
    assert "again" in kept["line_dedup"][304] and "again" not in kept["line_dedup"][305]
    assert 300 not in kept["jaccard_join"] and 301 not in kept["jaccard_join"] and {306, 307} <= set(kept["jaccard_join"])
    last = kept["substring_dedup"]
    assert passage in last[302] and passage not in last[303] and all(last[i] == clean[i] for i in clean)
    assert {x.doc_id for x in docs.collect()} == set(last)
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
