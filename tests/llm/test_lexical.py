"""Block-Max MaxScore against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from tessera.llm import lexical

from .conftest import clashing, lower, prose


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items, top=10):
    texts = [(i, terms(t)) for i, t in docs if i is not None]
    texts = [(i, t) for i, t in texts if t]
    n_docs, n_terms = len(texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        if item is None:
            continue
        found = []
        for i, t in texts:
            m = 25 + 75 * len(t) * n_docs // n_terms
            score = 0
            for x in terms(text):
                tf = t.count(x)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, n, vocabulary):
    """Zipf-like texts of many lengths."""
    r = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, r.choice([" ", ", ", "\n"]).join(r.choices(names, weights, k=r.choice([1, 5, 30, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize("shard,block,window", [(1 << 20, 128, 512), (300, 4, 8)])
def test_search_matches_scoring_all(spark, monkeypatch, shard, block, window):
    docs = corpus(1, 400, 300) + [(1000, "W1 w1, É-é w299"), (1001, None), (1002, "..."), (None, "w1 w2")]
    r = random.Random(2)
    items = [(i, " ".join(r.choices([f"w{j}" for j in range(310)], k=r.choice([1, 3, 20])))) for i in range(30)]
    items += [(90, "w0 w0 w1"), (91, ""), (92, None), (93, "nowhere"), (None, "w1"), (90, "w0 w0 w1"), (94, "é É")]
    monkeypatch.setattr(lexical, "SHARD_TERMS", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "QUERIES", 8)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in lexical.ranked_documents(clashing(d), clashing(q)).collect())
    assert got == brute(docs, items)


def shard_lists(docs, block):
    """Lists of one shard, straight from the encoder."""
    import pyarrow as pa
    words = lexical._terms(pa.array([t for _, t in docs]))
    hashes, n = words.hashes(), words.counts.astype(np.int64)
    term, df, heads, peaks, body = lexical.encode_shard(hashes, words.doc, n)
    norms = lexical.Norms(n, int((n > 0).sum()), int(n.sum()))
    out = {}
    for i, t in enumerate(term.tolist()):
        w = math.floor(1000 * math.log((2 * norms.n_docs + 2) / (2 * int(df[i]) + 1)))
        out[t] = lexical.PostingList(heads[i].as_py(), peaks[i].as_py(), body[i].as_py(), w, norms)
    return words, hashes, out


def test_lists_come_back_as_written(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 7)
    docs = corpus(3, 200, 50) + [(200, "w0 " * 70_000)] + [(i, "w49") for i in range(201, 700)] + [(700, "w7 w0")]
    words, hashes, lists = shard_lists(docs, 7)
    want = {}
    for h, d in zip(hashes.tolist(), words.doc.tolist()):
        want.setdefault(h, {}).setdefault(d, 0)
        want[h][d] += 1
    assert set(want) == set(lists)
    for h, x in lists.items():
        held = [x.block(i) for i in range(len(x.last))]
        assert np.concatenate([d for d, _ in held]).tolist() == sorted(want[h])
        gives = [x.weight * int(lexical.impact(want[h][d], int(x.norms.of_doc[d]))) for d in sorted(want[h])]
        assert np.concatenate([g for _, g in held]).tolist() == gives
        assert [int(g.max()) for _, g in held] == x.block_best.tolist()  # block maxima are exact


def test_blocks_are_skipped(monkeypatch):
    """A rare term and a frequent one: few of the frequent term's blocks are opened."""
    monkeypatch.setattr(lexical, "BLOCK", 16)
    r = random.Random(4)
    docs = [(i, " ".join((["often"] if i % 3 else []) + (["rare"] if i % 97 == 0 else []) + prose(i, r.randint(3, 60)).split())) for i in range(4000)]
    _, _, lists = shard_lists(docs, 16)
    import pyarrow as pa
    rare, often = (lists[int(h)] for h in lexical._terms(pa.array(["rare often"])).hashes().tolist())
    ids = np.arange(4000)
    found, scores, opened = lexical.best_of_shard([(rare, 1), (often, 1)], ids)
    total = np.zeros(4000, np.int64)
    for x in (rare, often):
        for i in range(len(x.last)):
            d, g = x.block(i)
            total[d] += g
    order = np.lexsort((ids, -total))[:10]
    assert found.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert 0 < opened < len(often.last) / 4


def test_edge_cases(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the very same line of text"), (2, "two words")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(tuple(x) for x in lexical.ranked_documents(odd_docs, items).collect())
    assert got == brute(docs, [(1, "the very same line of text"), (2, "two words")])
    assert lexical.ranked_documents(no_docs, items).count() == 0
    assert lexical.ranked_documents(odd_docs, items.limit(0)).count() == 0
    many = spark.createDataFrame([(i, "same text") for i in range(30, 0, -1)] + [(99, "other")], "doc_id long, text string")
    ties = lexical.ranked_documents(many, spark.createDataFrame([(5, "same")], "item_id long, text string")).collect()
    assert [r.doc_id for r in sorted(ties, key=lambda r: r["rank"])] == list(range(1, 11))
