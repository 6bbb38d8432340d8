"""SimHash fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm import words as W

from .conftest import clashing, lower, prose, words


def brute_fingerprint(text, k=3):
    w = words(lower(text))
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), len(h)


def brute_components(values, bits=2):
    """Smallest id reachable, for a list of (id, fingerprint)."""
    root = {i: i for i, _ in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, f in values:
        for j, g in values:
            if i < j and (f ^ g).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in values}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_fingerprints_match_brute_force(monkeypatch):
    texts = ["", None, " \t\n", "One", "one  TWO", "a\x0bb c", "ÄÖ x y Z z", prose(1, 500), "é" * 40 + " b c d", "x " * 700]
    monkeypatch.setattr(simhash, "STEP", 64)
    import pyarrow as pa
    value, n = simhash.fingerprints_of(W.Words(*W.flat(pa.array(texts))))
    assert list(zip(value.tolist(), n.tolist())) == [brute_fingerprint(t) for t in texts]


def test_hash_is_sparks(spark):
    row = spark.createDataFrame([("some words here",)], "text string").select(F.xxhash64("text").alias("h")).first()
    assert row.h == signed(xxhash.xxh64_intdigest(b"some words here", 42))


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_links_of_crowded_blocks(spark, monkeypatch, bits):
    """Short and crowded blocks together give the components of all pairs."""
    monkeypatch.setattr(simhash, "SHORT", 6)
    r = random.Random(bits)
    values = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(r.choice([3, 40])):
            f = centre
            for b in r.sample(range(64), r.randint(0, 5)):
                f ^= 1 << b
            values.add(f)
    values |= {0, 1 << 63, (1 << 64) - 1}
    rows = list(enumerate(sorted(values)))
    df = spark.createDataFrame([(signed(f),) for _, f in rows], "f long")
    links = [(x.a, x.b) for x in simhash.close_pairs(df, bits).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits for a, b in links)
    number = {signed(f): i for i, f in rows}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        x, y = sorted((find(number[a]), find(number[b])))
        root[y] = x
    assert {i: find(i) for i, _ in rows} == brute_components(rows, bits)
    with pytest.raises(ValueError):
        simhash.close_pairs(df, 3)


def test_crowd_stays_linear(spark):
    """A template's pages: links grow with the pages, not with their square."""
    r = random.Random(3)
    centre = r.getrandbits(64)
    values = {centre}
    while len(values) < 900:
        f = centre
        for b in r.sample(range(64), r.randint(1, 3)):
            f ^= 1 << b
        values.add(f)
    df = spark.createDataFrame([(signed(f),) for f in values], "f long")
    assert simhash.close_pairs(df).count() < 70 * len(values)


def test_groups_match_brute_force(spark):
    r = random.Random(8)
    rows, n = [], 0
    for g in range(25):
        base = prose(g, r.choice([1, 2, 3, 30, 300])).split()
        for _ in range(r.randint(1, 6)):
            w = list(base)
            if r.random() < 0.6:
                w[r.randrange(len(w))] = "changed"
            n += 1
            rows.append((n * 7 % 1009, "  ".join(w)))
    got = {x.doc_id: (x.fingerprint, x.component_id, x.n_shingles) for x in simhash.simhash_groups(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    comps = brute_components([(i, f) for i, (f, _) in prints.items()])
    assert got == {i: (f"{f:016x}", comps[i], n) for i, (f, n) in prints.items()}


def test_groups_edge_cases(odd_docs, no_docs):
    rows = simhash.simhash_groups(clashing(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[4].fingerprint == by[5].fingerprint == by[6].fingerprint == "0" * 16
    assert by[4].component_id == by[5].component_id == by[6].component_id == 4
    assert by[1].component_id == by[2].component_id == 1 and by[8].component_id == 8
    assert by[None].component_id is None and by[None].n_shingles == 98
    assert simhash.simhash_groups(no_docs).count() == 0
