"""Shallot's search and the clustering against a full comparison in integers."""

import hashlib
import math

import numpy as np
import pytest

from tessera.llm import kmeans

from .conftest import clashing

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if i is not None and x is not None and len(x) == dims
            and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [x for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            members = [x for (_, x), c in zip(kept, own) if c == j]
            if members:
                centroids[j] = [sum(v) // len(members) for v in zip(*members)]
    found = [(i, *nearest(x)) for i, x in kept]
    sums = {j: sum(d for _, d, c in found if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, sums[c], sum(sums.values()), sha[c]) for i, d, c in found)


def got(df, **options):
    return sorted(tuple(r) for r in kmeans.cluster(df, **options).collect())


def test_clusters_match_brute_force(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(150, 64)) / 8, r.normal(size=(150, 64)) / 8 + 0.4, np.zeros((20, 64))])
    x[40:60] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert got(spark.createDataFrame(rows, VECTORS).repartition(3)) == brute(rows)


@pytest.mark.parametrize("seed,k,step", [(1, 5, 1), (2, 12, 1), (3, 3, 2)])
def test_ties_on_a_grid(spark, seed, k, step):
    """Few distinct values: many equal distances."""
    r = np.random.default_rng(seed)
    rows = [(i, v.tolist()) for i, v in enumerate(r.integers(-2, 3, size=(200, 3)) * float(step) / 1024)]
    df = spark.createDataFrame(rows, VECTORS).repartition(2)
    assert got(df, centroids=k, dims=3) == brute(rows, k=k, dims=3)


def test_search_finds_what_a_full_comparison_finds():
    r = np.random.default_rng(5)
    x = r.integers(-40, 40, size=(500, 4)).astype(float)
    at = kmeans.Centroids(r.integers(-40, 40, size=(30, 4)).tolist())
    whole, c = kmeans._integers(x, at)
    guess = r.integers(0, 30, size=(500, 2))
    guess[:, 1] = np.where(guess[:, 1] == guess[:, 0], (guess[:, 0] + 1) % 30, guess[:, 1])
    near, then, d1, d2, measured = kmeans.search(whole, c, guess[:, 0], guess[:, 1], at)
    for i in range(500):
        d = sorted((int(((whole[i] - c[j]) ** 2).sum()), j) for j in range(30))
        assert d[:2] == [(d1[i], near[i]), (d2[i], then[i])]
    near, then, _, _, again = kmeans.search(whole, c, near, then, at)
    assert again < measured < 500 * 32  # a good start makes a small ball
    # bounds hold after a move, and most vectors are not looked at
    moved = kmeans.Centroids((np.array(at.rows) + r.integers(-1, 2, size=(30, 4))).tolist(), at.rows)
    state = kmeans.advance(x, near, then, np.sqrt(d1) * (1 + 1e-9), np.sqrt(d2) * (1 - 1e-9), moved)
    full = ((whole[:, None, :] - np.array(moved.rows)[None]) ** 2).sum(axis=2)
    assert (state[2] == full.argmin(axis=1)).all()
    assert (state[4] >= np.sqrt(full.min(axis=1))).all()
    assert (state[5] <= np.sqrt(np.sort(full, axis=1)[:, 1]) + 1e-9).all()


def test_odd_vectors(spark):
    r = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(40, 64)))]
    rows += [(50, None), (51, [math.nan] * 64), (52, [1.0] * 63 + [None]), (53, [math.inf] + [0.0] * 63), (54, [1.0] * 5),
             (None, [1.0] * 64), (7, rows[7][1]), (7, rows[9][1]), (55, [0.0] * 64), (56, [-0.0005] * 64)]
    df = spark.createDataFrame(rows, VECTORS)
    assert got(clashing(df)) == brute(rows)
    assert got(df.where("vec_id < 3")) == brute(rows[:3])  # fewer vectors than centroids
    assert got(df.where("vec_id = 3")) == brute(rows[3:4])
    assert got(df.limit(0)) == [] and got(df, centroids=1) == brute(rows, k=1)


def test_one_far_vector(spark):
    """Squares beyond 64 bits are compared exactly; what no long holds is null."""
    r = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 64)))] + [(60, [1e12] * 64), (61, [1e30] * 64)]
    want = [(i, c, *(v if v < 1 << 63 else None for v in (d, s, t)), sha) for i, c, d, s, t, sha in brute(rows[:61])]
    assert got(spark.createDataFrame(rows[:61], VECTORS)) == want
    assert {x[0] for x in got(spark.createDataFrame(rows, VECTORS))} == set(range(61))
