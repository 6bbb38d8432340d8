"""Exact centroid clustering of integer vectors with Shallot's search.

Every vector remembers its nearest and its second-nearest centroid, an upper
bound of the distance to the first and a lower bound of the distance to all
others.  When the centroids have moved, the bounds move with them; a vector
whose upper bound stays under its lower bound, or under half the way from its
centroid to the next one, keeps its centroid unseen.  For the others the
remembered pair is measured first, the search starts from the closer one, and
walks that centroid's neighbours by distance for as long as they lie in the
ball whose radius is the distance to the start plus the distance to the
second-nearest found so far; each better second shrinks the ball.  The bounds
are floats with a margin that only widens them; what survives them is measured
and compared in integers, so the result is that of a full comparison.

A round is one pass over a stored table: vectors with their bounds go in, the
same vectors with new bounds come out, and beside them one row per task and
centroid with the exact sum of its vectors.  Nothing but those sums is
shuffled; the driver holds the centroids.  A round that moves no centroid ends
the search, as every later one would be the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stored
from .words import release, tidied

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: vectors worked on at once
PIECE = 1 << 13
#: share by which bounds are widened: far over the rounding of doubles, far under a step of the integers' distances
MARGIN = 1e-9
#: components from here on take no part; their sums would leave decimal(38)
HUGE = 2.0 ** 90
LONG = (1 << 63) - 1

_STATE = ("vec_id long, x array<double>, near int, next int, upper double, lower double, distance long, "
          "n long, sums array<decimal(38,0)>")


class Centroids:
    """Centroids as integers, their distances, and each one's neighbours by
    distance; ``moved`` bounds from above how far each came from ``before``."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows, self.many = rows, len(rows)
        between = [[math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q))) for q in rows] for p in rows]
        self.between = np.array(between).reshape(self.many, self.many)
        order = [sorted((j for j in range(self.many) if j != i), key=lambda j: (between[i][j], j)) for i in range(self.many)]
        self.order = np.array(order, np.int32).reshape(self.many, max(self.many - 1, 0))
        self.half = np.array([min((d for j, d in enumerate(r) if j != i), default=math.inf) / 2
                              for i, r in enumerate(between)]) * (1 - MARGIN)
        old = rows if before is None else before
        self.moved = np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q))) for p, q in zip(rows, old)]) * (1 + MARGIN)
        #: the largest move among all but each centroid
        self.others = np.array([max((m for j, m in enumerate(self.moved) if j != i), default=0.0) for i in range(self.many)])
        self.largest = max((abs(v) for r in rows for v in r), default=0)

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[i])).encode()).hexdigest()


def _integers(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as 64-bit integers, or as Python's where squares
    would overflow these."""
    most = max(float(np.abs(x).max(initial=0)), centroids.largest)
    if 4 * most * most * max(x.shape[1], 1) < LONG:
        return x.astype(np.int64), np.array(centroids.rows, np.int64)
    whole = np.empty(x.shape, object)
    whole[:] = [[int(v) for v in row] for row in x.tolist()]
    return whole, np.array(centroids.rows, object)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


def search(x: np.ndarray, c: np.ndarray, near: np.ndarray, then: np.ndarray, centroids: Centroids):
    """Nearest and second-nearest centroid of each row (ties: smaller number),
    their squared distances, and how many distances were measured."""
    d1, d2 = _squares(x, c[near]), _squares(x, c[then])
    measured = 2 * len(x)
    swap = (d2 < d1) | ((d2 == d1) & (then < near))
    near, then = np.where(swap, then, near), np.where(swap, near, then)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, known, reach = near.copy(), then.copy(), np.sqrt(d1.astype(np.float64))
    live = np.arange(len(x))
    for step in range(centroids.many - 1):
        one = centroids.order[start[live], step]
        ball = (reach[live] + np.sqrt(d2[live].astype(np.float64))) * (1 + MARGIN)
        inside = centroids.between[start[live], one] <= ball
        live, one = live[inside], one[inside]
        if not len(live):
            break
        fresh = one != known[live]
        at, one = live[fresh], one[fresh]
        d = _squares(x[at], c[one])
        measured += len(at)
        first = (d < d1[at]) | ((d == d1[at]) & (one < near[at]))
        second = ~first & ((d < d2[at]) | ((d == d2[at]) & (one < then[at])))
        up, new = at[first], one[first]
        then[up], d2[up] = near[up], d1[up]
        near[up], d1[up] = new, d[first]
        then[at[second]], d2[at[second]] = one[second], d[second]
    return near, then, d1, d2, measured


def advance(x: np.ndarray, near, then, upper, lower, centroids: Centroids):
    """New state of each vector after the centroids have moved, and the
    vectors as integers.  ``near`` of -1 marks a vector not yet assigned."""
    whole, c = _integers(x, centroids)
    if centroids.many == 1:
        zero = np.zeros(len(x), np.int32)
        return whole, c, zero, zero, np.zeros(len(x)), np.full(len(x), np.inf)
    new = near < 0
    near, then = np.where(new, 0, near), np.where(new, 1, then)
    upper = np.where(new, np.inf, (upper + centroids.moved[near]) * (1 + MARGIN))
    lower = np.where(new, 0.0, np.maximum(lower - centroids.others[near], 0.0) * (1 - MARGIN))
    open_ = np.flatnonzero(upper >= np.maximum(lower, centroids.half[near]))
    if len(open_):  # the remembered distance made exact closes most of what is left
        exact = np.sqrt(_squares(whole[open_], c[near[open_]]).astype(np.float64)) * (1 + MARGIN)
        upper[open_] = exact
        open_ = open_[exact >= np.maximum(lower[open_], centroids.half[near[open_]])]
    if len(open_):
        a, b, d1, d2, _ = search(whole[open_], c, near[open_], then[open_], centroids)
        near[open_], then[open_] = a, b
        upper[open_] = np.sqrt(d1.astype(np.float64)) * (1 + MARGIN)
        lower[open_] = np.sqrt(d2.astype(np.float64)) * (1 - MARGIN)
    return whole, c, near, then, upper, lower


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _batch(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(),
             pa.int64(), pa.list_(pa.decimal128(38, 0))]
    rows = len(columns[0])
    arrays = [pa.nulls(rows, k) if c is None else c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k)
              for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _STATE.split(", ")])


def _round(centroids: Centroids, last: bool):
    """Vectors with their new bounds, then the sums of this task; in the last
    round the vectors' distances instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums, counts = {}, np.zeros(centroids.many, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                column = dict(zip(piece.schema.names, piece.columns))
                x = _matrix(column["x"])
                state = [column[n].to_numpy(zero_copy_only=False) for n in ("near", "next", "upper", "lower")]
                whole, c, near, then, upper, lower = advance(x, *state, centroids)
                if last:
                    d = [v if v <= LONG else None for v in _squares(whole, c[near]).tolist()]
                    yield _batch([column["vec_id"], None, near, None, None, None, d, None, None])
                    continue
                order = np.argsort(near, kind="stable")
                at_c, first = np.unique(near[order], return_index=True)
                for i, s in zip(at_c.tolist(), np.add.reduceat(whole[order], first, axis=0)):
                    sums[i] = sums.get(i, 0) + s.astype(object)
                counts += np.bincount(near, minlength=centroids.many)
                yield _batch([column["vec_id"], column["x"], near, then, upper, lower, None, None, None])
        if sums:
            at_c = sorted(sums)
            yield _batch([[None] * len(at_c), None, at_c, None, None, None, None, counts[at_c],
                          [[Decimal(int(v)) for v in sums[i]] for i in at_c]])
    return tidied(run)


def _started(scale: int):
    """Scaled vectors, not assigned yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = np.floor(_matrix(batch.column(1)) * scale)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))
                none = np.full(n, -1, np.int32)
                yield _batch([batch.column(0), lists, none, none, np.zeros(n), np.zeros(n), None, None, None])
    return run


def _moved(state: DataFrame, centroids: Centroids) -> Centroids:
    """Every centroid that has vectors goes to the floor of their mean."""
    sums = state.where("n IS NOT NULL").select("near", "n", F.posexplode("sums").alias("dim", "v"))
    rows = [list(r) for r in centroids.rows]
    for r in sums.groupBy("near", "dim").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
        rows[r["near"]][r["dim"]] = int(r["v"]) // r["n"]
    return Centroids(rows, centroids.rows)


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256:
    one row per vector of ``dims`` components.

    A component counts as floor(``scale`` x component).  The first centroids
    are the ``centroids`` vectors with the smallest SHA-256 of
    ``<seed>:<vec_id>`` (all, if fewer; rows that repeat an id are taken by
    their components); each of ``rounds`` rounds assigns every vector to the
    nearest one (squared Euclidean distance, ties to the smaller number) and
    moves every centroid that has vectors to the floor of their mean; then
    vectors are assigned once more.  distance is squared; inertia sums it.

    Rows without an id, and vectors that are null, of another length, or hold
    null, non-finite or huge (2**80 and more) components take no part.  Rows
    that repeat an id or a vector each count.  A distance or sum beyond a long
    is null.  An empty table gives an empty result.  Further columns are
    ignored.
    """
    spark = vectors.sparkSession
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        f"vec_id IS NOT NULL AND size(x) = {dims} AND forall(x, e -> e IS NOT NULL AND abs(e) < {HUGE / scale!r}D)")
    state = stored(fine.mapInArrow(_started(scale), _STATE), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.select(key.alias("key"), "x").orderBy("key", "x").limit(centroids).collect()
    at = Centroids([[int(v) for v in r["x"]] for r in first])
    if not first:
        return state.select("vec_id", F.col("near").alias("cluster"), "distance", F.col("n").alias("cluster_inertia"),
                            F.col("n").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        after = stored(state.where("n IS NULL").mapInArrow(_round(at, False), _STATE), "vectors")
        drop(state)
        state, at = after, _moved(after, at)
        if not at.moved.any():
            break
    found = stored(state.where("n IS NULL").mapInArrow(_round(at, True), _STATE).select(
        "vec_id", F.col("near").alias("cluster"), "distance"), "clusters")
    drop(state)
    sums = {r["cluster"]: (r["s"], r["gaps"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
        F.count(F.when(F.col("distance").isNull(), 1)).alias("gaps")).collect()}

    def total(parts) -> int | None:
        parts = list(parts)
        whole = sum(int(s) for s, gaps in parts if not gaps)
        return whole if not any(gaps for _, gaps in parts) and whole <= LONG else None
    table = spark.createDataFrame([(i, total([s]), total(sums.values()), at.digest(i)) for i, s in sorted(sums.items())],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid, which the driver has made itself
    return found.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
