"""Approximate nearest neighbours by inner product: NN-descent and greedy
graph search.

The neighbour graph starts from blocks of vectors that lie on the same sides
of random hyperplanes.  NN-descent then improves it: every vector is a hub at
which its neighbours and those that have it as neighbour meet, and are tried
as neighbours of each other (neighbours of neighbours, by Spark joins).  A
query walks the graph: it opens its best unopened vertices, scores their
neighbours, and goes on until its best candidates are all opened.  The best found are
scored again on the original vectors in double precision.

Equal vectors are one vertex.  Vectors travel as half floats of their own
largest component, which stands before them in double precision; so a huge
vector takes nothing from the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, stored
from .words import PIECE_BYTES, tidied

TOP = 20
#: neighbours kept of each vertex; those that meet at hubs in a round
DEGREE, MEETING = 32, 24
#: aim for the size of a block, number of block tables, most members of one meeting
BLOCK, TABLES, GROUP = 1024, 4, 64
#: rounds of NN-descent at most; fewer when less than this share of the lists changes
ROUNDS, STILL = 8, 0.02
#: vertices a query opens in a step; it is done when its best WIDTH are all opened, or after STEPS
OPEN, WIDTH, STEPS = 40, 240, 16
BROADCAST_ROWS = 100_000


def _runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Rows sorted by the first column, in tables that hold whole keys (or
    ``most`` rows of one key)."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 4096:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key == key[-1], True)) if rows < most else rows
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows -= cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a binary column (of ``width`` bytes each, or one a row) as
    floats, and their scales."""
    flat = np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint8)
    flat = flat.reshape(-1, width) if width else flat.reshape(len(column), -1)
    return (np.ascontiguousarray(flat[:, 8:]).view(np.float16).astype(np.float32),
            np.ascontiguousarray(flat[:, :8]).view(np.float64)[:, 0])


def _flat(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy()


def _lists(sizes: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> list[pa.Array]:
    at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(ids, pa.int64())),
            pa.ListArray.from_arrays(at, pa.array(scores, pa.float64()))]


_FOUND = "id long, nbr array<long>, score array<double>, old boolean"


def _meet(keep: int, group: int):
    """Score the members of each group (rows: group, id, v, least) against
    each other; each gets its best ``keep`` above its least score.  Scores are
    compared for one vertex only, so its own scale is left out."""
    def pairs(ids, vectors, scales, least, first, size):
        m = int(size.max())
        at = first[:, None] + np.arange(m)
        there = np.arange(m) < size[:, None]
        at = np.where(there, at, first[:, None])
        v, own = vectors[at], ids[at]
        score = (v @ v.transpose(0, 2, 1)) * scales[at][:, None, :]
        score[~np.broadcast_to(there[:, None, :], score.shape) | (own[:, :, None] == own[:, None, :])] = -np.inf
        k = min(keep, m)
        best = np.argpartition(-score, k - 1, axis=2)[:, :, :k]
        value = np.take_along_axis(score, best, 2)
        good = (value > least[at][:, :, None]) & there[:, :, None]
        names = np.take_along_axis(np.broadcast_to(own[:, None, :], score.shape), best, 2)
        return own[there], good.sum(2)[there], names[good], value[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            key, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
            (vectors, scales), least = _matrix(table.column(2)), table.column(3).to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(heads, len(key)))
            # larger groups meet in parts
            parts = -(-size // group)
            first = np.concatenate([h + group * np.arange(p) for h, p in zip(heads.tolist(), parts.tolist())])
            size = np.minimum(np.repeat(heads + size, parts) - first, group)
            order = np.argsort(size, kind="stable")
            first, size = first[order], size[order]
            step = max(1, PIECE_BYTES // (group * group))
            for i in range(0, len(first), step):
                own, sizes, names, values = pairs(ids, vectors, scales, least, first[i:i + step],
                                                   size[i:i + step])
                some = sizes > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[some]), *_lists(sizes[some], names, values), pa.array(np.zeros(some.sum(), bool))],
                    names=["id", "nbr", "score", "old"])
    return tidied(run)


_GRAPH = "id long, nbr array<long>, score array<double>, least double, fresh long"


def _merge(degree: int):
    """The best distinct neighbours of each vertex, best first; how many are
    new."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1 << 30):
            own, sizes = table.column(0).to_numpy(), table.column(1).combine_chunks().value_lengths().to_numpy()
            node, old = np.repeat(own, sizes), np.repeat(table.column(3).to_numpy(), sizes)
            nbr, score = _flat(table.column(1)), _flat(table.column(2))
            order = np.lexsort((~old, nbr, node))
            node, nbr, score, old = node[order], nbr[order], score[order], old[order]
            keep = np.ones(len(node), bool)
            keep[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
            node, nbr, score, old = node[keep], nbr[keep], score[keep], old[keep]
            order = np.lexsort((nbr, -score, node))
            node, nbr, score, old = node[order], nbr[order], score[order], old[order]
            heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else node
            rank = np.arange(len(node)) - np.repeat(heads, np.diff(np.append(heads, len(node))))
            keep = rank < degree
            node, nbr, score, old = node[keep], nbr[keep], score[keep], old[keep]
            names, first, sizes = np.unique(node, return_index=True, return_counts=True)
            least = np.where(sizes < degree, -np.inf, score[first + sizes - 1] if len(node) else 0)
            fresh = np.add.reduceat(~old, first) if len(node) else first
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), *_lists(sizes, nbr, score), pa.array(least.astype(np.float64)),
                 pa.array(fresh.astype(np.int64))], names=["id", "nbr", "score", "least", "fresh"])
    return tidied(run)


def _merged(found: DataFrame, degree: int) -> DataFrame:
    return stored(found.repartition("id").sortWithinPartitions("id").mapInArrow(_merge(degree), _GRAPH), "graph")


def _blocks(tables: int, bits: int, seed: int = 7):
    """Each vector's block in each table, by the sides of random hyperplanes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, _ = _matrix(batch.column(1))
            planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((v.shape[1], tables * bits))
            sides = (v @ planes.astype(np.float32) > 0).reshape(len(v), tables, bits)
            block = (sides * (1 << np.arange(bits))).sum(2) * tables + np.arange(tables)
            n = len(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), tables)),
                 batch.column(1).take(pa.array(np.repeat(np.arange(n), tables))),
                 pa.array(np.full(n * tables, -np.inf))], names=["block", "id", "v", "least"])
    return tidied(run)


def nn_descent(vertices: DataFrame, degree: int = DEGREE) -> DataFrame:
    """id, nbr, score (best first), least, fresh: the neighbour graph of
    vertices (id, v: scale and half floats)."""
    n = vertices.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK))))
    blocks = vertices.mapInArrow(_blocks(TABLES if bits else 1, bits), "block long, id long, v binary, least double")
    # equal blocks of one size: a crowded one is dealt into parts
    crowd = blocks.groupBy("block").agg(F.count("*").alias("n")).where(f"n > {2 * BLOCK}")
    blocks = blocks.join(crowd, "block", "left").select(
        F.xxhash64("block", F.expr(f"pmod(xxhash64(id), coalesce(ceil(n / {2 * BLOCK}), 1))")).alias("g"),
        "id", "v", "least")
    found = blocks.repartition("g").sortWithinPartitions("g", "id").mapInArrow(_meet(degree, 2 * BLOCK), _FOUND)
    graph = _merged(found, degree)
    for _ in range(ROUNDS):
        ends = graph.select("id", F.explode(F.slice("nbr", 1, MEETING)).alias("other"))
        ends = ends.select(F.col("id").alias("hub"), F.col("other").alias("id")).union(
            ends.select(F.col("other").alias("hub"), "id")).distinct()
        busy = ends.groupBy("hub").agg(F.count("*").alias("n")).where(f"n > {4 * GROUP}")
        rows = (ends.join(busy, "hub", "left")
                .select(F.xxhash64("hub", F.expr(f"pmod(xxhash64(id), coalesce(ceil(n / {2 * GROUP}), 1))")).alias("g"),
                        "id")
                .join(vertices, "id").join(graph.select("id", "least"), "id").select("g", "id", "v", "least"))
        found = rows.repartition("g").sortWithinPartitions("g", "id").mapInArrow(_meet(MEETING, GROUP), _FOUND)
        better = _merged(found.union(graph.select("id", "nbr", "score", F.lit(True).alias("old"))), degree)
        fresh = better.agg(F.sum("fresh")).first()[0] or 0
        drop(graph)
        graph = better
        if fresh < STILL * n * degree:
            break
    return graph


_BEAM = "q long, qv binary, nbr array<long>, score array<double>, opened array<boolean>, moved boolean"


@tidied
def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of an opened vertex' neighbours for its query (rows: q, qv,
    neighbour ids, their vectors)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        q, _ = _matrix(batch.column(1))
        sizes = batch.column(2).value_lengths().to_numpy()
        v, scales = _matrix(batch.column(3), 8 + 2 * q.shape[1])
        score = np.einsum("ij,ij->i", v, np.repeat(q, sizes, axis=0)) * scales
        yield pa.RecordBatch.from_arrays([batch.column(0), *_lists(sizes, _flat(batch.column(2)), score)],
                                         names=["q", "nbr", "score"])


def _advance(beam: int):
    """Merge a query's new candidates into its beam (rows sorted by q; the
    one with qv is the beam)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1 << 30):
            q = table.column(0).to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            rows = []
            nbr, score, opened = (table.column(i) for i in (2, 3, 4))
            vectors = table.column(1)
            for h, t in zip(heads.tolist(), [*heads[1:].tolist(), len(q)]):
                state = next(i for i in range(h, t) if vectors[i].is_valid)
                ids = np.concatenate([np.array([q[h]]), *(nbr[i].values.to_numpy() for i in range(h, t))])
                value = np.concatenate([np.array([-np.inf]),
                                        *(score[i].values.to_numpy() for i in range(h, t))])
                done = np.concatenate([np.array([True]), *(
                    np.array(opened[i].as_py(), bool) if i == state else np.zeros(len(nbr[i]), bool)
                    for i in range(h, t))])
                order = np.lexsort((~done, ids))
                ids, value, done = ids[order], value[order], done[order]
                first = np.concatenate(([True], ids[1:] != ids[:-1])) & (ids != q[h])
                ids, value, done = ids[first], value[first], done[first]
                best = np.lexsort((ids, -value))[:beam]
                ids, value, done = ids[best], value[best], done[best]
                rows.append((q[h], vectors[state].as_py(), ids, value, done, not done.all()))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()),
                     pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=[c.split()[0] for c in _BEAM.split(", ")])
    return tidied(run)


def greedy_search(graph: DataFrame, vertices: DataFrame, queries: DataFrame) -> DataFrame:
    """q, nbr, score (best first) of query vertices (id), from their own
    lists onward."""
    edges = graph.select("id", F.posexplode("nbr").alias("at", "other"))
    wide = edges.join(vertices.withColumnRenamed("id", "other"), "other").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("at", "other", "v"))).alias("n"))
    wide = stored(wide.select("id", F.col("n.other").alias("nbr"), F.expr(
        "concat_ws('', transform(n.v, x -> hex(x)))").alias("hexed")).select(
        "id", "nbr", F.unhex("hexed").alias("vs")), "wide")
    state = stored(queries.join(vertices, "id").join(graph.select("id", "nbr", "score"), "id", "left").select(
        F.col("id").alias("q"), F.col("v").alias("qv"), F.coalesce("nbr", F.array().cast("array<long>")).alias("nbr"),
        F.coalesce("score", F.array().cast("array<double>")).alias("score")).withColumn(
        "opened", F.transform("nbr", lambda x: F.lit(False))).withColumn("moved", F.lit(True)), "beam")
    for _ in range(STEPS):
        live = state.where("moved")
        front = live.select("q", "qv", F.explode(F.slice(F.filter(F.arrays_zip("nbr", "opened"), lambda x: ~x["opened"]),
                                                         1, OPEN)["nbr"]).alias("id"))
        n = front.count()
        if not n:
            break
        hits = (wide.join(F.broadcast(front) if n <= BROADCAST_ROWS else front, "id")
                .select("q", "qv", "nbr", "vs").mapInArrow(_expand, "q long, nbr array<long>, score array<double>"))
        # what was just opened is marked in the beam
        closed = F.expr(f"slice(filter(nbr, (x, i) -> NOT opened[i]), 1, {OPEN})")
        marked = live.withColumn("now", closed).withColumn(
            "opened", F.expr("transform(nbr, (x, i) -> opened[i] OR array_contains(now, x))")).drop("now")
        none = F.lit(None)
        rows = marked.select("q", "qv", "nbr", "score", "opened").union(hits.select(
            "q", none.cast("binary"), "nbr", "score", none.cast("array<boolean>")))
        after = stored(rows.repartition("q").sortWithinPartitions("q").mapInArrow(_advance(WIDTH), _BEAM).union(
            state.where("NOT moved")), "beam")
        drop(state)
        state = after
    drop(wide)
    return state.select("q", "nbr", "score")


def nearest(vectors: DataFrame, query: str, top: int = TOP, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets the condition
    ``query``, the ``top`` other rows found with the largest inner products
    (in double precision, ties to smaller ids; all, if fewer).

    Rows without an id, and vectors that are null, zero, of another length
    than most, or hold null or non-finite components, take no part.  Of rows
    that repeat an id with the same vector one counts; with other vectors,
    each is a row of its own.  Copies of a vector are found by smallest ids.  Further
    columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"),
                          F.coalesce(F.expr(query), F.lit(False)).alias("asks"))
    fine = rows.where("vec_id IS NOT NULL AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('inf'))"
                      " AND exists(x, e -> e != 0)")
    length = fine.agg(F.mode(F.size("x"), True)).scalar()
    fine = fine.where(F.size("x") == length).dropDuplicates(["vec_id", "x"])
    by = Window.partitionBy("x").orderBy("vec_id")
    # of equal vectors the smallest top + 1 ids can be answers
    copies = stored(fine.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= top + 1).drop("asks"), "copies")
    heads = copies.where("rn = 1").select(F.col("vec_id").alias("id"), "x")
    # vertices are numbered by their smallest id; rows that share it get their own number
    heads = heads.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("x"))).select(
        F.when(F.col("k") == 1, F.col("id")).otherwise(-F.abs(F.xxhash64("id", "x"))).alias("id"), "x")
    heads = stored(heads, "heads")
    largest = heads.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 1.0
    # half floats end at 65504 and lose digits below 1e-4: components are brought to at most 1, row by row
    vertices = stored(heads.mapInArrow(_halves(largest), "id long, v binary"), "vertices")
    asked = stored(fine.where("asks").select("vec_id", "x").join(heads, "x").select(
        F.col("vec_id").alias("query_id"), "id", "x"), "asked")
    graph = nn_descent(vertices)
    found = greedy_search(graph, vertices, asked.select("id").distinct())
    # twice as many as needed are scored again exactly, and the query's own copies
    near = found.select(F.col("q").alias("id"), F.explode(F.slice("nbr", 1, 2 * top)).alias("other")).union(
        found.select(F.col("q").alias("id"), F.col("q").alias("other")))
    near = near.join(heads.select(F.col("id").alias("other"), F.col("x").alias("y")), "other").join(
        heads, "id").select("id", "other", "y", F.expr(
            "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, e) -> s + e)").alias("score"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    near = near.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= top + 1).select("id", "y", "score")
    answers = asked.select("query_id", "id").join(near, "id").join(
        copies.select(F.col("x").alias("y"), "vec_id"), "y").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)


def _halves(largest: float):
    """Each vector's largest component, as a share of the table's, and the
    vector in half floats of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _flat(batch.column(1)).reshape(batch.num_rows, -1)
                own = np.abs(x).max(axis=1)
                raw = (x / own[:, None]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                    [o.tobytes() + r.tobytes() for o, r in zip(own / largest, raw)], pa.binary())], names=["id", "v"])
    return tidied(run)
