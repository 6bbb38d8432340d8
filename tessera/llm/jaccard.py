"""N-gram Jaccard join: groups of documents whose word-shingle sets overlap.

T-occurrence search with DivideSkip.  A document with n shingles can only be
linked to documents that hold at least T = ceil(0.8 n) of them.  Its inverted
lists are divided: the T - 1 longest are set aside, the n - T + 1 shortest
are merged (a Spark aggregation by shingle), because a partner must occur in
at least one short list.  The candidates are then checked by binary probes of
their whole sorted shingle sets, which is where the long lists are visited.

List lengths come from a count sketch of fixed size over all documents
(broadcast; 16 MB whatever the corpus).  It only orders the lists: any order
gives the same links, a good one gives short lists.

Documents with equal sets form one class before anything is joined.  Lists
are never turned into all pairs: members of a list are first paired with one
pivot (the member that shares most with others, then others); a list whose members are already one component is finished; only
members still in different components are paired further.  So every pair of
linked classes ends in one component, and a hot group costs rows in
proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import drop, id_and_text, stored, unused

SKETCH_BITS = 24
#: buckets in a row of the sketch
SLICE = 1 << 16
PIVOT_ROUNDS = 2
#: members up to which a list is handled as one row; longer lists are joined
SHORT = 64
#: a table of two longs with at most this many rows (16 MB) is broadcast, a larger one is shuffled
BROADCAST_ROWS = 1_000_000
#: buckets of the counts that bound an intersection from above
MARKS = 512


def _sketch(k: int):
    """Shingle counts of a task in 2**SKETCH_BITS buckets, slice by slice
    (255: at least so many)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release()
        counts = np.zeros(1 << SKETCH_BITS, np.uint8)
        for batch in batches:
            for piece in W.pieces(batch):
                _, values = W.shingle_sets(W.Words(*W.flat(piece.column(0))), k)
                at, n = np.unique((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 255)
        for i, part in enumerate(counts.reshape(-1, SLICE)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()])],
                                                 names=["slice", "counts"])
    return W.tidied(run)


@W.tidied
def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the slices of all tasks; eight levels for each doubling."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[i] = total.get(i, 0) + np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)
    for i, counts in total.items():
        level = np.minimum(8 * np.log2(counts + 1), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()])],
                                         names=["slice", "level"])


def list_levels(texts: DataFrame, k: int) -> bytes:
    """A level of list length, one byte for each of 2**SKETCH_BITS buckets of
    shingles; no list is longer than its bucket's count."""
    rows = (texts.mapInArrow(_sketch(k), "slice int, counts binary").repartition("slice")
            .mapInArrow(_levels, "slice int, level binary").collect())
    levels = np.zeros(((1 << SKETCH_BITS) // SLICE, SLICE), np.uint8)
    for r in rows:
        levels[r["slice"]] = np.frombuffer(r["level"], np.uint8)
    return levels.tobytes()


def _class_keys(n_docs: int, doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, offsets, and a 64-bit hash of each document's whole set."""
    n = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(values), dtype=np.uint64)))
    return n, first, W.mix((total[first[1:]] - total[first[:-1]]) ^ n.astype(np.uint64))


def _short_lists(k: int, percent: int, levels):
    """doc_id, n, class hash and, once per class and task, the shingles of
    its short lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release()
        level = np.frombuffer(levels.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for piece in W.pieces(batch):
                words = W.Words(*W.flat(piece.column(1)))
                doc, values = W.shingle_sets(words, k)
                n, first, keys = _class_keys(words.n_docs, doc, values)
                order = np.lexsort((values, level[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], doc))
                by_length = values[order].view(np.int64)
                short = n - (percent * n + 99) // 100 + 1
                lists = []
                for i, key in enumerate(keys.tolist()):
                    if n[i] == 0 or key in seen:
                        lists.append(None)
                    else:
                        seen.add(key)
                        lists.append(by_length[first[i]:first[i] + short[i]])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(n), pa.array(keys.view(np.int64)), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "f", "short"])
    return W.tidied(run)


def _sets(k: int):
    """Class, its sorted shingle set, and how many shingles fall in each of
    MARKS hash ranges (255: at least so many)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch):
                words = W.Words(*W.flat(piece.column(1)))
                doc, values = W.shingle_sets(words, k)
                _, at, keys = _class_keys(words.n_docs, doc, values)
                wanted = piece.column(0).to_numpy()
                # another text under a repeated id has another class
                right = np.flatnonzero(keys.view(np.int64) == wanted)
                sets, marks = [], []
                for i in right.tolist():
                    own = values[at[i]:at[i + 1]]
                    sets.append(own.tobytes())
                    inside = np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=MARKS)
                    marks.append(np.minimum(inside, 255).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted[right]), pa.array(sets, pa.binary()), pa.array(marks, pa.binary())],
                    names=["f", "members", "marks"])
    return W.tidied(run)


def _bound(percent: int):
    """Whether the counts by hash range leave room for a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8).astype(np.int64) for v in (x, y))
                most = int(np.minimum(x, y).sum())
                keep.append(bool((x == 255).any() or (y == 255).any()
                                 or 100 * most >= percent * (int(x.sum() + y.sum()) - most)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())],
                                             names=["f", "p", "ok"])
    return W.tidied(run)


def _probe(percent: int):
    """Binary probes of each pair's smaller set in the larger one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())],
                                             names=["f", "p", "ok"])
    return W.tidied(run)


def _small(table: DataFrame) -> DataFrame:
    """A stored table of two longs, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _beside(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    """(f, p, x, y): ``what`` of both classes of each pair."""
    small = _small(pairs)
    x = sets.select("f", F.col(what).alias("x")).join(small, "f")
    y = sets.select(F.col("f").alias("p"), F.col(what).alias("y")).join(small, "p")
    return x.join(y, ["f", "p"]).select("f", "p", "x", "y")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones among candidate pairs of classes."""
    wanted = stored(pairs.select("f").union(pairs.select(F.col("p").alias("f"))).distinct()
                    .join(classes.select("f", "doc_id"), "f"), "wanted")
    texts = docs.join(_small(wanted), "doc_id").select("f", "text")
    sets = stored(texts.mapInArrow(_sets(k), "f long, members binary, marks binary"), "sets")
    schema = "f long, p long, ok boolean"
    likely = stored(_beside(pairs, sets, "marks").mapInArrow(_bound(percent), schema).where("ok")
                    .select("f", "p").distinct(), "likely")
    out = stored(_beside(likely, sets, "members").mapInArrow(_probe(percent), schema).where("ok")
                 .select("f", "p").distinct(), "links")
    for table in (wanted, sets, likely):
        drop(table)
    return out


_OPEN = "x.c != y.c AND x.n <= y.reach AND y.n <= x.reach"


def _list_pairs(members: DataFrame, every: bool) -> DataFrame:
    """(f, p) of members (h, m) of short lists in different components: each
    with its list's pivot, or ``every`` pair.  A list is one row of at most
    SHORT members."""
    lists = members.groupBy("h").agg(F.collect_list("m").alias("m")).where("size(m) > 1")
    if every:
        pairs = f"""flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {SHORT}), y -> {_OPEN}),
            y -> named_struct('x', x.f, 'y', y.f))))"""
    else:
        lists = lists.withColumn("y", F.array_max("m"))
        pairs = f"transform(filter(m, x -> {_OPEN}), x -> named_struct('x', x.f, 'y', y.f))"
    found = lists.select(F.explode(F.expr(pairs)).alias("r"))
    return found.select(F.least("r.x", "r.y").alias("f"), F.greatest("r.x", "r.y").alias("p"))


def _long_list_pairs(members: DataFrame, every: bool) -> DataFrame:
    """The same for long lists, by joins; lists of one component are left out."""
    pivots = members.groupBy("h").agg(F.max("m").alias("y"), F.min("m.c").alias("c0"), F.max("m.c").alias("c1")).where(
        "c0 < c1")
    x = members.select("h", F.col("m").alias("x"))
    if every:
        open_lists = x.join(pivots.select("h"), "h")
        both = open_lists.join(open_lists.select("h", F.col("x").alias("y")), "h").where(f"x.f < y.f AND {_OPEN}")
    else:
        both = x.join(pivots.select("h", "y"), "h").where(_OPEN)
    return both.select(F.least("x.f", "y.f").alias("f"), F.greatest("x.f", "y.f").alias("p"))


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two documents link when 100 * |intersection| >= percent * |union| of
    their sets of k-word shingles (A-Z lower-cased; shorter texts count as
    one shingle); component_id is the smallest doc_id reachable.  Null,
    empty and blank texts have no shingles and link with nothing: their
    component is their own id.  A row without an id takes no part in links;
    its component is null.  Rows that repeat an id, with the same or another
    text, each keep their own row and component.  An empty table gives an
    empty result.  Further columns are ignored.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    levels = spark.sparkContext.broadcast(list_levels(docs.select("text"), k))
    rows = stored(docs.mapInArrow(_short_lists(k, percent, levels),
                                  "doc_id long, n long, f long, short array<long>"), "short")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    # shared shingles of a pair stand at or after the first one's place in the order of lists, so it
    # bounds the partner's size: |union| - |intersection| leaves no room for a larger one
    reach = F.expr(f"floor((n - pos) * {100 + percent} / {percent}) - n")
    postings = rows.where("short IS NOT NULL").select("f", "n", F.posexplode("short").alias("pos", "h")).select(
        "h", "f", F.col("n").cast("int").alias("n"), reach.cast("int").alias("reach"))
    shared = postings.groupBy("h").agg(
        F.min("f").alias("lo"), F.max("f").alias("hi"), F.count("*").alias("many"), F.min("n").alias("least"),
        F.max("reach").alias("far")).where("lo < hi").select("h", "many", "least", "far")
    lists = stored(postings.join(shared, "h").where("reach >= least AND n <= far").drop("least", "far"), "lists")
    # an original shares more with its copies than these with each other
    weight = lists.groupBy("f").agg(F.sum("many").alias("weight"))
    lists = stored(lists.join(weight, "f"), "weighted")

    tested = links = comps = None  # pairs so far, the linked ones, and their components
    for turn in range(PIVOT_ROUNDS + 1):
        at = lists.withColumn("c", F.col("f")) if comps is None else (
            lists.join(comps, lists.f == comps.node, "left").select(
                "h", "f", "n", "reach", "many", "weight", F.coalesce("component", "f").alias("c")))
        rank = F.col("weight") if turn == 0 else F.xxhash64("f", F.lit(turn))
        member = F.struct(rank.alias("rank"), "f", "n", "reach", "c")
        pairs = _list_pairs(at.where(F.col("many") <= SHORT).withColumn("m", member), turn == PIVOT_ROUNDS).union(
            _long_list_pairs(at.where(F.col("many") > SHORT).withColumn("m", member), turn == PIVOT_ROUNDS)).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["f", "p"], "left_anti")
        pairs = stored(pairs, "pairs")
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.union(pairs)
            found = _verified(docs, classes, pairs, k, percent)
            links = found if links is None else links.union(found)
            comps = components(links, "f", "p")

    named = classes if comps is None else classes.join(comps, classes.f == comps.node, "left").select(
        "f", "doc_id", F.coalesce("component", "f").alias("component"))
    if comps is None:
        named = named.withColumn("component", F.col("f"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("f", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(named, "f", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that link to one of a smaller id,
    directly or not: the smallest id of each group stays, with all columns.

    Rows without an id, and texts without words, stay.  Rows that repeat an
    id and its text become one; an id goes when any of its texts does.
    """
    own, = unused(docs.columns, "_id")
    rows = stored(jaccard_groups(docs, id_col=id_col, text_col=text_col, **options), "groups")
    drop_ids = stored(rows.where("doc_id IS NOT NULL AND doc_id != component_id").select(
        F.col("doc_id").alias(own)).distinct(), "dropped")
    again = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).count().where("count > 1").select(own)
    again, same = stored(again, "repeated"), F.col(id_col) == F.col(own)
    kept = docs.join(_small(drop_ids), same, "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(_small(again), same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(_small(again), same, "left_anti").union(once)
