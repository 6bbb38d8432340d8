"""Shards along a Hilbert curve over document metadata (DataFrame functions
only).

Language, source and size are quantised to a few bits each by their ranks in
the corpus, the cell's place on the Hilbert curve is computed with bit
operations, and documents sorted by it are cut into runs of equal count.
Neighbours on the curve are neighbours in every dimension, so each shard
covers a small box and its file's min/max statistics prune queries on any of
the columns.  Copies of a text stand next to each other: their group stands
at its smallest cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.parallel import prefix_scan
from .scratch import stored

SHARDS = 40
BITS = 5
#: distinct strings of a dimension up to which their cells are broadcast; more are shuffled
BROADCAST_VALUES = 100_000


def _string_cells(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """_h_value, _h_cell: the cell of each distinct string, by the share of
    all rows whose string is smaller.  Strings with long common prefixes are
    told apart like any others; a value of many rows has one cell."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_h_value")).agg(F.count("*").alias("_h_n"))
    counts = stored(counts, "values")
    total = counts.agg(F.sum("_h_n")).scalar()
    place = prefix_scan(counts, ["_h_value"], sums={"_h_n": "_h_less"}, inclusive=False)
    return place.select("_h_value", F.expr("_h_less").alias("_h_less"), total.alias("_h_total")).select(
        "_h_value", F.expr(f"cast(_h_less * {1 << bits} div _h_total AS int)").alias("_h_cell"))


def quantised(value: str, cuts: str, bits: int) -> str:
    """SQL: how many of the sorted cuts lie below the value, at most
    2**bits - 1; null counts as lowest."""
    return f"cast(least(coalesce(size(filter({cuts}, c -> c < {value})), 0), {(1 << bits) - 1}) AS int)"


def hilbert_index(cell: str, n: int, bits: int) -> Column:
    """Place on the Hilbert curve of a cell, an SQL array of ``n`` integers of
    ``bits`` bits.

    From the highest bit down, each step undoes the rotation and reflection
    of the sub-cube it is in; the result is Gray-coded and its bits are
    interleaved.
    """
    top = 1 << (bits - 1)
    # step s works on bit shiftright(top, s div n) and dimension s % n
    bit, i = f"shiftright({top}, cast(s div {n} AS int))", f"s % {n}"
    turned = f"""aggregate(sequence(0, {(bits - 1) * n - 1}), {cell}, (x, s) -> transform(x, (v, j) ->
        CASE WHEN get(x, cast({i} AS int)) & {bit} != 0 THEN IF(j = 0, v ^ ({bit} - 1), v)
             WHEN {i} != 0 AND (j = 0 OR j = {i}) THEN v ^ ((x[0] ^ get(x, cast({i} AS int))) & ({bit} - 1))
             ELSE v END))""" if bits > 1 else cell
    gray = f"""aggregate(sequence(1, {n - 1}), {turned},
        (x, i) -> transform(x, (v, j) -> IF(j = i, v ^ get(x, i - 1), v)))""" if n > 1 else turned
    tail = f"""aggregate(sequence(0, {bits - 1}), 0, (t, k) ->
        IF(get(g, {n - 1}) & shiftright({top}, k) != 0, t ^ (shiftright({top}, k) - 1), t))"""
    mixed = f"get(transform(array({gray}), g -> transform(g, v -> v ^ {tail})), 0)"
    return F.expr(f"""get(transform(array({mixed}), m -> aggregate(sequence(0, {bits * n - 1}), 0L, (a, k) ->
        a * 2 + IF(get(m, cast(k % {n} AS int)) & shiftright({top}, cast(k div {n} AS int)) != 0, 1, 0))), 0)""")


def text_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16


def assign_shards(docs: DataFrame, group: list[str], dimensions: tuple[str, ...] = ("lang", "source", "size"),
                  shards: int = SHARDS, order: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``docs`` with shard (0 to shards - 1), slot (gapless from 0 in each
    shard) and hilbert (the sort key).

    Law ``rows``: shard sizes differ by one row at most.  ``dimensions`` are
    columns of strings or numbers; rows that are equal in the ``group``
    columns (copies) stand together at their smallest cell, and are split
    only where a run ends.  Nulls are a value of their own, lowest in every
    dimension; fewer rows than shards leave the last shards empty; repeated
    rows each get a slot; an empty table gives an empty result.  All columns
    are kept; their names must not start with ``_h_``.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    rows, cells = docs, []
    numbers = {f"_h_{i}": F.col(d).cast("double") for i, d in enumerate(dimensions) if kinds[d] != "string"}
    if numbers:
        quantiles = [k / (1 << bits) for k in range(1, 1 << bits)]
        rows = rows.withColumns(numbers)
        cuts = rows.agg(F.struct(*(F.percentile_approx(c, quantiles).alias(c) for c in numbers)).alias("c")).scalar()
        rows = rows.withColumn("_h_cuts", cuts)
    for i, d in enumerate(dimensions):
        if kinds[d] != "string":
            cells.append(quantised(f"_h_{i}", f"_h_cuts._h_{i}", bits))
            continue
        of = stored(_string_cells(docs, d, bits).withColumnsRenamed({"_h_value": f"_h_v{i}", "_h_cell": f"_h_c{i}"}), "cells")
        of = F.broadcast(of) if of.count() <= BROADCAST_VALUES else of
        rows = rows.join(of, F.col(d) == F.col(f"_h_v{i}"), "left").drop(f"_h_v{i}")
        cells.append(f"coalesce(_h_c{i}, 0)")
    place = hilbert_index("array(" + ", ".join(cells) + ")", len(cells), bits)
    helpers = [c for c in rows.columns if c not in docs.columns]
    rows = stored(rows.withColumn("hilbert", place).drop(*helpers), "cells")
    copies = rows.groupBy(*group).agg(F.min("hilbert").alias("_h_at"), F.count("*").alias("_h_n")).where("_h_n > 1")
    copies = copies.select("_h_at", *(F.col(g).alias(f"_h_g{i}") for i, g in enumerate(group)))
    same = F.expr(" AND ".join(f"`{g}` <=> _h_g{i}" for i, g in enumerate(group)))
    near = rows.join(copies, same, "left").select(*docs.columns, F.coalesce("_h_at", "hilbert").alias("hilbert"))
    keys = ["hilbert", *group, order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # range bounds are sampled, so the split is written down once
    split = stored(near.repartitionByRange(parts, *keys).withColumn("_h_part", F.spark_partition_id()), "runs")
    # the ranks of a part's rows start after those of the parts before: one row per part
    before = split.groupBy("_h_part").agg(F.count("*").alias("_h_n"))
    w = Window.orderBy("_h_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_h_part", F.coalesce(F.sum("_h_n").over(w), F.lit(0)).alias("_h_before"))
    total = split.agg(F.count("*")).scalar()
    rank = F.row_number().over(Window.partitionBy("_h_part").orderBy(*keys)) - 1 + F.col("_h_before")
    placed = (split.join(F.broadcast(before), "_h_part").withColumn("_h_rank", rank.cast("long"))
              .withColumn("_h_all", total))
    # the first ``all % shards`` shards hold one row more
    small, extra = F.expr(f"_h_all div {shards}"), F.col("_h_all") % shards
    shard = F.expr(f"""CASE WHEN _h_rank < (_h_all % {shards}) * (_h_all div {shards} + 1)
        THEN _h_rank div (_h_all div {shards} + 1)
        ELSE (_h_all % {shards}) + (_h_rank - (_h_all % {shards}) * (_h_all div {shards} + 1))
             div greatest(_h_all div {shards}, 1L) END""")
    slot = F.col("_h_rank") - F.col("shard") * small - F.least(F.col("shard"), extra)
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop(
        "_h_part", "_h_before", "_h_rank", "_h_all")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text", **options) -> None:
    """Write whole documents as one folder of files per shard, rows in slot
    order within each file."""
    keyed = docs.withColumn("size", text_size(text)).withColumn("_key", F.xxhash64(text))
    placed = assign_shards(keyed, ["_key", text], shards=shards, **options).drop("_key")
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
