"""Parallelism guard for CPU-heavy per-row operators (detection, redaction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Hash-spread rows when the source has fewer partitions than task slots.

    A large input already arrives in many file splits and is left alone (no
    shuffle).  A small or single-row-group table would otherwise run a
    per-row regex workload on one core.  Hashing on the document key is
    deterministic, so a retried task sees the same rows.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    cols = [k for k in keys if k in df.columns]
    if df.isStreaming:
        # A micro-batch's partitions are its file splits, unknown up front.
        # Detection costs ~100x more per byte than a shuffle, so always
        # balance the batch over the task slots.
        return df.repartition(slots, *cols) if cols else df.repartition(slots)
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *cols) if cols else df.repartition(slots)


def _range_split(df: DataFrame, keys: list, order_cols: list, parts: int | None, ordered: bool = False) -> DataFrame:
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *keys, *order_cols).withColumn("_pid", F.spark_partition_id())
    # Range bounds come from sampling, so two reads of ``r`` could split the
    # rows differently.  A reliable checkpoint (in spark.checkpoint.dir, which
    # survives a lost executor, unlike a cache) fixes one partitioning that
    # both the local scan and the carry table read.
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    if ordered:
        r = r.sortWithinPartitions(*keys, *order_cols)
    return r.checkpoint(eager=True)


#: inputs that the optimizer proves smaller than this (64 MB) fit one window
PLAIN_BYTES = 64 << 20


def fits_one_task(df: DataFrame) -> bool:
    """Whether the whole input is small by the optimizer's own estimate.  It
    comes from file sizes, so compression and explodes can make it too low by
    a factor; the limit is far under a task's memory for that reason.  No job
    runs.  Both plans give the same rows; this only saves a small input the
    second level."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= PLAIN_BYTES


def _window_scan(df: DataFrame, order_cols, keys, sums, maxes, inclusive) -> DataFrame:
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(*frame)
    for c, o in sums.items():
        df = df.withColumn(o, F.coalesce(F.sum(c).over(w), F.lit(0)))
    for c, o in maxes.items():
        df = df.withColumn(o, F.max(c).over(w))
    return df


def split_for_scan(df: DataFrame, order_cols: list[str], partition_cols: list[str] | tuple = (),
                   parts: int | None = None, ordered: bool = False) -> DataFrame:
    """Range-split rows on (group, order) and store the split id ``_pid``
    (checkpointed once); any number of :func:`scan_split` passes can then
    run over the same split.  ``ordered``: each part's rows are stored in
    their order, for passes that read them one after another."""
    return _range_split(df, list(partition_cols), order_cols, parts, ordered)


def scan_split(r: DataFrame, order_cols: list[str], partition_cols: list[str] | tuple = (),
               sums: dict[str, str] | None = None, maxes: dict[str, str] | None = None,
               inclusive: bool = True) -> DataFrame:
    """One running-sum / running-max pass over a :func:`split_for_scan`
    result (keeps ``_pid`` for further passes)."""
    sums, maxes = sums or {}, maxes or {}
    keys = list(partition_cols)
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    local = Window.partitionBy("_pid", *keys).orderBy(*order_cols).rowsBetween(*frame)
    for c, o in sums.items():
        r = r.withColumn("_ls_" + o, F.sum(c).over(local))
    for c, o in maxes.items():
        r = r.withColumn("_lm_" + o, F.max(c).over(local))
    tot = r.groupBy("_pid", *keys).agg(*[F.sum(c).alias("_ts_" + o) for c, o in sums.items()],
                                        *[F.max(c).alias("_tm_" + o) for c, o in maxes.items()])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select("_pid", *keys,
                       *[F.coalesce(F.sum("_ts_" + o).over(before), F.lit(0)).alias("_cs_" + o) for o in sums.values()],
                       *[F.max("_tm_" + o).over(before).alias("_cm_" + o) for o in maxes.values()])
    out = r.join(carry, ["_pid", *keys])
    for o in sums.values():
        out = out.withColumn(o, F.col("_cs_" + o) + F.coalesce(F.col("_ls_" + o), F.lit(0)))
    for o in maxes.values():
        out = out.withColumn(o, F.greatest(F.col("_cm_" + o), F.col("_lm_" + o)))
    drop = [p + o for o in sums.values() for p in ("_ls_", "_cs_")] + \
        [p + o for o in maxes.values() for p in ("_lm_", "_cm_")]
    return out.drop(*drop)


def prefix_scan(df: DataFrame, order_cols: list[str], partition_cols: list[str] | tuple = (),
                sums: dict[str, str] | None = None, maxes: dict[str, str] | None = None,
                inclusive: bool = True, parts: int | None = None, plain: bool | None = None) -> DataFrame:
    """Running sums / maxima over ``order_cols`` within each group, computed
    in two levels so that no group is processed by one task.

    ``sums`` / ``maxes`` map an input column to an output column.  Rows are
    range-partitioned on (group, order); each range partition scans its own
    rows; the totals of the earlier range partitions of a group come from a
    table with one row per (partition, group) and are carried in.  With
    ``inclusive=False`` the current row is left out (a running max of the
    rows before it, NULL for the first row of a group).

    ``order_cols`` must be a total order.  ``plain`` forces one plan; by
    default a small input takes a plain window.
    """
    sums, maxes = sums or {}, maxes or {}
    if fits_one_task(df) if plain is None else plain:
        return _window_scan(df, order_cols, list(partition_cols), sums, maxes, inclusive)
    r = split_for_scan(df, order_cols, partition_cols, parts)
    return scan_split(r, order_cols, partition_cols, sums, maxes, inclusive).drop("_pid")


def ranked(df: DataFrame, order_cols: list[str], partition_cols: list[str] | tuple = (), out: str = "rn",
           parts: int | None = None, plain: bool | None = None) -> DataFrame:
    """Exact 1-based ``row_number`` over ``order_cols`` (within each
    ``partition_cols`` group) without putting a group in one task: a
    running sum of ones through :func:`prefix_scan`.  ``order_cols`` must be
    a total order (add a unique key to break ties): equal sort keys always
    land in the same range partition."""
    return prefix_scan(df.withColumn("_one", F.lit(1).cast("long")), order_cols, partition_cols, sums={"_one": out},
                       parts=parts, plain=plain).drop("_one")


def lagged(df: DataFrame, key: str, order_cols: list[str], cols: list[str], plain: bool | None = None) -> DataFrame:
    """``lag(col)`` per key for each of ``cols`` (``prev_<col>``).

    ``order_cols`` must be a total order.  The lag of a large input is an
    equi-join on (key, rank - 1), so a hot key's rows are spread over every
    task instead of one window partition."""
    if fits_one_task(df) if plain is None else plain:
        w = Window.partitionBy(key).orderBy(*order_cols)
        for c in cols:
            df = df.withColumn("prev_" + c, F.lag(c).over(w))
        return df
    r = ranked(df, order_cols, [key], out="_rn", plain=False)
    prev = r.select(key, (F.col("_rn") + 1).alias("_rn"), *[F.col(c).alias("prev_" + c) for c in cols])
    return r.join(prev, [key, "_rn"], "left").drop("_rn")
