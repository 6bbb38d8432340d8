"""Span types and a prefix scan over arrays.

Detection works on one row at a time with array expressions.  A plain fold
that appends to its result copies the result at every step; ``scan`` carries
values over blocks instead, so a row with tens of thousands of matches costs
work in proportion to their number.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType()),
])

SCAN_BLOCK = 32


def scan(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Array of what ``op`` makes of all elements before each one.

    ``op`` must be associative with ``zero`` as its neutral element.
    """
    last = F.greatest(F.size(values) - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last / SCAN_BLOCK).cast("int")),
                         lambda b: F.slice(values, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))
    totals = F.transform(blocks, lambda blk: F.aggregate(blk, zero, op))
    heads = F.aggregate(totals, F.array(zero), lambda acc, t: F.concat(acc, F.array(op(F.element_at(acc, -1), t))))
    return F.flatten(F.zip_with(blocks, F.slice(heads, 1, F.size(blocks)), lambda blk, head: F.transform(
        blk, lambda _, j: F.aggregate(F.slice(blk, 1, j), head, op))))
