"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest vertex reachable from each linked vertex: (node, component).

    Alternating large-star and small-star steps: each vertex links its
    larger (then its smaller) neighbours to the smallest one it knows.  The
    number of steps grows with the logarithm of the longest path, each step
    keeps at most as many links as before, and a hub's neighbours are only
    ever joined to its minimum, never paired with one another.  Self links
    and nulls are ignored; no links give an empty table.
    """
    edges = stored(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = stored(large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("x"), F.col("m").alias("y"))
                 .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")))
        small = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        # done when every vertex has one link, and it ends in a root
        many = small.groupBy("u").count().where("count > 1").limit(1)
        deep = small.alias("x").join(small.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").limit(1)
        done = not many.select(F.lit(1)).union(deep.select(F.lit(1))).take(1)
        drop(edges)
        drop(large)
        edges = small
        if done:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
