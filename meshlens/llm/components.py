"""Connected components of an edge table, by alternating large and small stars.

Each round rewires every node to the smallest node it sees, first from its
larger neighbours (large star), then from its smaller ones (small star); the
edges shrink to stars around the components' smallest nodes in a number of
rounds that grows as the logarithm of the size.  Rounds are joins and minimum
aggregates with map-side combining; each ends in a checkpoint, so lost
executors cost no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        both = both.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    joined = both.join(least, "x")
    if large:
        out = joined.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("y").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """Rows (u, v) of links -> rows (node, root) for every node that has a link.

    ``files``: into how many parts the rounds are written, where the caller
    knows how few links there are.
    """
    shared_dir(edges.sparkSession)
    kept = lambda df: (df.coalesce(files) if files else df).checkpoint()
    now = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = kept(_star(_star(now, True), False))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == mark:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
