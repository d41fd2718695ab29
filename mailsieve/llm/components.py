"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut


#: Rows of two numbers that a task may get for one key.
NARROW = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round keeps at most one row per edge and is checkpointed.  The number of rounds follows the
    logarithm of the longest path; nothing is gathered anywhere, and nodes with very many edges are broadcast
    (see ``by_key``).
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last, total = None, e.count()
    while True:
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = by_key(both.where("v > u"), low, ["u"], "c", 2 * total, NARROW).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node, move to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        moved = by_key(large, least, ["u"], "c", total, NARROW).select("u", "v", "m")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
        total, *sums = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if (total, *sums) == last:
            break
        last = (total, *sums)
    # settled: every node but the roots has one row, pointing to its root
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
