"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.common import stage


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: root is the smallest node reachable; nodes without an edge are left out.

    Each round hooks the larger neighbours of a node to its smallest one, then the smaller ones; rounds grow
    with the logarithm of the graph's size, not with its diameter.  The smallest neighbour is an aggregate that
    combines before the shuffle, and the join back has one row per node on one side, so a hub is split by the
    adaptive skew join.  Every round is a written table; the driver sees one row of counters.
    Null ends, loops and repeated edges are ignored.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a is not null and b is not null and a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        later = stage(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(later)
        now = later
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
