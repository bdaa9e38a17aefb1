"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import materialize


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): root is the least node that `edges` (a, b: long) reach from node.
    One row per node of an edge; loops and repeated edges add nothing; null ends are left out.

    Each round hangs the neighbours of every node below the least of them, first the greater
    ones, then the rest, until no edge changes. A round is joins and partial minima over the
    edge table, written to the shared folder."""
    ends = edges.where(F.col("a") != F.col("b"))
    now = ends.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m")).distinct()
    now = materialize(now, "edges")
    mark = None
    while True:
        both = now.select(F.col("n").alias("v"), F.col("m").alias("u")).union(now.select(F.col("m").alias("v"), F.col("n").alias("u")))
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("low"))
        large = both.where(F.col("u") > F.col("v")).join(least, "v").select(F.col("u").alias("n"), F.col("low").alias("m")).distinct()
        lowest = large.groupBy("n").agg(F.min("m").alias("low"))
        hung = large.join(lowest, "n")
        small = hung.select(F.explode(F.array(F.struct("n", F.col("low").alias("m")), F.struct(F.col("m").alias("n"), F.col("low").alias("m")))).alias("e"))
        now = materialize(small.select("e.n", "e.m").where(F.col("n") > F.col("m")).distinct(), "edges")
        last, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("n", "m").cast("decimal(38,0)"))).first()
        if mark == last:
            roots = now.select(F.col("n").alias("node"), F.col("m").alias("root"))
            return roots.union(now.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
