"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stored


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long node numbers to (node, root): every node that has an edge but the roots, with the
    least node of its component.

    Large-star and small-star steps in turn: each node hands its neighbours the least node it knows, until
    the edges are stars. Every round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. No neighbourhood is gathered: minima come from partial aggregation, and
    the joins have one row per node on one side, so that a hot node's edges can be split.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                   "graph")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "graph-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b").distinct(), "graph-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "graph-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = stored(small.unionAll(least.withColumnRenamed("m", "b")).distinct(), "graph")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
