"""Connected components of a graph that is given by its edges, by alternating stars.

A round points all larger neighbours of a node, and then all smaller ones and the node
itself, to the least node seen; rounds end when nothing changes, after some log² n.  Minima are
aggregates that are summed up before they are shuffled and come back by a join with one row
a node, so that a node with a third of all edges is cut where joins are.  A round's edges
are a table in the given folder; two of them are there at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) of all nodes of edges (a, b), numbers; the component is its least node. Loops, repeats and nulls are left out."""
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before, k = None, 0
    while True:
        path = f"{folder}/edges-{k % 2}"
        now.write.mode("overwrite").parquet(path)
        now = spark.read.schema("a long, b long").parquet(path)
        state = _state(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before, k = state, k + 1
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.union(least.select("a", "m")).distinct()
