"""Connected components by least labels and pointer jumps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_PAIRS, Scratch, to_all


def components(scratch: Scratch, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """v and c (the least vertex that v reaches) of every vertex of edges (a, b; at most so many rows), a table with `moved` besides.

    A round replaces each label by its label's label, then by the least of its
    neighbours'.  What a join reads is a written table, so that Spark can split the rows
    of a hub, and few labels go to all tasks; labels are least values, which are summed up
    before they are shuffled."""
    pairs = scratch.write(edges.where("a <> b").select("a", "b"), rows)
    links = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    most = 2 * pairs.count()
    few = lambda table: to_all(table, most, BROADCAST_PAIRS)
    labels = scratch.write(links.groupBy("v").agg(F.least("v", F.min("u")).alias("c"), F.lit(True).alias("moved")), most)
    while not labels.where("moved").isEmpty():
        up = labels.select(F.col("v").alias("c"), F.col("c").alias("least"))
        jumped = labels.select("v", "c").join(few(up), "c").select("v", F.col("least").alias("c"), F.col("c").alias("old"))
        near = links.join(few(jumped.select(F.col("v").alias("u"), "c")), "u").select("v", "c", F.lit(None).cast("long").alias("old"))
        new = jumped.union(near).groupBy("v").agg(F.min("c").alias("c"), F.max("old").alias("old"))
        before, labels = labels, scratch.write(new.select("v", "c", (F.col("c") != F.col("old")).alias("moved")), most)
        scratch.drop(before)
    scratch.drop(pairs)
    return labels
