"""Connected components by alternating large and small stars, one stored table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: long), root being the smallest node it reaches.

    Every round hangs all larger neighbours of a node, then all smaller ones, on the
    smallest node around; edges end as stars.  Rounds grow with the logarithm of the
    longest path.  Edges are written to the shared folder after each round, and a hub's
    minimum is combined before the shuffle.  Edges with a null end are left out.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    state = None
    while True:
        both = links.union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"),
                                             F.col("m").alias("y")).distinct()
        links = cut(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == state:
            roots = links.select(F.col("x").alias("node"), F.col("y").alias("root"))
            return roots.union(links.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
        state = now
