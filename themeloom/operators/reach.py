"""Core distances, mutual reachability and its edges, over neighbour lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.skew import attach, meet


def adapted_cluster_size(n: Column, wanted: int = 25) -> Column:
    """Smallest cluster for n documents: about a tenth of them, at least five."""
    tenth = F.greatest(F.lit(5), F.floor(n / 10).cast("int"))
    return F.greatest(F.lit(5), F.least(F.lit(wanted), tenth)).cast("int")


def core_distances(edges: DataFrame, points: DataFrame, samples: DataFrame) -> DataFrame:
    """``set_id, point_id, weight, core``: distance to the m-th nearest document.

    The document itself does not count, its copies do.  ``samples`` gives m per
    set as ``set_id, m``; a set with fewer documents takes its farthest one.
    """
    weights = points.select("set_id", F.col("point_id").alias("nbr_id"), F.col("weight").alias("nbr_weight"))
    rows = meet(edges, weights, ["set_id", "nbr_id"])
    order = Window.partitionBy("set_id", "point_id").orderBy(F.round("dist", 9), "nbr_id")
    seen = rows.withColumn("seen", F.sum("nbr_weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = attach(points.select("set_id", "point_id", "weight"), samples, ["set_id"], row_bytes=16)
    seen = meet(own, seen, ["set_id", "point_id"], "left")
    reach = F.col("seen") + F.col("weight") - 1 >= F.col("m")
    core = seen.groupBy("set_id", "point_id", "weight", "m").agg(
        F.min(F.when(reach, F.col("dist"))).alias("_at"), F.max("dist").alias("_far"))
    return core.select("set_id", "point_id", "weight",
                       F.when(F.col("weight") - 1 >= F.col("m"), F.lit(0.0))
                        .otherwise(F.coalesce("_at", "_far", F.lit(0.0))).alias("core"))


def mutual_reachability(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """Undirected edges ``set_id, a, b, w``: the larger of both core distances and the distance."""
    ca = cores.select("set_id", F.col("point_id"), F.col("core").alias("core_a"))
    cb = cores.select("set_id", F.col("point_id").alias("nbr_id"), F.col("core").alias("core_b"))
    w = F.greatest("core_a", "core_b", "dist")
    near = meet(edges.select("set_id", "point_id", "nbr_id", "dist"), ca, ["set_id", "point_id"])
    return (meet(near, cb, ["set_id", "nbr_id"])
            .select("set_id", F.least("point_id", "nbr_id").alias("a"),
                    F.greatest("point_id", "nbr_id").alias("b"), w.alias("w"))
            .groupBy("set_id", "a", "b").agg(F.min("w").alias("w")))
