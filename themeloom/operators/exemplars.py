"""Cluster sizes, centroids and the members nearest to them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.vectors import euclidean
from themeloom.operators.skew import attach, top_per_group

NOISE = -1


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """``set_id, cluster_id, size`` without noise."""
    return (labels.where(F.col("cluster_id") != NOISE).groupBy("set_id", "cluster_id")
            .agg(F.count("*").alias("size")))


def noise_counts(labels: DataFrame) -> DataFrame:
    """``set_id, total_vectors, noise_points, n_clusters``."""
    cluster = F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))
    # Sizes first: distinct clusters are then counted on one row per cluster.
    per_cluster = labels.groupBy("set_id", "cluster_id").agg(F.count("*").alias("n"))
    return per_cluster.groupBy("set_id").agg(
        F.sum("n").alias("total_vectors"),
        F.sum(F.when(F.col("cluster_id") == NOISE, F.col("n")).otherwise(0)).alias("noise_points"),
        F.count(cluster).alias("n_clusters"))


def distinct_clusters(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("cluster_id") != NOISE).select("set_id", "cluster_id").distinct()


def centroids(members: DataFrame, vector: str = "z") -> DataFrame:
    """Element-wise mean of every cluster, summed inside partitions first."""
    return (members.where(F.col("cluster_id") != NOISE)
            .groupBy("set_id", "cluster_id")
            .agg(Summarizer.mean(array_to_vector(F.col(vector))).alias("_mean"))
            .select("set_id", "cluster_id", vector_to_array("_mean").alias("centroid")))


def exemplars(members: DataFrame, k: int = 5, vector: str = "z") -> DataFrame:
    """The k members nearest to their cluster's centroid, ties by id.

    ``members`` has ``set_id, doc_id, cluster_id`` and the vector; the result is
    ``set_id, cluster_id, doc_id, dist, rank``.  Noise has no exemplars.
    """
    centre = centroids(members, vector)
    near = attach(members.where(F.col("cluster_id") != NOISE)
                  .select("set_id", "cluster_id", "doc_id", F.col(vector).cast("array<double>").alias(vector)),
                  centre, ["set_id", "cluster_id"], row_bytes=4096, spread=F.col("doc_id"))
    near = near.select("set_id", "cluster_id", "doc_id",
                       euclidean(F.col(vector), F.col("centroid")).alias("dist"))
    return top_per_group(near, ["set_id", "cluster_id"], [F.round("dist", 9), F.col("doc_id")], k)
