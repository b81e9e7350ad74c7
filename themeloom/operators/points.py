"""Distinct vectors: exact copies become one weighted point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.vectors import as_double, fingerprint
from themeloom.operators.skew import attach, meet, top_per_group


def keyed(vectors: DataFrame) -> DataFrame:
    """``set_id, doc_id, vector`` with the content key of the vector."""
    v = as_double(F.col("vector"))
    return (vectors.where(F.col("vector").isNotNull())
            .select("set_id", "doc_id", v.alias("vector"), fingerprint(v).alias("key")))


def distinct_points(vectors: DataFrame, keep: int = 1) -> DataFrame:
    """One row per distinct vector of a set.

    ``point_id`` is the smallest document id, ``weight`` the number of copies
    and ``members`` their ``keep`` smallest ids: no neighbour list needs more of
    one copy group.  Copies are reduced before the shuffle, so a group holding a
    third of the documents costs no more than any other.
    """
    k = keyed(vectors)
    keys = ["set_id", "key"]
    points = k.groupBy(*keys).agg(F.min("doc_id").alias("point_id"),
                                  F.count("*").alias("weight"),
                                  F.first("vector").alias("vector"))
    if keep <= 1:
        return points.withColumn("members", F.array("point_id"))
    firsts = top_per_group(k.select(*keys, "doc_id"), keys, [F.col("doc_id")], keep)
    members = firsts.groupBy(*keys).agg(F.sort_array(F.collect_list("doc_id")).alias("members"))
    return meet(points, members, keys)


def to_documents(vectors: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """Give every document the columns of its point."""
    per_key = points.select("set_id", "key", *columns)
    return attach(keyed(vectors).drop("vector"), per_key, ["set_id", "key"], row_bytes=96,
                  spread=F.col("doc_id")).drop("key")
