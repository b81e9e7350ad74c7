"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are cut into blocks.  A posting of a block's index says that a row has a component
of some quantised impact (its size, to three significant bits); postings form segments of
falling impact.  Segments are processed in that order, for a block of queries at once: each
adds query component x quantised impact to its rows' scores.  What quantisation hides, and
the largest impact that the open segments can still hold, bound every row's score from both
sides.  A query stops when those bounds prove that only a few rows can be among its k best;
possible members are then scored exactly.  Without such proof all segments are read.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.session import cut

BLOCK = 8192
QUERY_BLOCK = 256
SEGMENTS = 4
SIGNIFICANT_BITS = 3
FEW = 8


class ImpactIndex:
    """Index of one block of integer vectors, as segments of falling quantised impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.int64)
        size = np.abs(self.vectors)
        drop = np.maximum(0, np.frexp(size.astype(np.float64))[1] - SIGNIFICANT_BITS)
        self.lower = size >> drop << drop
        self.upper = self.lower + (np.int64(1) << drop) - 1
        steps = np.quantile(self.upper, np.linspace(1, 0, SEGMENTS + 1)[1:-1], method="lower") if size.size else []
        # Segment r holds the impacts above its floor; the last one holds what is left.
        self.floors = [*dict.fromkeys(int(x) for x in steps if x > 0), 0]

    def segment_bounds(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Twice the middle of each component, and twice its error, once segments up to ``r`` are read."""
        read = self.upper > self.floors[r]
        middle = np.where(read, np.sign(self.vectors) * (self.lower + self.upper), 0)
        error = np.where(read, self.upper - self.lower, 2 * self.floors[r])
        return middle.astype(np.float64), error.astype(np.float64)

    def candidates(self, queries: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """For each query, rows that hold the ``k`` (one number for each) best of this block for sure."""
        n = len(self.vectors)
        found: list[np.ndarray] = [np.arange(n)] * len(queries)
        still = np.flatnonzero(k < n)
        for r in range(len(self.floors)):
            if not len(still):
                break
            middle, error = self.segment_bounds(r)
            q = queries[still].astype(np.float64)
            score, spread = q @ middle.T, np.abs(q) @ error.T
            # Far above what rounding can do to sums of whole numbers of this size.
            spread += 1 + 1e-9 * (np.abs(score) + spread)
            left = []
            for i, at in enumerate(still):
                bar = np.partition(score[i] - spread[i], n - k[at])[n - k[at]]
                found[at] = np.flatnonzero(score[i] + spread[i] >= bar)
                if len(found[at]) > FEW * k[at]:
                    left.append(at)
            still = np.array(left, int)
        return found


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * component) of each component as double; null for a vector that takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best other rows by integer inner product.

    Queries are all rows whose ``vec_id`` is divisible by ``every``; candidates are all rows but
    the query's own id; ties go to the smaller ``vec_id``.  Fewer candidates give fewer rows.
    Vectors that are null, empty or hold null or non-finite components, and rows without id, take
    no part; vectors are compared with those of their own length.  A repeated id is one query for
    each distinct vector under it and as many candidates as it has rows.  Other columns are ignored.
    """
    rows = cut(vectors.select("vec_id", integers(F.col("embedding"), scale).alias("v"))
                      .where("vec_id is not null and v is not null and size(v) > 0"))
    counts = rows.groupBy(F.size("v").alias("dims")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    sizes = counts.select("dims", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
                          F.greatest(F.lit(1), F.ceil(F.col("q") / QUERY_BLOCK)).cast("int").alias("groups"))
    placed = rows.withColumn("dims", F.size("v")).join(sizes, "dims")
    # A frame of its own: both sides of the grouping come from the same rows.
    again = placed.toDF(*placed.columns)
    block = F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")
    group = F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int")
    index = placed.select("dims", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
                          "vec_id", "v")
    asked = (again.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
                   .select("dims", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                           group.alias("group"), "vec_id", "v"))

    def run(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            matrix, names = np.stack(list(block["v"])), block["vec_id"].to_numpy()
            index = ImpactIndex(matrix)
            asked, who = np.stack(list(queries["v"])).astype(np.int64), queries["vec_id"].to_numpy()
            # A query's own rows may be among the best and don't count.
            own = pd.Series(names).value_counts().reindex(who, fill_value=0).to_numpy()
            for name, query, near in zip(who, asked, index.candidates(asked, k + own), strict=True):
                near = near[names[near] != name]
                score = index.vectors[near] @ query
                best = np.lexsort((names[near], -score))[:k]
                out += [(name, int(names[near[b]]), int(score[b])) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    near = (asked.groupBy("dims", "block", "group").cogroup(index.groupBy("dims", "block", "group"))
                 .applyInPandas(run, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
