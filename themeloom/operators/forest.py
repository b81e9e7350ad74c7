"""Minimum spanning forest, components, and the exact merge order, by joins.

Rounds of Borůvka: every component takes its lightest edge out, and trees of
components joined by such edges become the next components.  There are at most
log2(n) rounds.

The merge order (the single-linkage dendrogram) comes from the same rounds, in
the manner of tree-contraction algorithms for dendrograms.  Every component of
round j owns a *chain*: those edges inside it that are lighter than its own edge
out and did not fit the chain of an earlier, smaller component.  Sorted by
weight, the edges of a chain merge one after another.  The lowest one joins two
components of the round before, every other one adds ("hangs") the component
that chose it; on top of the chain sits the component's edge out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.skew import attach, meet
from themeloom.session import cut


# Edges a task reduces at once.
CAPACITY = 300_000


@dataclass
class Forest:
    """``links``: set_id, level, comp, up, w, a, b - the edge each component took
    and the component it became part of.  ``chains``: set_id, level, comp, w, a, b,
    x, x_level, h, y, hy - chain membership, the hung component and its size.
    ``tops``: set_id, level, comp, size - documents under a component's chain."""

    links: DataFrame
    chains: DataFrame
    tops: DataFrame


def _edge() -> Column:
    """An edge as one comparable value: weight first, then its ends."""
    return F.struct("w", "a", "b")


def _lightest(edges: DataFrame) -> DataFrame:
    """Per component its lightest edge out: ``set_id, comp, other, w, a, b``."""
    cols = ["w", "a", "b"]
    both = edges.select("set_id", F.col("ca").alias("comp"), F.col("cb").alias("other"), *cols).unionByName(
        edges.select("set_id", F.col("cb").alias("comp"), F.col("ca").alias("other"), *cols))
    best = both.groupBy("set_id", "comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e"))
    return best.select("set_id", "comp", "e.other", "e.w", "e.a", "e.b")


def _roots(chosen: DataFrame) -> DataFrame:
    """Follow the chosen edges to one root per tree: ``set_id, comp, up``."""
    back = chosen.select("set_id", F.col("comp").alias("other"), F.col("other").alias("back"))
    paired = attach(chosen, back, ["set_id", "other"], row_bytes=24, spread=F.col("comp"))
    mutual = F.col("back") == F.col("comp")
    up = cut(paired.select("set_id", "comp", F.when(mutual, F.least("comp", "other"))
                           .otherwise(F.col("other")).alias("up")))
    while True:
        above = up.select("set_id", F.col("comp").alias("up"), F.col("up").alias("top"))
        jumped = cut(attach(up, above, ["set_id", "up"], row_bytes=24, spread=F.col("comp")))
        done = jumped.where("up <> top").limit(1).count() == 0
        up = jumped.select("set_id", "comp", F.col("top").alias("up"))
        if done:
            return up


def _contract(edges: DataFrame, up: DataFrame) -> DataFrame:
    """Relabel edge ends, drop inner edges, keep the lightest of parallel ones."""
    for end in ("ca", "cb"):
        to = up.select("set_id", F.col("comp").alias(end), F.col("up").alias(f"up_{end}"))
        edges = attach(edges, to, ["set_id", end], row_bytes=24, spread=F.struct("a", "b"))
        edges = edges.drop(end).withColumnRenamed(f"up_{end}", end)
    ends = edges.where("ca <> cb").select(
        "set_id", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), _edge().alias("e"))
    return (ends.groupBy("set_id", "ca", "cb").agg(F.min("e").alias("e"))
            .select("set_id", "ca", "cb", "e.w", "e.a", "e.b"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Connected components of ``set_id, a, b`` edges: ``set_id, point_id, comp``.

    The component is named by its smallest point.
    """
    rest = cut(edges.select("set_id", F.col("a").alias("ca"), F.col("b").alias("cb"),
                            F.lit(0.0).alias("w"), "a", "b").where("ca <> cb"))
    label = cut(vertices.select("set_id", "point_id", F.col("point_id").alias("comp")))
    while rest.limit(1).count():
        up = _roots(cut(_lightest(rest)))
        moved = attach(label, up, ["set_id", "comp"], how="left", row_bytes=24, spread=F.col("point_id"))
        label = cut(moved.select("set_id", "point_id", F.coalesce("up", "comp").alias("comp")))
        rest = cut(_contract(rest, up))
    names = label.groupBy("set_id", "comp").agg(F.min("point_id").alias("name"))
    return attach(label, names, ["set_id", "comp"], row_bytes=24, spread=F.col("point_id")).select(
        "set_id", "point_id", F.col("name").alias("comp"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges ``set_id, a, b, w`` of the minimum spanning forest."""
    rest = cut(edges.select("set_id", F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"))
    picked = None
    while rest.limit(1).count():
        chosen = cut(_lightest(rest))
        step = chosen.select("set_id", "a", "b", "w").distinct()
        picked = step if picked is None else picked.unionByName(step)
        rest = cut(_contract(rest, _roots(chosen)))
    return picked if picked is not None else edges.select("set_id", "a", "b", "w").limit(0)


def lightest_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the minimum spanning forest, lightest first; ties go by the ends."""
    ends, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    first, second = place[:len(a)].tolist(), place[len(a):].tolist()
    up = list(range(len(ends)))
    kept = []
    for e in np.lexsort((b, a, w)).tolist():
        p, q = first[e], second[e]
        while up[p] != p:
            up[p] = p = up[up[p]]
        while up[q] != q:
            up[q] = q = up[up[q]]
        if p != q:
            up[q] = p
            kept.append(e)
    return np.array(kept, np.int64)


def reduced_forest(edges: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Edges ``set_id, a, b, w`` of the minimum spanning forest, stored.

    An edge that is the heaviest of some cycle is in no minimum spanning forest.  So each part of a
    set's edges is reduced to its own forest, parts of at most about ``capacity`` edges a task, and
    what they leave is dealt to fewer parts, until a set is one part.  Where parts leave most of
    their edges, rounds over all of them do the rest.
    """
    def reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["set_id", "a", "b", "w"]].iloc[lightest_forest(*(pdf[c].to_numpy() for c in "abw"))]

    rest, before = cut(edges.select("set_id", "a", "b", "w")), None
    while True:
        sizes = cut(rest.groupBy("set_id").agg(F.count("*").alias("n")))
        most, total = sizes.agg(F.max("n"), F.sum("n")).first()
        if most is None:
            return rest
        if before is not None and total > 0.7 * before:
            return cut(spanning_forest(rest))
        parts = sizes.select("set_id", F.ceil(F.col("n") / capacity).cast("int").alias("parts"))
        dealt = attach(rest, parts, ["set_id"], row_bytes=16, spread=F.struct("a", "b"))
        part = F.pmod(F.xxhash64("a", "b"), F.col("parts")).alias("part")
        rest = cut(dealt.select("set_id", part, "a", "b", "w").groupBy("set_id", "part").applyInPandas(
            reduce, "set_id long, a long, b long, w double"))
        if most <= capacity:
            return rest
        before = total


def merge_order(edges: DataFrame, vertices: DataFrame) -> Forest:
    """Chains of the whole forest with the size of everything they hang.

    ``edges`` is ``set_id, a, b, w``; ``vertices`` is ``set_id, point_id, weight``.
    """
    rest = cut(edges.select("set_id", F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"))
    tops = cut(vertices.select("set_id", F.lit(0).alias("level"), F.col("point_id").alias("comp"),
                               F.col("weight").cast("long").alias("size")))
    links = chains = waiting = None
    level = 0
    while True:
        chosen = cut(_lightest(rest))
        open_ = chosen.limit(1).count() > 0
        if waiting is not None:
            # An edge lighter than its component's edge out belongs to this chain.
            out = chosen.select("set_id", "comp", F.struct("w", "a", "b").alias("out"))
            met = cut(attach(waiting, out, ["set_id", "comp"], how="left", row_bytes=48,
                             spread=F.struct("a", "b")))
            fits = F.col("out").isNull() | (_edge() < F.col("out"))
            mine = _hung_sizes(met.where(fits).drop("out"), tops).withColumn("level", F.lit(level))
            mine = cut(mine)
            chains = mine if chains is None else chains.unionByName(mine)
            size = mine.groupBy("set_id", "level", "comp").agg(F.sum("h").alias("size"))
            tops = cut(tops.unionByName(size))
            waiting = met.where(~fits).drop("out")
        if not open_:
            break
        up = _roots(chosen)
        named = cut(attach(chosen, up, ["set_id", "comp"], row_bytes=24, spread=F.col("comp")))
        link = named.select("set_id", F.lit(level).alias("level"), "comp", "up", "w", "a", "b")
        links = link if links is None else links.unionByName(link)
        fresh = named.groupBy("set_id", "w", "a", "b", F.col("up").alias("into")).agg(
            F.min("comp").alias("x"), F.max("comp").alias("y"))
        fresh = fresh.select("set_id", F.col("into").alias("comp"), "w", "a", "b", "x",
                             F.when(F.col("y") != F.col("x"), F.col("y")).alias("y"),
                             F.lit(level).alias("x_level"))
        if waiting is not None:
            moved = attach(waiting, up, ["set_id", "comp"], row_bytes=24, spread=F.struct("a", "b"))
            fresh = moved.drop("comp").withColumnRenamed("up", "comp").unionByName(fresh)
        waiting = cut(fresh)
        rest = cut(_contract(rest, up))
        level += 1
    return Forest(links, chains, tops)


def _hung_sizes(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """Add ``hx`` and ``hy``, sizes of the hung components, and their sum ``h``."""
    for end in ("x", "y"):
        size = tops.select("set_id", F.col("level").alias("x_level"), F.col("comp").alias(end),
                           F.col("size").alias(f"h{end}"))
        edges = meet(edges, size, ["set_id", "x_level", end], "left")
    return edges.withColumn("h", F.col("hx") + F.coalesce("hy", F.lit(0)))


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Running sums per key in ``order``, for keys of any size.

    Rows are range-partitioned by key and order, so a large key spans several
    partitions; each sums its own part and adds what lies before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_sum_{o}") for o, v in values.items()])
    parts = parts.select(*keys, "_part", *[
        F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in values])
    joined = ranged.withColumns({f"_run_{o}": F.sum(v).over(here) for o, v in values.items()}).join(
        parts, [*keys, "_part"])
    out = joined.withColumns({o: F.col(f"_run_{o}") + F.col(f"_off_{o}") for o in values})
    return out.drop("_part", *[f"_run_{o}" for o in values], *[f"_off_{o}" for o in values])
