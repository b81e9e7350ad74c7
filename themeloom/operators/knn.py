"""Exact k nearest neighbours by pivot cells.

Every vector belongs to the cell of its nearest pivot; cells are hashed into
blocks of bounded size, so large that a vector travels to few of them, and compared
a tile at a time.  A vector first meets the blocks of its own cell, which
bounds how far its k-th neighbour can be, and then only those other cells that
the triangle inequality and the bisecting plane cannot rule out.  No candidate
that could be a neighbour is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.vectors import unit
from themeloom.operators.points import keyed
from themeloom.operators.skew import attach, meet, top_per_group
from themeloom.session import cut

MAX_PIVOTS = 1024
DIRECT = 16384
# Values of the vectors of one block at most; distances held at once.
BLOCK_VALUES = 1 << 21
TILE = 1 << 20
SLACK = 1e-9


def adapted_neighbours(n, wanted: int):
    """Neighbour count for n rows, as a column expression."""
    return F.greatest(F.lit(2), F.least(F.lit(wanted), F.greatest(F.lit(2), n - 1)))


def adapted_components(n, wanted: int):
    return F.least(F.lit(wanted), F.greatest(F.lit(2), n))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64", copy=False)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # About b's centre, so that little cancels when all values lie far from the origin.
    centre = b.mean(0)
    a, b = a - centre, b - centre
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.maximum(d, 0.0)


def _tiles(rows: int, width: int) -> Iterator[slice]:
    """Slices of so many rows that ``TILE`` values of ``width`` a row are held at once."""
    step = max(1, TILE // max(width, 1))
    return (slice(at, at + step) for at in range(0, rows, step))


def _into_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest of the first ``n_cells`` pivots of every point."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _tiles(len(pdf), len(pivots)):
                some = pdf.iloc[part]
                d = _squared(_matrix(some["vec"]), pivots)
                d[np.arange(len(pivots))[None, :] >= some["n_cells"].to_numpy()[:, None]] = np.inf
                cell = d.argmin(1)
                yield some.assign(cell=cell.astype("int32"),
                                  to_pivot=np.sqrt(d[np.arange(len(d)), cell]))

    return points.mapInPandas(assign, "set_id long, point_id long, vec array<double>, n_cells int, "
                                      "cell int, to_pivot double")


def near_members(left: pd.DataFrame, right: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of visitors, their nearest members and the distances: up to ``k`` members no farther than ``bound`` each.

    ``left`` has ``point_id, vec`` and ``bound`` (null: none), ``right`` the members' ``host_id, host_vec``.
    Beside the vectors themselves only ``TILE`` distances, or values of differences, are held at once.
    """
    order = np.argsort(right["host_id"].to_numpy(), kind="stable")
    xid, x = right["host_id"].to_numpy()[order], _matrix(right["host_vec"].iloc[order])
    qid, bound = left["point_id"].to_numpy(), left["bound"].astype("float64").fillna(np.inf).to_numpy()
    # About the members' centre, so that little cancels when all values lie far from the origin.
    centre = x.mean(0)
    around = x - centre
    norm, m, found = (around * around).sum(1), min(k, len(xid)), []
    for part in _tiles(len(qid), len(xid)):
        q, names = _matrix(left["vec"].iloc[part]), qid[part]
        own = q - centre
        d = own @ around.T
        d *= -2.0
        own = (own * own).sum(1)
        d += own[:, None]
        d += norm
        np.maximum(d, 0.0, out=d)
        # A point is no neighbour of itself.
        first, last = np.searchsorted(xid, names), np.searchsorted(xid, names, "right")
        for i in range((last - first).max()):
            same = np.flatnonzero(first + i < last)
            d[same, first[same] + i] = np.inf
        # All members that may be as near as the k-th, within what rounding can do: ties are settled by id below.
        kth = bound[part] ** 2
        many = np.isinf(kth)
        if not many.all():
            many |= np.count_nonzero(d <= _about(kth, norm, own)[:, None], axis=1) > m
        if many.any():
            kth[many] = np.minimum(kth[many], np.partition(d if many.all() else d[many], m - 1, axis=1)[:, m - 1])
        near = d <= _about(kth, norm, own)[:, None]
        if np.isinf(kth).any():
            near &= np.isfinite(d)
        rows, cols = np.nonzero(near)
        exact = np.empty(len(rows))
        for some in _tiles(len(rows), 4 * x.shape[1]):
            gap = q[rows[some]] - x[cols[some]]
            exact[some] = np.sqrt((gap * gap).sum(1))
        order = np.lexsort((xid[cols], np.round(exact, 9), rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < m
        found.append((names[rows[best]], xid[cols[best]], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _about(squared: np.ndarray, norm: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distances with what rounding may add to them, and to distances of nine digits."""
    return squared + 1e-12 * (norm.max() + own) + 3e-9 * np.sqrt(np.where(np.isfinite(squared), squared, 0.0)) + 1e-15


def _meet(visits: DataFrame, hosts: DataFrame, k: int) -> DataFrame:
    """Up to k nearest members of each visited block for each visitor.

    A group is one part of a block's visitors against that block, so its size
    is bounded whatever the distribution of the data.
    """
    keys = ["set_id", "cell", "sub", "part"]
    visits = visits.select(*keys, "point_id", "vec", F.col("bound").cast("double").alias("bound"))
    hosts = hosts.select(*[F.col(c).alias(f"host_{c}") for c in keys],
                         F.col("point_id").alias("host_id"), F.col("vec").alias("host_vec"))

    def nearest(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"set_id": [], "point_id": [], "nbr_id": [], "dist": []})
        point, near, dist = near_members(left, right, k)
        return pd.DataFrame({"set_id": np.full(len(point), key[0]), "point_id": point, "nbr_id": near, "dist": dist})

    return (visits.groupBy(*keys)
            .cogroup(hosts.groupBy(*[f"host_{c}" for c in keys]))
            .applyInPandas(nearest, "set_id long, point_id long, nbr_id long, dist double"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = [F.round("dist", 9), F.col("nbr_id")]
    return top_per_group(found, ["set_id", "point_id"], order, k)


@dataclass
class Blocks:
    """``placed``: set_id, point_id, vec, n_cells, cell, to_pivot, subs, sub.  ``cells``: set_id, cell,
    subs, radius.  ``centres``: the pivots; sets of fewer cells use the first of them.  ``block``: rows of a block."""

    placed: DataFrame
    cells: DataFrame
    centres: np.ndarray
    block: int


def into_blocks(points: DataFrame, block: int | None = None, pivots: int | None = None, *, wide: bool = False) -> Blocks:
    """Deal ``set_id, point_id, vector`` to pivot cells and those to hashed blocks of about ``block`` rows.

    ``wide`` blocks have ``block`` rows at least, and a sixteenth of all points if ``BLOCK_VALUES``
    allows it: every vector is sent to each block it meets, so their number must not grow with the points.
    """
    counts = cut(points.groupBy("set_id").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")))
    total, dim = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).head()
    if wide:
        block = max(block or 256, min(BLOCK_VALUES // max(dim, 1), math.ceil(total / 16)))
    block = block or min(2048, max(256, math.ceil(total / 32)))
    # A set of few points is one cell; a larger one gets cells in proportion.
    n_cells = F.lit(pivots) if pivots else F.when(F.col("n") <= DIRECT, 1).otherwise(
        F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("n") / (block if wide else 4 * block))))
    counts = counts.select("set_id", n_cells.cast("int").alias("n_cells"))
    n_pivots = counts.agg(F.coalesce(F.max("n_cells"), F.lit(1))).head()[0]
    slim = attach(points.select("set_id", "point_id", F.col("vector").alias("vec")), counts, ["set_id"],
                  row_bytes=16, spread=F.col("point_id"))
    slim = slim.select("set_id", "point_id", "vec", "n_cells")
    if n_pivots == 1:
        assigned, centres = slim.withColumns({"cell": F.lit(0), "to_pivot": F.lit(0.0)}), np.zeros((1, 1))
    else:
        sample = (slim.where("n_cells > 1").orderBy(F.xxhash64("point_id", "set_id"))
                  .limit(n_pivots).select("vec").collect())
        centres = np.array([r["vec"] for r in sample], dtype="float64")
        assigned = cut(_into_cells(slim, centres))
    cells = cut(assigned.groupBy("set_id", "cell").agg(
        F.ceil(F.count("*") / block).cast("int").alias("subs"), F.max("to_pivot").alias("radius")))
    placed = attach(assigned, cells.select("set_id", "cell", "subs"), ["set_id", "cell"],
                    row_bytes=32, spread=F.col("point_id"))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("point_id"), F.col("subs")).cast("int"))
    if n_pivots > 1:
        placed = cut(placed)
    return Blocks(placed, cells, centres, block)


def knn(points: DataFrame, k: int, *, metric: str = "euclidean", block: int | None = None,
        pivots: int | None = None) -> DataFrame:
    """``set_id, point_id, nbr_id, dist, rank``: the k nearest other points of a set.

    ``points`` has ``set_id, point_id, vector`` with distinct vectors and should
    be a stored table; the pivots taken from it are at most ``MAX_PIVOTS`` rows.
    Ties go to the smaller id.
    """
    if metric == "cosine":
        # A zero vector has distance one to all others: it gets an axis of its own.
        zero = F.when(F.exists("vector", lambda x: x != 0), F.lit(0.0)).otherwise(F.lit(1.0))
        points = points.withColumn("vector", F.concat(unit(F.col("vector")), F.array(zero)))
    cells = into_blocks(points, block, pivots, wide=True)
    placed, n_pivots = cells.placed, len(cells.centres)
    every = F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
    # The blocks of a cell are also the parts of the visitors that are at home in it.
    own = placed.withColumnRenamed("sub", "part").withColumns({"sub": every, "bound": F.lit(None)})
    first = _best(_meet(own, placed.withColumn("part", every), k), k)
    if n_pivots > 1:
        first = cut(first)
        limit = first.groupBy("set_id", "point_id").agg(
            F.when(F.count("*") >= k, F.max("dist")).alias("bound"))
        away = _other_cells(meet(placed.where("n_cells > 1"), limit, ["set_id", "point_id"], "left"), cells.centres)
        away = attach(away, cells.cells, ["set_id", "cell"], row_bytes=32, spread=F.col("point_id"))
        # Vectors are left behind until the visitors of every cell are known and counted.
        away = cut(away.where(F.col("gap") - F.col("radius") <= F.col("bound") + SLACK)
                   .select("set_id", "point_id", "cell", "subs", "bound"))
        parts = cut(away.groupBy("set_id", "cell").agg(F.ceil(F.count("*") / cells.block).cast("int").alias("parts")))
        # Only as many copies of a block are made as there are blocks full of visitors.
        hosts = attach(placed, parts, ["set_id", "cell"], row_bytes=32, spread=F.col("point_id")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        visits = attach(away, parts, ["set_id", "cell"], row_bytes=32, spread=F.col("point_id"))
        visits = meet(visits, placed.select("set_id", "point_id", "vec"), ["set_id", "point_id"]).withColumns({
            "sub": every, "part": F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int")})
        first = _best(first.drop("rank").unionByName(_meet(visits, hosts, k)), k)
    if metric == "cosine":
        first = first.withColumn("dist", F.col("dist") * F.col("dist") / 2)
    return first.select("set_id", "point_id", "nbr_id", "dist", "rank")


def _other_cells(located: DataFrame, centres: np.ndarray) -> DataFrame:
    """Cells a point still has to visit: those nearer than its bound could be."""
    between = np.sqrt(_squared(centres, centres))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _tiles(len(pdf), len(centres)):
                some = pdf.iloc[part]
                mine = some["cell"].to_numpy()
                d = _squared(_matrix(some["vec"]), centres)
                rows = np.arange(len(d))
                apart = np.maximum(between[mine], 1e-12)
                plane = (d - d[rows, mine][:, None]) / (2 * apart)
                bound = some["bound"].astype("float64").fillna(np.inf).to_numpy()
                open_ = plane <= bound[:, None] + SLACK
                open_ &= np.arange(len(centres))[None, :] < some["n_cells"].to_numpy()[:, None]
                open_[rows, mine] = False
                i, j = np.nonzero(open_)
                yield pd.DataFrame({
                    "set_id": some["set_id"].to_numpy()[i], "point_id": some["point_id"].to_numpy()[i],
                    "cell": j.astype("int32"), "gap": np.sqrt(d[i, j]), "bound": bound[i]})

    return located.select("set_id", "point_id", "vec", "n_cells", "cell", "bound").mapInPandas(
        choose, "set_id long, point_id long, cell int, gap double, bound double")


def document_neighbours(vectors: DataFrame, points: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Neighbours of documents, copies included: ``set_id, doc_id, nbr_doc, dist, rank``.

    ``points`` carries at least k+1 members each.  The k+1 nearest documents of
    a point serve all of its copies: each leaves itself out.
    """
    inside = points.select("set_id", "point_id", F.explode("members").alias("doc"),
                           F.lit(0.0).alias("dist"))
    hosts = points.select("set_id", F.col("point_id").alias("nbr_id"), "members")
    outside = (meet(edges.select("set_id", "point_id", "nbr_id", "dist"), hosts, ["set_id", "nbr_id"])
               .select("set_id", "point_id", F.explode("members").alias("doc"), "dist"))
    near = top_per_group(inside.unionByName(outside), ["set_id", "point_id"],
                         [F.round("dist", 9), F.col("doc")], k + 1)
    lists = near.groupBy("set_id", "point_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "doc", "dist"))).alias("near"))
    # Stored: to count them first would be to search twice.
    lists = cut(meet(points.select("set_id", "point_id", "key"), lists, ["set_id", "point_id"]).select("set_id", "key", "near"))
    docs = attach(keyed(vectors).drop("vector"), lists, ["set_id", "key"], row_bytes=64 + 24 * k, spread=F.col("doc_id"))
    mine = F.slice(F.filter("near", lambda e: e.doc != F.col("doc_id")), 1, k)
    return (docs.select("set_id", "doc_id", F.posexplode(mine).alias("i", "e"))
            .select("set_id", "doc_id", F.col("e.doc").alias("nbr_doc"),
                    F.col("e.dist").alias("dist"), (F.col("i") + 1).alias("rank")))
