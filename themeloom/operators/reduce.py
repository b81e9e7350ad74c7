"""Fewer dimensions: principal components, spectral layout, neighbour layout."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.vectors import unit
from themeloom.operators.skew import SALTS, attach, meet, top_per_group
from themeloom.session import cut

# Sets whose sums a partition holds at once, and rows projected together.
HELD_SETS = 64
BLOCK = 8192


def _moments(rows: DataFrame) -> DataFrame:
    """``set_id, part, n, points, sums``: weighted sums of vectors and of their products, of parts of every set.

    A partition sums its own rows; a set's parts are as many as ``SALTS`` at most when they meet.
    """
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame([(s, n, c, t.tobytes()) for s, (n, c, t) in held.items()], columns=["set_id", "n", "points", "sums"])
            held.clear()
            return made

        for pdf in batches:
            for set_id, one in pdf.groupby("set_id"):
                x, w = np.stack(one["v"].to_numpy()), one["weight"].to_numpy(np.float64)
                # A last coordinate of one: products then hold the sums of vectors and of weights too.
                x = np.hstack([x, np.ones((len(x), 1))])
                n, c, t = held.get(set_id, (0.0, 0, 0.0))
                held[set_id] = (n + w.sum(), c + len(x), t + (x * w[:, None]).T @ x)
            if len(held) > HELD_SETS:
                yield out()
        yield out()

    return rows.select("set_id", "v", "weight").mapInPandas(add, "set_id long, n double, points long, sums binary").withColumn(
        "part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))


def principal_axes(rows: DataFrame, n_components: int) -> DataFrame:
    """``set_id, points, axes, variance``: leading axes of every set, one after the other, with their variances.

    ``rows`` has ``set_id, v, weight``.  A set of n documents has at most max(2, n) axes, the
    others are zero.  An axis points to where its largest value is positive.
    """
    def merge(pdf: pd.DataFrame) -> tuple[float, int, np.ndarray]:
        return pdf["n"].sum(), int(pdf["points"].sum()), sum(np.frombuffer(bytes(t)) for t in pdf["sums"])

    def some(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, c, t = merge(pdf)
        return pd.DataFrame({"set_id": [key[0]], "n": [n], "points": [c], "sums": [t.tobytes()]})

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, c, t = merge(pdf)
        d = math.isqrt(len(t)) - 1
        t = t.reshape(d + 1, d + 1) / n
        value, axis = np.linalg.eigh(t[:d, :d] - np.outer(t[d, :d], t[d, :d]))
        k = min(n_components, d, max(2, int(n)))
        axes, variance = np.zeros((min(n_components, d), d)), np.zeros(min(n_components, d))
        axes[:k], variance[:k] = axis[:, ::-1][:, :k].T, value[::-1][:k]
        turn = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
        axes *= np.where(turn == 0, 1, turn)[:, None]
        return pd.DataFrame({"set_id": [key[0]], "points": [c], "axes": [axes.ravel().tolist()], "variance": [variance.tolist()]})

    parts = _moments(rows).groupBy("set_id", "part").applyInPandas(some, "set_id long, n double, points long, sums binary")
    return cut(parts.groupBy("set_id").applyInPandas(
        solve, "set_id long, points long, axes array<double>, variance array<double>"))


def pca(points: DataFrame, n_components: int = 20) -> DataFrame:
    """``set_id, point_id, z``: leading components of the unit vectors of every set by itself.

    Copies count: ``points`` has their number as ``weight`` (one, if it has not).  The covariance is
    summed in partitions; only one d by d matrix a set is in one place.
    """
    weight = F.col("weight").cast("double") if "weight" in points.columns else F.lit(1.0)
    rows = points.select("set_id", "point_id", unit(F.col("vector")).alias("v"), weight.alias("weight"))
    axes = principal_axes(rows, n_components)
    blocks = axes.select("set_id", F.ceil(F.col("points") / BLOCK).cast("int").alias("blocks"))
    dealt = attach(rows.select("set_id", "point_id", "v"), blocks, ["set_id"], row_bytes=16, spread=F.col("point_id"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("point_id"), F.col("blocks")).cast("int"))
    copies = axes.select("set_id", "axes", F.explode(F.sequence(F.lit(0), F.ceil(F.col("points") / BLOCK).cast("int") - 1)).alias("block"))

    def project(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one):
            return pd.DataFrame({"set_id": [], "point_id": [], "z": []})
        x = np.stack(one["v"].to_numpy())
        z = x @ np.asarray(two["axes"].iloc[0]).reshape(-1, x.shape[1]).T
        return pd.DataFrame({"set_id": key[0], "point_id": one["point_id"].to_numpy(), "z": list(z)})

    return dealt.groupBy("set_id", "block").cogroup(copies.groupBy("set_id", "block")).applyInPandas(
        project, "set_id long, point_id long, z array<double>")


def fuzzy_weights(edges: DataFrame) -> DataFrame:
    """Symmetric neighbour weights ``set_id, point_id, nbr_id, weight``, both directions.

    Each row's distances are scaled so that its weights sum to log2 k, starting
    at its nearest positive distance; both directions combine to a + b - ab.
    """
    lists = edges.groupBy("set_id", "point_id").agg(F.sort_array(F.collect_list(
        F.struct("dist", "nbr_id"))).alias("near"))
    lists = lists.select("set_id", "point_id", F.transform("near", lambda e: e.dist).alias("dist"),
                         F.transform("near", lambda e: e.nbr_id).alias("nbr"))

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d in pdf["dist"]:
                d = np.asarray(d)
                positive = d[d > 0]
                rho = positive.min() if len(positive) else 0.0
                gap = np.maximum(d - rho, 0.0)
                lo, hi, target = 0.0, np.inf, math.log2(max(len(d), 2))
                sigma = 1.0
                for _ in range(64):
                    if np.exp(-gap / sigma).sum() > target:
                        hi = sigma
                        sigma = (lo + hi) / 2
                    else:
                        lo = sigma
                        sigma = sigma * 2 if np.isinf(hi) else (lo + hi) / 2
                out.append(np.exp(-gap / max(sigma, 1e-3 * d.mean(), 1e-12)))
            yield pdf[["set_id", "point_id", "nbr"]].assign(weight=out)

    scaled = lists.mapInPandas(
        scale, "set_id long, point_id long, nbr array<long>, weight array<double>")
    rows = (scaled.select("set_id", "point_id", F.explode(F.arrays_zip("nbr", "weight")).alias("e"))
            .select("set_id", "point_id", F.col("e.nbr").alias("nbr_id"), F.col("e.weight").alias("weight")))
    # Both directions of a row at once: a union would scale all lists a second time.
    ends = F.array(F.struct(F.col("point_id").alias("a"), F.col("nbr_id").alias("b")),
                   F.struct(F.col("nbr_id").alias("a"), F.col("point_id").alias("b")))
    rows = rows.select("set_id", "weight", F.explode(ends).alias("e")).select(
        "set_id", F.col("e.a").alias("point_id"), F.col("e.b").alias("nbr_id"), "weight")
    both = rows.groupBy("set_id", "point_id", "nbr_id").agg(
        F.sum("weight").alias("s"), (F.max("weight") * F.min("weight")).alias("p"), F.count("*").alias("n"))
    return both.select("set_id", "point_id", "nbr_id",
                       (F.col("s") - F.when(F.col("n") > 1, F.col("p")).otherwise(0.0)).alias("weight"))


def _noise(k: int):
    """Fixed pseudo-random start values of a point in [-1, 1)."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), "set_id", "point_id"), F.lit(20001)) / 10000.0 - 1.0
                     for i in range(k)])


def _orthonormal(z: DataFrame, k: int) -> DataFrame:
    """Make the columns of every set orthonormal from its k by k Gram matrix."""
    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for set_id, part in pdf.groupby("set_id"):
                x = np.stack(part["z"].to_numpy())
                sums[set_id] = sums.get(set_id, 0.0) + x.T @ x
        if sums:
            i, j = np.divmod(np.arange(k * k), k)
            yield pd.concat([pd.DataFrame({"set_id": s, "i": i, "j": j, "v": g.ravel()})
                             for s, g in sums.items()])

    parts = z.select("set_id", "z").mapInPandas(gram, "set_id long, i int, j int, v double")
    sums = parts.groupBy("set_id", "i", "j").agg(F.sum("v").alias("v"))

    def invert(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((k, k))
        g[pdf["i"], pdf["j"]] = pdf["v"]
        low = np.linalg.cholesky(g + 1e-12 * np.trace(g) * np.eye(k))
        return pd.DataFrame({"set_id": [key[0]], "m": [np.linalg.inv(low).ravel().tolist()],
                             "grown": [np.diag(low).tolist()]})

    turn = cut(sums.groupBy("set_id").applyInPandas(invert, "set_id long, m array<double>, grown array<double>"))
    joined = attach(z, turn, ["set_id"], row_bytes=8 * k * (k + 1), spread=F.col("point_id"))
    cols = [F.aggregate(F.zip_with("z", F.slice("m", 1 + i * k, k), lambda a, b: a * b),
                        F.lit(0.0), lambda s, x: s + x) for i in range(k)]
    return joined.select("set_id", "point_id", "d", F.array(*cols).alias("z"), "grown")


def spectral(weights: DataFrame, n_components: int = 20, rounds: int = 12,
             steps: int = 8, every: int = 4) -> DataFrame:
    """Leading eigenvectors of the normalised neighbour graph, trivial one left out.

    Orthogonal iteration: every round is one join of the edges with the current
    coordinates and one sum per point; columns are made orthonormal again after
    every ``every`` rounds.  Coordinates are those of a diffusion map
    after ``steps`` steps, so directions of small eigenvalues fade.
    """
    k = n_components + 1
    degree = weights.groupBy("set_id", "point_id").agg(F.sum("weight").alias("d"))
    degree = cut(degree)
    other = degree.select("set_id", F.col("point_id").alias("nbr_id"), F.col("d").alias("nd"))
    scaled = cut(meet(meet(weights, degree, ["set_id", "point_id"]), other, ["set_id", "nbr_id"])
                 .select("set_id", "point_id", "nbr_id",
                         (F.col("weight") / F.sqrt(F.col("d") * F.col("nd"))).alias("a")))
    start = F.array(F.sqrt("d"), *[F.get(_noise(k - 1), i) for i in range(k - 1)])
    z = _orthonormal(degree.select("set_id", "point_id", "d", start.alias("z")), k)
    z = cut(z)
    for turn in range(math.ceil(rounds / every) * every):
        there = z.select("set_id", F.col("point_id").alias("nbr_id"), "z")
        pulled = meet(scaled, there, ["set_id", "nbr_id"]).groupBy("set_id", "point_id").agg(
            *[F.sum(F.col("a") * F.get("z", i)).alias(f"s{i}") for i in range(k)])
        # (A + I) / 2 keeps the order of eigenvalues and makes them positive.
        mixed = meet(pulled, z, ["set_id", "point_id"]).select(
            "set_id", "point_id", "d",
            F.array(*[(F.col(f"s{i}") + F.get("z", i)) / 2 for i in range(k)]).alias("z"))
        z = cut(mixed)
        if turn % every == every - 1:
            z = cut(_orthonormal(z, k))
    faded = F.zip_with("z", "grown", lambda x, g: x * F.pow(g, F.lit(2 * steps / every)) / F.sqrt("d"))
    return z.select("set_id", "point_id", F.slice(faded, 2, n_components).alias("z"))


def curve_constants(min_dist: float = 0.0, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted by least squares to the target decay."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    target = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(200):
        u = d ** (2 * p[1])
        f = 1 / (1 + p[0] * u)
        jac = np.stack([-u * f * f, -p[0] * u * 2 * np.log(d) * f * f], axis=1)
        step = np.linalg.solve(jac.T @ jac + 1e-9 * np.eye(2), jac.T @ (target - f))
        p = np.maximum(p + 0.5 * step, 1e-3)
    return float(p[0]), float(p[1])


def neighbour_layout(weights: DataFrame, n_components: int = 20, *, min_dist: float = 0.0,
                     rounds: int = 10, seed: int = 42, repel_sample: int = 64) -> DataFrame:
    """Layout that pulls neighbours together and pushes others apart.

    Starts from :func:`spectral`.  Each round moves all points at once: a join
    along the edges pulls, and a sample of fixed size per set, drawn anew by
    hash, pushes.  Neighbourhoods are kept, exact coordinates are not promised.
    """
    a, b = curve_constants(min_dist)
    start = spectral(weights, n_components)
    size = start.groupBy("set_id").agg(F.sqrt(F.avg(F.aggregate(
        "z", F.lit(0.0), lambda s, x: s + x * x)) / n_components).alias("rms"))
    z = attach(start, cut(size), ["set_id"], row_bytes=16, spread=F.col("point_id"))
    z = cut(z.select("set_id", "point_id", F.transform(
        "z", lambda x: x / F.greatest(F.col("rms"), F.lit(1e-12))).alias("z")))
    weights = cut(weights)
    for step in range(rounds):
        rate = 1.0 - step / rounds
        draw = F.xxhash64(F.lit(seed + step), "set_id", "point_id")
        drawn = top_per_group(z, ["set_id"], [draw], repel_sample).groupBy("set_id").agg(
            F.flatten(F.collect_list("z")).alias("pool"))
        here = z.select("set_id", "point_id", F.col("z").alias("x"))
        there = z.select("set_id", F.col("point_id").alias("nbr_id"), F.col("z").alias("y"))
        pairs = meet(meet(weights, here, ["set_id", "point_id"]), there, ["set_id", "nbr_id"])
        sq = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
        pairs = pairs.withColumn("sq", sq)
        power = F.pow(F.greatest("sq", F.lit(1e-12)), F.lit(b - 1))
        pull = F.col("weight") * (2 * a * b) * power / (1 + a * F.pow("sq", F.lit(b)))
        moved = pairs.withColumn("pull", pull).groupBy("set_id", "point_id").agg(
            F.sum("pull").alias("total"),
            *[F.sum(F.col("pull") * F.get("y", i)).alias(f"t{i}") for i in range(n_components)])
        z = attach(meet(moved, here, ["set_id", "point_id"]), cut(drawn), ["set_id"],
                   row_bytes=8 * n_components * repel_sample, spread=F.col("point_id"))
        z = cut(_push(z, n_components, a, b, rate))
    return z


def _push(moved: DataFrame, k: int, a: float, b: float, rate: float) -> DataFrame:
    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, total, target, pool in zip(pdf["x"], pdf["total"], pdf["target"], pdf["pool"]):
                x, pool = np.asarray(x), np.asarray(pool).reshape(-1, k)
                # Towards the weighted mean of the neighbours, away from the sample.
                toward = (np.asarray(target) / max(total, 1e-12) - x) * (total / (1.0 + total))
                gap = x - pool
                sq = (gap * gap).sum(1)
                force = 2 * b / ((0.1 + sq) * (1 + a * sq ** b))
                away = np.clip((force[:, None] * gap).mean(0), -1, 1)
                out.append(x + rate * (0.5 * toward + 0.1 * away))
            yield pdf[["set_id", "point_id"]].assign(z=out)

    rows = moved.select("set_id", "point_id", "x", "total",
                        F.array(*[f"t{i}" for i in range(k)]).alias("target"), "pool")
    return rows.mapInPandas(move, "set_id long, point_id long, z array<double>")
