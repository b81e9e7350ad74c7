"""Exact spanning forest of the complete reachability graph, across all parts of a set.

A set of few points is one task, which grows its tree point by point.  In a larger one, a spanning tree
of edges that are known - of neighbours, and between *anchors*, a sample of the points - bounds
what can be missing: an edge that is heavier than all edges between its ends on that tree is in no
minimum spanning tree.  Every point has an anchor and a ``reach``, the heaviest edge on its way there;
anchors stand in a line, in the order in which the tree's edges, lightest first, put them side by
side, so that the heaviest edge between two of them is the largest gap between their places.
Blocks of points that stand near in this line are compared pair by pair, by products of matrices;
edges under the bound, few besides those of neighbours, are weighed exactly and reduced in their
task, and the forests are merged (:func:`themeloom.operators.forest.reduced_forest`).  The bounds only
spare work: ties are broken alike everywhere, so the forest is that of all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.forest import CAPACITY, _contract, _lightest, _roots, components, lightest_forest, reduced_forest
from themeloom.operators.knn import BLOCK_VALUES, _matrix
from themeloom.operators.skew import attach, meet
from themeloom.session import cut

# Points of a set whose tree one task grows; anchors that one task joins; points for which there is an anchor.
SMALL = 2048
JOINED = 4096
PER_ANCHOR = 256
# Rows and columns of distances compared at once; edges a task holds before it reduces them.
TILE = (256, 1024)
HELD = 500_000
EDGES = "set_id long, a long, b long, w double"
PAIR = ["set_id", "block_1", "sub_1", "block_2", "sub_2"]


def span(ids: np.ndarray, x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree ``a, b, w`` of mutual reachability among distinct ids, grown point by point.

    Edges are ordered by weight, then smaller, then larger end, so that the tree is unique.
    """
    order = np.argsort(ids)
    x, core, n = x[order], core[order], len(ids)
    ids = ids[order]
    # The first ``left`` rows are outside of the tree; a row that joins gives its place to the last one.
    row = np.arange(n)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    weight = np.full(n, np.inf)
    out_a, out_b, out_w = np.empty(max(0, n - 1), np.int64), np.empty(max(0, n - 1), np.int64), np.empty(max(0, n - 1))
    x, core = x.copy(), core.copy()
    at, left = 0, n
    for k in range(n - 1):
        name, point, own = row[at], x[at].copy(), core[at]
        left -= 1
        for column in (row, x, core, low, high, weight):
            column[at] = column[left]
        gap = x[:left] - point
        w = np.maximum(np.maximum(np.sqrt((gap * gap).sum(1)), core[:left]), own)
        a, b = np.minimum(row[:left], name), np.maximum(row[:left], name)
        tied = w == weight[:left]
        better = (w < weight[:left]) | (tied & ((a < low[:left]) | ((a == low[:left]) & (b < high[:left]))))
        weight[:left][better], low[:left][better], high[:left][better] = w[better], a[better], b[better]
        same = np.flatnonzero(weight[:left] == weight[:left].min())
        at = same[np.lexsort((high[same], low[same]))[0]] if len(same) > 1 else same[0]
        out_a[k], out_b[k], out_w[k] = low[at], high[at], weight[at]
    return ids[out_a], ids[out_b], out_w


def outline(ids: np.ndarray, anchors: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``reach, place, gap`` of sorted ``ids``, whose tree has the edges ``a, b, w``; ``gap`` is null but for anchors.

    ``reach`` is the heaviest edge on the way to the point's anchor, ``place`` the anchor's, ``gap`` the
    heaviest edge between an anchor and the next one in line.
    """
    n = len(ids)
    first, second = np.searchsorted(ids, a).tolist(), np.searchsorted(ids, b).tolist()
    up, loose = list(range(n)), [[i] for i in range(n)]
    head, tail, after = [-1] * n, [-1] * n, [-1] * n
    reach, home, gap = np.zeros(n), np.full(n, -1, np.int64), np.full(n, np.nan)
    for i in np.searchsorted(ids, anchors).tolist():
        head[i] = tail[i] = home[i] = i
        gap[i], loose[i] = 0.0, []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for e in np.argsort(w, kind="stable").tolist():
        p, q = find(first[e]), find(second[e])
        if head[p] < 0 <= head[q] or head[p] < 0 and len(loose[p]) < len(loose[q]):
            p, q = q, p
        if head[q] >= 0:
            after[tail[p]], gap[tail[p]] = head[q], w[e]
            tail[p] = tail[q]
        elif head[p] >= 0:
            reach[loose[q]], home[loose[q]] = w[e], head[p]
        else:
            loose[p] += loose[q]
        loose[q] = []
        up[q] = p
    place, at = np.zeros(n, np.int64), head[find(0)]
    for k in range(len(anchors)):
        place[at], at = k, after[at]
    return reach, place[home], gap


def largest_gaps(gap: np.ndarray) -> np.ndarray:
    """Row k, column i: the largest of the 2**k values from i on, or fewer at the end."""
    rows = [gap]
    while 2 ** len(rows) <= len(gap):
        half = 2 ** (len(rows) - 1)
        rows.append(np.maximum(rows[-1], np.append(rows[-1][half:], np.zeros(half))))
    return np.stack(rows)


def _between(table: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The largest gap between two places of a line."""
    low, high = np.minimum(p, q), np.maximum(p, q)
    k = np.frexp(np.maximum(high - low, 1))[1] - 1
    return np.where(low < high, np.maximum(table[k, low], table[k, np.maximum(high - 2 ** k, 0)]), 0.0)


def _in_line(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    order = np.lexsort((pdf["point_id"].to_numpy(), pdf["place"].to_numpy()))
    return (_matrix(pdf["vec"])[order], *(pdf[c].to_numpy()[order] for c in ("point_id", "core", "reach", "place")))


def open_edges(one: pd.DataFrame, two: pd.DataFrame, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest ``a, b, w`` of those edges between two blocks, or inside one (``two`` is empty), that may be in the set's tree.

    Distances are first compared with bounds by a product of matrices, with what rounding may add; what
    is left is weighed exactly.
    """
    inside = len(two) == 0
    x, id_1, core_1, reach_1, place_1 = _in_line(one)
    y, id_2, core_2, reach_2, place_2 = (x, id_1, core_1, reach_1, place_1) if inside else _in_line(two)
    held, count = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0

    def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, w = (np.concatenate(c) for c in zip(*held))
        kept = lightest_forest(a, b, w)
        return a[kept], b[kept], w[kept]

    for c in range(0, len(y), TILE[1]):
        cols = slice(c, c + TILE[1])
        centre = y[cols].mean(0)
        v, u = y[cols] - centre, x - centre
        norm, own = (v * v).sum(1), (u * u).sum(1)
        kind = np.float32 if max(norm.max(), own.max()) < 1e30 else np.float64
        slack = 4 * (x.shape[1] + 4) * np.finfo(kind).eps * (own + norm.max()) + 1e-35
        # Beyond this, and beyond the members' own reach, no edge of a point and these members can be wanted.
        low, high = np.minimum(place_1, place_2[cols].min()), np.maximum(place_1, place_2[cols].max())
        limit = np.maximum(reach_1, _between(table, low, high)) ** 2 - own + slack
        # Of a block with itself, rows up to the last column are enough.
        last = min(len(x), c + TILE[1]) if inside else len(x)
        u, v = (u * -2.0).astype(kind), np.ascontiguousarray(v.T.astype(kind))
        rest = slack - own
        norm, other, more, limit = (z.astype(kind) for z in (norm, reach_2[cols] ** 2, rest, limit))
        for r in range(0, last, TILE[0]):
            rows = slice(r, min(r + TILE[0], last))
            d = u[rows] @ v
            d += norm
            bound = other + more[rows, None]
            np.maximum(bound, limit[rows, None], out=bound)
            found = np.flatnonzero(d <= bound)
            if not len(found):
                continue
            i, j = np.divmod(found, d.shape[1])
            i, j, about = i + r, j + c, d.ravel()[found]
            # The bound of the two ends themselves; only what may be below it is weighed.
            top = np.maximum(np.maximum(reach_1[i], reach_2[j]), _between(table, place_1[i], place_2[j]))
            near = (about <= top * top + rest[i]) & (core_1[i] <= top) & (core_2[j] <= top)
            if inside:
                near &= i < j
            i, j, top = i[near], j[near], top[near]
            gap = x[i] - y[j]
            w = np.maximum(np.maximum(np.sqrt((gap * gap).sum(1)), core_1[i]), core_2[j])
            i, j, w = i[w <= top], j[w <= top], w[w <= top]
            held.append((np.minimum(id_1[i], id_2[j]), np.maximum(id_1[i], id_2[j]), w))
            count += len(w)
            if count > HELD:
                held = [reduced()]
                count = 0
    return reduced()


def _outlined(ids: DataFrame, tree: DataFrame, anchors: DataFrame) -> DataFrame:
    """``set_id, point_id, reach, place, gap`` of sets of ``ids``, each in one task: :func:`outline`."""
    def run(key: tuple, edges: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        named, chosen = np.sort(marks["point_id"].to_numpy()), np.sort(marks["point_id"][marks["anchor"]].to_numpy())
        if not len(chosen):
            return pd.DataFrame({"set_id": [], "point_id": [], "reach": [], "place": [], "gap": []})
        reach, place, gap = outline(named, chosen, *(edges[c].to_numpy() for c in "abw"))
        return pd.DataFrame({"set_id": np.full(len(named), key[0]), "point_id": named, "reach": reach, "place": place, "gap": gap})

    marks = meet(ids.select("set_id", "point_id"), anchors.withColumn("anchor", F.lit(True)), ["set_id", "point_id"], "left")
    marks = marks.withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    return tree.groupBy("set_id").cogroup(marks.groupBy("set_id")).applyInPandas(
        run, "set_id long, point_id long, reach double, place long, gap double")


def _outlined_by_rounds(ids: DataFrame, tree: DataFrame, anchors: DataFrame) -> DataFrame:
    """The same for sets of any size: components without an anchor take their lightest edge out until they have one.

    That edge is the heaviest on the way to the component it ends in, and no lighter one follows.
    """
    label = cut(ids.select("set_id", "point_id", F.col("point_id").alias("comp"), F.lit(0.0).alias("reach")))
    fixed = anchors.select("set_id", F.col("point_id").alias("comp"))
    rest = cut(tree.select("set_id", F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"))
    while True:
        chosen = cut(meet(_lightest(rest), fixed, ["set_id", "comp"], "left_anti").select("set_id", "comp", "other", "w"))
        if not chosen.limit(1).count():
            break
        up = _roots(chosen.drop("w").unionByName(fixed.withColumn("other", F.col("comp"))))
        step = meet(up, chosen.select("set_id", "comp", "w"), ["set_id", "comp"], "left")
        label = cut(attach(label, step, ["set_id", "comp"], row_bytes=32, spread=F.col("point_id")).select(
            "set_id", "point_id", F.col("up").alias("comp"), F.greatest("reach", F.coalesce("w", F.lit(0.0))).alias("reach")))
        rest = cut(_contract(rest, up))
    line = cut(_outlined(anchors, rest.select("set_id", F.col("ca").alias("a"), F.col("cb").alias("b"), "w"), anchors))
    line = line.select("set_id", F.col("point_id").alias("comp"), "place", "gap")
    return attach(label, line, ["set_id", "comp"], row_bytes=40, spread=F.col("point_id")).select(
        "set_id", "point_id", "reach", "place", F.when(F.col("point_id") == F.col("comp"), F.col("gap")).alias("gap"))


def _first_of_components(ids: DataFrame, forest: DataFrame, large: DataFrame, capacity: int) -> DataFrame:
    """``set_id, point_id``: the smallest point of every component of a forest."""
    def run(key: tuple, edges: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        named = np.sort(held["point_id"].to_numpy())
        first, second = (np.searchsorted(named, edges[c].to_numpy()).tolist() for c in "ab")
        up = list(range(len(named)))
        for p, q in zip(first, second):
            while up[p] != p:
                up[p] = p = up[up[p]]
            while up[q] != q:
                up[q] = q = up[up[q]]
            up[max(p, q)] = min(p, q)
        roots = named[np.array(up) == np.arange(len(named))]
        return pd.DataFrame({"set_id": np.full(len(roots), key[0]), "point_id": roots})

    big, fits = large.where(F.col("n") > capacity).select("set_id"), large.where(F.col("n") <= capacity).select("set_id")
    out = forest.join(fits, "set_id", "left_semi").groupBy("set_id").cogroup(
        ids.join(fits, "set_id", "left_semi").select("set_id", "point_id").groupBy("set_id")).applyInPandas(run, "set_id long, point_id long")
    if big.limit(1).count():
        vertices = cut(ids.join(big, "set_id", "left_semi").select("set_id", "point_id"))
        named = components(forest.join(big, "set_id", "left_semi"), vertices)
        out = out.unionByName(named.select("set_id", F.col("comp").alias("point_id")).distinct())
    return out


def exact_forest(points: DataFrame, cores: DataFrame, near: DataFrame, block: int | None = None,
                 pivots: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``set_id, a, b, w``: the minimum spanning tree of mutual reachability of every set, stored.

    ``points`` has ``set_id, point_id, vector`` with distinct vectors, ``cores`` the points'
    ``core``, ``near`` some edges ``set_id, a, b, w`` of the graph, which only spare work.  The
    tree spans the whole set, however far apart its groups are.  A set of one point has no edges.
    ``block`` sets the rows of a block, ``pivots`` the anchors of a set, about; sets of more than
    ``capacity`` points are outlined by rounds of joins.
    """
    sizes = cut(points.groupBy("set_id").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")))
    small = block or SMALL
    total, dim = sizes.where(F.col("n") > small).agg(F.sum("n"), F.max("dim")).head()
    rows = meet(points.select("set_id", "point_id", F.col("vector").alias("vec")), cores.select("set_id", "point_id", "core"),
                ["set_id", "point_id"])
    if total is not None:
        rows = cut(rows)

    def tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, w = span(pdf["point_id"].to_numpy(), _matrix(pdf["vec"]), pdf["core"].to_numpy())
        return pd.DataFrame({"set_id": np.full(len(a), key[0]), "a": a, "b": b, "w": w})

    few = sizes.where(F.col("n") <= small).select("set_id")
    trees = rows.join(few, "set_id", "left_semi").groupBy("set_id").applyInPandas(tree, EDGES)
    if total is None:
        return cut(trees)
    large = cut(sizes.where(F.col("n") > small))
    many = rows.join(large.select("set_id"), "set_id", "left_semi")
    ids = cut(many.select("set_id", "point_id"))

    # Anchors: a sample, and one point of each component of what is known; joined, all of a set is one tree.
    known = reduced_forest(near.join(large.select("set_id"), "set_id", "left_semi"), capacity)
    wanted = F.lit(pivots) if pivots else F.ceil(F.col("n") / PER_ANCHOR)
    drawn = attach(ids, large.select("set_id", F.ceil(F.col("n") / wanted).alias("every")), ["set_id"], row_bytes=16, spread=F.col("point_id"))
    drawn = drawn.where(F.pmod(F.xxhash64("point_id", "set_id"), F.col("every")) == 0).select("set_id", "point_id")
    anchors = cut(drawn.unionByName(_first_of_components(ids, known, large, capacity)).distinct())
    parts = cut(anchors.groupBy("set_id").agg(F.ceil(F.count("*") / JOINED).cast("int").alias("parts"), F.min("point_id").alias("hub")))
    # The first anchor is in all parts of its set.
    dealt = anchors.join(parts, "set_id").withColumn("part", F.when(
        F.col("point_id") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int"))))
    dealt = meet(rows, dealt.select("set_id", "point_id", F.explode("part").alias("part")), ["set_id", "point_id"])
    between = dealt.groupBy("set_id", "part").applyInPandas(tree, EDGES)
    known = reduced_forest(known.unionByName(between), capacity)

    fits = large.where(F.col("n") <= capacity).select("set_id")
    line = _outlined(*(df.join(fits, "set_id", "left_semi") for df in (ids, known, anchors)))
    big = large.where(F.col("n") > capacity).select("set_id")
    if big.limit(1).count():
        line = line.unionByName(_outlined_by_rounds(*(df.join(big, "set_id", "left_semi") for df in (ids, known, anchors))))
    line = cut(line)

    # Blocks of neighbouring places; a place of many points is dealt by hash.
    held = block or min(max(1, BLOCK_VALUES // 2 // max(dim, 1)), max(SMALL, -(-total // 16)))
    homes = line.groupBy("set_id", "place").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("set_id").orderBy("place")) - F.col("n")
    homes = cut(homes.select("set_id", "place", F.floor(upto / held).cast("int").alias("block"),
                             F.ceil(F.col("n") / held).cast("int").alias("subs")))
    placed = attach(line.drop("gap"), homes, ["set_id", "place"], row_bytes=32, spread=F.col("point_id")).withColumn(
        "sub", F.pmod(F.xxhash64("point_id"), F.col("subs")).cast("int")).drop("subs")
    placed = cut(meet(many, placed, ["set_id", "point_id"]))
    keys = cut(placed.select("set_id", "block", "sub").distinct())
    one, two = (keys.select("set_id", F.col("block").alias(f"block_{i}"), F.col("sub").alias(f"sub_{i}")) for i in (1, 2))
    pairs = cut(one.join(two, "set_id").where("block_1 < block_2 OR block_1 = block_2 AND sub_1 <= sub_2"))
    columns = ["point_id", "vec", "core", "reach", "place"]
    sides = []
    for i, unless in ((1, F.lit(True)), (2, F.expr("block_1 <> block_2 OR sub_1 <> sub_2"))):
        side = placed.withColumnsRenamed({"block": f"block_{i}", "sub": f"sub_{i}"})
        sides.append(attach(side, pairs.where(unless), ["set_id", f"block_{i}", f"sub_{i}"], row_bytes=32, spread=F.col("point_id"))
                     .select(*[F.col(c).alias(f"{c}_{i}") for c in PAIR + columns]).groupBy(*[f"{c}_{i}" for c in PAIR]))
    # As many gaps as there are anchors.
    gaps: dict[int, list[tuple[int, float]]] = {}
    for r in line.where("gap IS NOT NULL").select("set_id", "place", "gap").collect():
        gaps.setdefault(r["set_id"], []).append((r["place"], r["gap"]))
    lines = {s: np.array([g for _, g in sorted(of)]) for s, of in gaps.items()}

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        one, two = (side[[f"{c}_{i}" for c in columns]].set_axis(columns, axis=1) for i, side in ((1, left), (2, right)))
        a, b, w = open_edges(one, two, largest_gaps(lines[key[0]]))
        return pd.DataFrame({"set_id": np.full(len(a), key[0]), "a": a, "b": b, "w": w})

    found = sides[0].cogroup(sides[1]).applyInPandas(compare, EDGES)
    whole = reduced_forest(known.unionByName(found), capacity)
    return cut(trees).unionByName(whole)
