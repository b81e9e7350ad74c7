"""Neighbours, forest and clusters against brute force, with copies and skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from one_set import cluster_one_set, numbered, with_copies
from themeloom.operators import skew
from themeloom.operators.density import choose, density_clusters, forest_clusters, worths
from themeloom.operators.exact import _between, exact_forest, largest_gaps, open_edges, outline, span
from themeloom.operators.forest import components, lightest_forest, merge_order, reduced_forest, running_sums, spanning_forest
from themeloom.operators.knn import document_neighbours, knn
from themeloom.operators.points import distinct_points, to_documents
from themeloom.operators.reach import core_distances, mutual_reachability
from themeloom.plans.analyze import Settings, cluster_vectors
from themeloom.session import cut


def blobs(n, groups, spread, seed=3, dim=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim)) * 3
    g = rng.integers(0, groups, n)
    return g, centre[g] + rng.normal(size=(n, dim)) * spread


def frame(spark, x, set_id=0, first=0):
    rows = [(set_id, first + i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "set_id long, doc_id long, vector array<double>")


def brute_neighbours(x, k):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    out = []
    for i in range(len(x)):
        row = d[i].copy()
        row[i] = np.inf
        out.append(list(np.lexsort((np.arange(len(x)), row))[:k]))
    return out


@pytest.mark.parametrize("kw", [{}, {"block": 32, "pivots": 7}])
def test_neighbours_with_a_third_copies(spark, kw):
    _, x = blobs(120, 4, 0.5)
    x = np.vstack([x, np.tile(x[5], (60, 1))])
    v = frame(spark, x)
    p = cut(distinct_points(v, keep=6))
    assert p.agg(F.sum("weight")).head()[0] == len(x)
    got = document_neighbours(v, p, knn(p, 5, **kw), 5).orderBy("doc_id", "rank").collect()
    want = brute_neighbours(x, 5)
    assert [r["nbr_doc"] for r in got] == [j for row in want for j in row]


def test_cells_in_proportion_to_the_set(spark, monkeypatch):
    """Small sets stay one cell while large ones are cut up; both stay exact."""
    from themeloom.operators import knn as module

    monkeypatch.setattr(module, "DIRECT", 50)
    _, x = blobs(150, 5, 0.4, seed=4)
    _, y = blobs(30, 2, 0.4, seed=5)
    v = frame(spark, x).unionByName(frame(spark, y, set_id=7))
    p = cut(distinct_points(v))
    got = knn(p, 4, block=8).orderBy("set_id", "point_id", "rank").collect()
    assert [r["nbr_id"] for r in got if r["set_id"] == 0] == [j for row in brute_neighbours(x, 4) for j in row]
    assert [r["nbr_id"] for r in got if r["set_id"] == 7] == [j for row in brute_neighbours(y, 4) for j in row]


def kruskal(edges, n):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    total, left = 0.0, []
    for w, a, b in sorted(edges):
        p, q = find(a), find(b)
        if p != q:
            up[q] = p
            total += w
            left.append((a, b))
    return total, sorted(left)


def random_graph(spark, n=80, m=200, seed=1):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (m, 2)).tolist() if p[0] != p[1]}
    edges = [(float(w), a, b) for (a, b), w in zip(sorted(pairs), rng.integers(1, 40, len(pairs)))]
    df = spark.createDataFrame([(0, a, b, w) for w, a, b in edges], "set_id long, a long, b long, w double")
    return edges, df


def test_spanning_forest(spark):
    edges, df = random_graph(spark)
    total, picked = kruskal(edges, 80)
    got = spanning_forest(df).collect()
    assert sorted((r["a"], r["b"]) for r in got) == picked
    assert sum(r["w"] for r in got) == total


def test_merge_order_sizes(spark):
    """Sizes along the chains equal the sizes of a one-by-one merge."""
    edges, df = random_graph(spark, seed=5)
    v = spark.range(80).select(F.lit(0).cast("long").alias("set_id"), F.col("id").alias("point_id"),
                               F.lit(1).cast("long").alias("weight"))
    f = merge_order(df, v)
    runs = running_sums(f.chains, ["set_id", "level", "comp"], ["w", "a", "b"], {"upto": "h"})
    got = {(r["a"], r["b"]): r["upto"] for r in runs.collect()}
    member = {i: {i} for i in range(80)}
    want = {}
    for w, a, b in sorted(edges):
        if member[a] is not member[b]:
            joined = member[a] | member[b]
            want[(a, b)] = len(joined)
            for i in joined:
                member[i] = joined
    assert got == want


def test_components(spark):
    edges, df = random_graph(spark, n=100, m=60)
    v = spark.range(100).select(F.lit(0).cast("long").alias("set_id"), F.col("id").alias("point_id"))
    got = {r["point_id"]: r["comp"] for r in components(df, v).collect()}
    up = list(range(100))
    for _ in range(100):
        for _, a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == dict(enumerate(up))


def test_running_sums_split_one_key(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), "id", F.lit(2).alias("v"))
    out = running_sums(df, ["k"], ["id"], {"s": "v"}).orderBy("id").collect()
    assert [r["s"] for r in out] == [2 * (i + 1) for i in range(5000)]


def reach_of(spark, sets, m):
    """Points, reachability edges, cores and sizes of several sets of vectors."""
    v = None
    for s, x in enumerate(sets):
        one = frame(spark, x, set_id=s)
        v = one if v is None else v.unionByName(one)
    p = cut(distinct_points(v))
    sizes = cut(p.select("set_id").distinct().select("set_id", F.lit(m).alias("min_size"), F.lit(m).alias("m")))
    edges = cut(knn(p, m))
    cores = cut(core_distances(edges, p, sizes))
    return p, cut(mutual_reachability(edges, cores)), cores, sizes


def found_clusters(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["set_id"], {})[r["point_id"]] = (r["cluster_id"], round(r["probability"], 9))
    return got


@pytest.mark.parametrize("capacity,place", [(10_000, False), (40, True), (40, False), (1, False)])
def test_blocks_and_rounds_equal_a_one_by_one_merge(spark, capacity, place):
    """Sets with copies, of two densities and of one point alone, all in one run, in blocks of any size."""
    _, x = blobs(150, 5, 0.9, seed=11)
    x = np.vstack([x, np.tile(x[3], (40, 1))])
    _, y = blobs(100, 3, 1.5, seed=12)
    m = 8
    p, reach, cores, sizes = reach_of(spark, [x, y, y[:1]], m)
    at = cores.join(p.select("set_id", "point_id", F.get("vector", F.lit(0)).alias("place")), ["set_id", "point_id"])
    got = found_clusters(forest_clusters(reduced_forest(reach), at if place else cores, sizes, capacity))
    assert got[2] == {r["point_id"]: (-1, 0.0) for r in p.where("set_id = 2").collect()}
    vertices, links = cores.toPandas(), reach.toPandas()
    for s in (0, 1):
        one, e = with_copies(vertices[vertices.set_id == s], links[links.set_id == s], m)
        one = one.sort_values("point_id")
        want = numbered(cluster_one_set(one.point_id.to_numpy(), one.weight.to_numpy(), e.a.to_numpy(), e.b.to_numpy(),
                                        e.w.to_numpy(), m))
        assert len({c for c, _ in want.values() if c >= 0}) > 1
        assert got[s] == want


def test_graph_of_several_parts(spark):
    """Parts that no edge joins hang under a virtual root; small ones are noise."""
    rng = np.random.default_rng(4)
    edges = [(0, i, i + 1, float(w)) for i, w in enumerate(rng.uniform(1, 2, 59)) if i not in (24, 49)]
    points = [(0, i, 1, 0.5) for i in range(60)]
    e = cut(spark.createDataFrame(edges, "set_id long, a long, b long, w double"))
    cores = cut(spark.createDataFrame(points, "set_id long, point_id long, weight long, core double"))
    sizes = spark.createDataFrame([(0, 12)], "set_id long, min_size int")
    pd_e, pd_v = e.toPandas(), cores.toPandas()
    pd_v = pd_v.sort_values("point_id")
    want = numbered(cluster_one_set(*(c.to_numpy() for c in (pd_v.point_id, pd_v.weight, pd_e.a, pd_e.b, pd_e.w)), 12))
    assert {c for c, _ in want.values()} == {-1, 0, 1}
    assert found_clusters(density_clusters(e, cores, sizes))[0] == want
    assert found_clusters(forest_clusters(e, cores, sizes, 7))[0] == want


def brute_forest(x, core, ids=None):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    i, j = np.triu_indices(len(x), 1)
    k = lightest_forest(i, j, w[i, j])
    return sorted(zip(i[k].tolist(), j[k].tolist())), w[i, j][k].sum()


@pytest.mark.parametrize("kw", [{}, {"block": 40}, {"block": 24, "pivots": 7}])
def test_exact_forest_spans_far_groups(spark, kw):
    """The tree is that of all pairs, with many ties, and joins two far groups at their true distance."""
    rng = np.random.default_rng(6)
    x = np.unique(np.round(np.vstack([rng.normal(size=(90, 3)), rng.normal(size=(60, 3)) + 40]), 1), axis=0)
    core = np.round(rng.uniform(0.1, 0.5, len(x)), 1)
    p = cut(frame(spark, x).withColumnRenamed("doc_id", "point_id"))
    cores = cut(spark.createDataFrame([(0, i, float(c)) for i, c in enumerate(core)], "set_id long, point_id long, core double"))
    near = cut(mutual_reachability(knn(p, 4), cores))
    rows = exact_forest(p, cores, near, **kw).collect()
    want, total = brute_forest(x, core)
    assert sorted((r.a, r.b) for r in rows) == want
    assert sum(r.w for r in rows) == pytest.approx(total, abs=1e-9)
    far = x[:, 0] > 20
    gap = np.sqrt(((x[far][:, None] - x[~far][None]) ** 2).sum(2)).min()
    assert max(r.w for r in rows) == pytest.approx(gap, abs=1e-9)


@pytest.mark.parametrize("capacity", [20, 60, 10_000])
def test_forests_of_parts_merge(spark, capacity):
    """Reduced part by part, whether parts shrink or not, the forest is that of all edges."""
    edges, df = random_graph(spark, n=60, m=900, seed=2)
    total, picked = kruskal(edges, 60)
    got = reduced_forest(df, capacity).collect()
    assert sorted((r["a"], r["b"]) for r in got) == picked
    assert sum(r["w"] for r in got) == total
    assert reduced_forest(df.limit(0)).count() == 0


def plain_worths(parent, stability):
    best, below = {}, dict.fromkeys(parent, 0.0)
    for c in sorted(parent, reverse=True):
        best[c] = max(stability[c], below[c])
        if parent[c] is not None:
            below[parent[c]] += best[c]
    return best, below


def as_tree(spark, parent, stability):
    rows = [(0, c, parent[c], float(stability[c]), None, 1.0, None) for c in parent]
    return spark.createDataFrame(rows, "set_id long, cluster long, parent long, stability double, given double, peak double, best double")


@pytest.mark.parametrize("shape", ["random", "deep"])
def test_worths_and_choice_of_any_tree(spark, shape):
    rng = np.random.default_rng(9)
    n = 300
    parent = {0: None, **{i: int(rng.integers(max(0, i - (3 if shape == "deep" else 300)), i)) for i in range(1, n)}}
    stability = {i: float(rng.integers(0, 40)) for i in range(n)}
    want, below = plain_worths(parent, stability)
    tree = as_tree(spark, parent, stability)
    assert {r.cluster: r.best for r in worths(tree).collect()} == want
    kept = {c for c in parent if stability[c] >= below[c]}
    top = {}
    for c in range(n):
        top[c] = (top[parent[c]] if parent[c] is not None else None) or (c + 1 if c in kept else None)
    got = {r.cluster: r.label for r in choose(tree.drop("given")).collect()}
    assert got == {c: t - 1 if t else None for c, t in top.items()}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A tree of 10,000 clusters in one chain with leaves: rounds grow with the logarithm."""
    from themeloom.operators import density

    n = 10_000
    parent = {0: None, **{i: (i - 1 if i % 2 else i - 2) for i in range(1, n)}}
    stability = {i: float(i * 7919 % 97) for i in range(n)}
    calls = []
    with monkeypatch.context() as mp:
        mp.setattr(density, "cut", lambda df, keep=density.cut: calls.append(1) or keep(df))
        got = {r.cluster: r.best for r in worths(as_tree(spark, parent, stability)).collect()}
    assert got == plain_worths(parent, stability)[0]
    assert (len(calls) - 1) / 2 <= 2 * np.log2(n)


def test_no_edges_is_all_noise(spark):
    x = np.random.default_rng(1).normal(size=(1, 3))
    v = frame(spark, x).unionByName(frame(spark, x, set_id=1))
    out = cluster_vectors(v, Settings(method="none")).collect()
    assert sorted((r["set_id"], r["cluster_id"], r["probability"]) for r in out) == [(0, -1, 0.0), (1, -1, 0.0)]


def test_planted_groups_are_found(spark):
    g, x = blobs(200, 4, 0.15)
    out = cluster_vectors(frame(spark, x), Settings(method="none", min_cluster_size=10)).collect()
    got = np.array([r["cluster_id"] for r in sorted(out, key=lambda r: r["doc_id"])])
    assert len(got) == 200
    same = (got[:, None] == got[None]) & (got[:, None] >= 0)
    assert (same == (g[:, None] == g[None])).mean() > 0.95


def test_noise_gives_nothing_strong(spark):
    x = np.random.default_rng(0).normal(size=(120, 16))
    out = cluster_vectors(frame(spark, x), Settings(method="none", min_cluster_size=30)).collect()
    assert sum(r["cluster_id"] >= 0 for r in out) < 60


def test_order_of_rows_does_not_matter(spark):
    _, x = blobs(100, 3, 0.4)
    v = frame(spark, x)
    a = {r["doc_id"]: r["cluster_id"] for r in cluster_vectors(v).collect()}
    b = {r["doc_id"]: r["cluster_id"] for r in cluster_vectors(v.orderBy(F.rand(1)).repartition(5)).collect()}
    assert a == b


def test_salted_join_equals_broadcast(spark, monkeypatch):
    big = spark.range(300).select((F.when(F.col("id") < 200, 1).otherwise(F.col("id"))).alias("k"), "id")
    small = spark.range(250).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = sorted(map(tuple, skew.attach(big, small, ["k"], how=how).collect()), key=str)
        with monkeypatch.context() as m:
            m.setattr(skew, "BROADCAST_BYTES", 64)
            got = sorted(map(tuple, skew.attach(big, small, ["k"], how=how).collect()), key=str)
        assert got == want


def test_copies_get_their_cluster(spark):
    v = frame(spark, np.vstack([np.zeros((10, 3)), np.eye(3)]))
    p = distinct_points(v)
    assert p.count() == 4
    docs = to_documents(v, p, ["weight"])
    assert sorted(r["weight"] for r in docs.collect()) == [1, 1, 1] + [10] * 10


def test_components_of_every_set_by_itself(spark, monkeypatch):
    """Axes are those of the set's own weighted covariance; another set changes nothing."""
    from themeloom.operators import reduce

    monkeypatch.setattr(reduce, "BLOCK", 16)
    _, x = blobs(60, 3, 0.6, seed=21, dim=6)
    _, y = blobs(3, 1, 2.0, seed=22, dim=6)
    x = np.vstack([x, np.tile(x[4], (30, 1))])
    both = cut(distinct_points(frame(spark, x).unionByName(frame(spark, y, set_id=5))))
    alone = {r.point_id: r.z for r in reduce.pca(both.where("set_id = 0"), 4).collect()}
    rows = reduce.pca(both, 4).collect()
    assert all(np.allclose(alone[r.point_id], r.z, atol=1e-12) for r in rows if r.set_id == 0)
    # Projections and variances of the unit vectors, copies counted.
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    value, axis = np.linalg.eigh(np.cov(u.T, bias=True))
    want = u[:60] @ axis[:, ::-1][:, :4]
    got = np.array([alone[i] for i in range(60)])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    weight = F.col("weight").cast("double").alias("weight")
    from themeloom.functions.vectors import unit
    held = both.select("set_id", unit(F.col("vector")).alias("v"), weight)
    spread = {r.set_id: r.variance for r in reduce.principal_axes(held, 4).collect()}
    assert np.allclose(spread[0], value[::-1][:4], atol=1e-9)
    # Three documents have at most three axes.
    small = np.array([r.z for r in rows if r.set_id == 5])
    assert small.shape == (3, 4) and not small[:, 3].any() and small[:, :2].any()


@pytest.mark.parametrize("method", ["pca", "spectral", "layout"])
def test_reductions_keep_groups_apart(spark, method):
    """Nearest neighbours after reduction stay in the group they came from."""
    from themeloom.plans.analyze import reduce_points

    g, x = blobs(90, 3, 0.2, seed=8, dim=8)
    p = cut(distinct_points(frame(spark, x)))
    s = Settings(method=method, n_components=3, n_neighbors=10)
    z = cut(reduce_points(p, s)).orderBy("point_id").collect()
    assert [r["point_id"] for r in z] == list(range(90))
    z = np.array([r["z"] for r in z])
    assert z.shape == (90, 3) and np.isfinite(z).all()
    near = [row[0] for row in brute_neighbours(z, 1)]
    assert (g[near] == g).mean() > 0.95


def _nearest(spark, vectors, k, metric="euclidean"):
    from themeloom.operators.knn import knn

    points = spark.createDataFrame([(0, i, v) for i, v in enumerate(vectors)], "set_id long, point_id long, vector array<double>")
    got = {}
    for r in knn(points, k, metric=metric).collect():
        got.setdefault(r.point_id, {})[r["rank"]] = (r.nbr_id, r.dist)
    return {i: [near[n] for n in sorted(near)] for i, near in got.items()}


def test_ties_go_to_the_smaller_ids(spark):
    one_hot = [[float(i == j) for j in range(40)] for i in range(40)]
    got = _nearest(spark, one_hot, 3)
    assert all([n for n, _ in near] == [j for j in range(4) if j != i][:3] for i, near in got.items())


def test_neighbours_far_from_the_origin(spark):
    got = _nearest(spark, [[1e8 + 0.1 * i * i, 1e8] for i in range(60)], 2)
    for i, near in got.items():
        exact = sorted((abs(0.1 * i * i - 0.1 * j * j), j) for j in range(60) if j != i)[:2]
        assert [n for n, _ in near] == [j for _, j in exact]


def test_zero_vector_has_cosine_distance_one(spark):
    got = _nearest(spark, [[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]], 2, "cosine")
    assert [round(d, 9) for _, d in got[0]] == [1.0, 1.0]


def tree_of(spark, x, core, near, **kw):
    p = cut(frame(spark, x).withColumnRenamed("doc_id", "point_id"))
    cores = cut(spark.createDataFrame([(0, i, float(c)) for i, c in enumerate(core)], "set_id long, point_id long, core double"))
    return sorted((r.a, r.b) for r in exact_forest(p, cores, near(p, cores), **kw).collect())


@pytest.mark.parametrize("known,kw", [(2, {"block": 60, "pivots": 9}), (0, {"block": 60, "pivots": 9, "capacity": 100})])
def test_exact_forest_whatever_is_known(spark, known, kw):
    """Few edges known, or none, ties of a grid, and values far from the origin."""
    rng = np.random.default_rng(8)
    x = np.vstack([np.stack(np.meshgrid(*[np.arange(5)] * 3), -1).reshape(-1, 3), rng.normal(size=(120, 3)) * 3 + 1e5])
    core = np.where(np.arange(len(x)) % 3, 1.0, rng.uniform(0.5, 2, len(x)))
    want, _ = brute_forest(x, core)
    none = spark.createDataFrame([], "set_id long, a long, b long, w double")
    assert tree_of(spark, x, core, lambda p, cores: cut(mutual_reachability(knn(p, known), cores)) if known else none, **kw) == want


def test_bounds_of_a_tree_hold_its_paths():
    """No edge between two points of a tree is left out that is as light as the heaviest on the way."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) + 7.0 * rng.integers(0, 3, 300)[:, None]
    core = rng.uniform(0, 2, 300)
    kin = np.arange(1, 300)
    a, b = rng.integers(0, kin), kin
    w = np.maximum(np.maximum(np.sqrt(((x[a] - x[b]) ** 2).sum(1)), core[a]), core[b])
    most = np.zeros((300, 300))
    for e in range(299):
        most[b[e], :b[e]] = most[:b[e], b[e]] = np.maximum(most[a[e], :b[e]], w[e])
    reach, place, gap = outline(np.arange(300), np.flatnonzero(rng.uniform(size=300) < 0.1), a, b, w)
    table = largest_gaps(gap[~np.isnan(gap)][np.argsort(place[~np.isnan(gap)])])
    i, j = np.triu_indices(300, 1)
    top = np.maximum(np.maximum(reach[i], reach[j]), _between(table, place[i], place[j]))
    assert (top >= most[i, j]).all() and (top == most[i, j]).mean() > 0.5
    pdf = pd.DataFrame({"point_id": np.arange(300), "vec": list(x), "core": core, "reach": reach, "place": place})
    parts = [pdf[pdf.point_id % 2 == k] for k in (0, 1)]
    found = [open_edges(parts[0], parts[1], table), *(open_edges(p, p[:0], table) for p in parts), (a, b, w)]
    a, b, w = (np.concatenate(c) for c in zip(*found))
    kept = lightest_forest(a, b, w)
    want, total = brute_forest(x, core)
    assert sorted(zip(a[kept].tolist(), b[kept].tolist())) == want and w[kept].sum() == pytest.approx(total, abs=1e-9)


def test_points_are_sent_to_few_blocks_of_the_tree(spark, monkeypatch):
    """Rows that tasks of the forest read: not every point with every 256 others."""
    from themeloom.operators import exact

    read, stack = spark.sparkContext.accumulator(0), exact._matrix

    def counted(column):
        read.add(len(column))
        return stack(column)

    monkeypatch.setattr(exact, "_matrix", counted)
    rng = np.random.default_rng(3)
    n = 5000
    x = rng.normal(size=(n, 4)) + 9.0 * rng.integers(0, 3, n)[:, None]
    p = cut(frame(spark, x).withColumnRenamed("doc_id", "point_id"))
    edges = cut(knn(p, 6))
    cores = cut(edges.where("rank = 5").select("set_id", "point_id", F.col("dist").alias("core")))
    rows = exact_forest(p, cores, cut(mutual_reachability(edges, cores))).collect()
    core = np.array([r.core for r in cores.orderBy("point_id").collect()])
    a, b, w = span(np.arange(n), x, core)
    assert sorted((r.a, r.b) for r in rows) == sorted(zip(a.tolist(), b.tolist()))
    assert sum(r.w for r in rows) == pytest.approx(w.sum(), abs=1e-9)
    assert read.value < 5 * n
