"""Density clusters of one set by merging its edges one after another: what the joins must equal."""

from __future__ import annotations

import numpy as np
import pandas as pd

MIN_DISTANCE = 1e-12


def _keep_stable(parent: np.ndarray, stability: np.ndarray, is_root: np.ndarray) -> np.ndarray:
    """Which clusters to keep; parents come before their children."""
    n = len(parent)
    best = stability.copy()
    below = np.zeros(n)
    kept = np.zeros(n, dtype=bool)
    for c in range(n - 1, -1, -1):
        kept[c] = not is_root[c] and best[c] >= below[c]
        best[c] = best[c] if kept[c] else below[c]
        if parent[c] >= 0:
            below[parent[c]] += best[c]
    covered = np.zeros(n, dtype=bool)
    for c in range(n):
        covered[c] = parent[c] >= 0 and (covered[parent[c]] or kept[parent[c]])
        kept[c] &= not covered[c]
    return kept


def cluster_one_set(vid: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray,
                     w: np.ndarray, m: int) -> pd.DataFrame:
    """Cluster, leaving density and cluster peak of each vertex of one set."""
    n = len(vid)
    ia, ib = np.searchsorted(vid, a), np.searchsorted(vid, b)
    group = np.arange(n)

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    # Merge nodes follow the vertices: node n+j joins two earlier nodes.
    node = list(range(n))
    size = [int(x) for x in weight]
    sides, dens = [], []
    for e in np.lexsort((b, a, w)):
        p, q = find(ia[e]), find(ib[e])
        if p == q:
            continue
        sides.append((node[p], node[q]))
        size.append(size[node[p]] + size[node[q]])
        dens.append(1.0 / max(w[e], MIN_DISTANCE))
        group[q] = p
        node[p] = len(size) - 1
    tops = sorted({node[find(i)] for i in range(n)}, reverse=True)

    parent, birth, mass, peak = [], [], [], []

    def new_cluster(up: int, lam: float) -> int:
        parent.append(up), birth.append(lam), mass.append(0.0), peak.append(0.0)
        return len(parent) - 1

    roots = [t for t in tops if t >= n and size[t] >= m]
    home = np.full(len(size), -1)
    left = np.zeros(len(size))
    inside = np.zeros(len(size), dtype=bool)
    for t in roots:
        home[t], inside[t] = new_cluster(-1, 0.0), True
    for i in range(len(size) - 1, n - 1, -1):
        x, y = sides[i - n]
        c, lam = home[i], dens[i - n]
        if not inside[i]:
            home[x] = home[y] = c
            left[x] = left[y] = left[i]
            continue
        on = [s for s in (x, y) if s >= n and size[s] >= m]
        off = [s for s in (x, y) if s not in on]
        gone = size[i] if len(on) != 1 else size[off[0]]
        mass[c] += gone * (lam - birth[c])
        peak[c] = max(peak[c], lam)
        for s in off:
            home[s], left[s] = c, lam
        for s in on:
            home[s] = c if len(on) == 1 else new_cluster(c, lam)
            inside[s] = True

    single = len(tops) == 1
    is_root = np.array([single and p < 0 for p in parent], dtype=bool)
    par = np.array(parent, dtype=int)
    kept = _keep_stable(par, np.array(mass), is_root) if parent else np.zeros(0, dtype=bool)
    label = np.full(len(parent), -1)
    for c in range(len(parent)):
        label[c] = c if kept[c] else (label[par[c]] if par[c] >= 0 else -1)
    own = np.where(home[:n] >= 0, label[home[:n]], -1) if len(label) else np.full(n, -1)
    top = np.array(peak + [0.0])[own]
    return pd.DataFrame({"point_id": vid, "cluster": own, "lam": left[:n], "death": top})


def with_copies(vertices: pd.DataFrame, edges: pd.DataFrame, m: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """A point of at least ``m`` copies gets an empty partner at its core distance: below that its copies are apart."""
    heavy = vertices[vertices.weight >= m]
    partners = heavy.assign(point_id=-heavy.point_id - 1, weight=0)
    links = pd.DataFrame({"a": -heavy.point_id - 1, "b": heavy.point_id, "w": heavy.core})
    return pd.concat([vertices, partners], ignore_index=True), pd.concat([edges[["a", "b", "w"]], links], ignore_index=True)


def numbered(want: pd.DataFrame) -> dict:
    """Cluster, numbered by smallest point, and probability of every point."""
    want = want[want.point_id >= 0]
    first = want[want.cluster >= 0].groupby("cluster").point_id.min().sort_values()
    name = {c: i for i, c in enumerate(first.index)}
    return {r.point_id: ((name[r.cluster], round(min(r.lam, r.death) / r.death, 9)) if r.cluster >= 0 else (-1, 0.0))
            for r in want.itertuples()}
