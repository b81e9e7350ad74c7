"""Contraction of a spanning forest, part by part: what can be settled inside a block of points.

Edges of a block are merged from the lightest on.  A component stays *closed* until the lightest
edge that leaves it would be next: an edge to another block, or to an open component.  Merges of
closed components are those of the whole forest, whatever the rest of it is, so their clusters,
masses and the densities at which points leave are final.  A tree that lies in its block wholly
is finished there, with its choice of clusters; of other trees one vertex a component is left,
with its size, and goes on to the rounds over all blocks (:mod:`themeloom.operators.density`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd

MIN_DISTANCE = 1e-12

SCHEMA = ("set_id long, kind string, point_id long, a long, b long, w double, cluster long, nth long, up long, "
          "up_nth long, rep long, size long, mass double, peak double, best double, stability double, lam double")


class Clusters:
    """Clusters of one block while they grow; children stand before their parents."""

    def __init__(self):
        self.name, self.up, self.birth, self.mass, self.size, self.peak = [], [], [], [], [], []

    def begin(self, name: int, size: int, lam: float) -> int:
        self.name.append(name)
        self.up.append(-1)
        self.birth.append(0.0)
        self.mass.append(size * lam)
        self.size.append(size)
        self.peak.append(lam)
        return len(self.name) - 1


def contract(ids: np.ndarray, weight: np.ndarray, core: np.ndarray, least: int, single: bool, a: np.ndarray,
             b: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    """Rows of ``SCHEMA`` without ``set_id`` for one block of one set.

    ``kind`` is "point" (cluster ``cluster, nth`` and density ``lam`` at which it leaves, null while open;
    ``rep``, its component's vertex, null in finished trees; in these ``up, up_nth`` name the chosen
    cluster and ``peak`` its density), "cluster" (one that ends where it joins another: ``up, up_nth`` that one,
    ``best`` the most that it and those in it are worth), "vertex" (an open component: ``size``,
    and if it is a cluster already ``w``, its heaviest edge, ``mass`` and ``peak``) or "edge" (unsettled).

    An edge belongs to the block if one of its ends does.  A point with ``least`` copies or more is a
    cluster by itself below its core distance.
    """
    order = np.argsort(ids)
    ids, weight, core = ids[order], weight[order].tolist(), core[order]
    n = len(ids)

    def places(end: np.ndarray) -> list[int]:
        at = np.searchsorted(ids, end)
        return np.where(ids[np.minimum(at, n - 1)] == end, at, -1).tolist()

    first, second = places(a), places(b)
    up, size, open_ = list(range(n)), weight, [False] * n
    cl, loose, top = [-1] * n, [[i] for i in range(n)], [0.0] * n
    home, left = [-1] * n, [0.0] * n
    made = Clusters()
    for i in range(n):
        if weight[i] >= least:
            lam = 1.0 / max(core[i], MIN_DISTANCE)
            home[i] = cl[i] = made.begin(int(ids[i]), weight[i], lam)
            left[i], top[i], loose[i] = lam, float(core[i]), []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    unsettled = []
    for e in np.lexsort((b, a, w)).tolist():
        p, q = first[e], second[e]
        if p < 0 or q < 0:
            open_[find(max(p, q))] = True
            continue
        p, q = find(p), find(q)
        if open_[p] or open_[q]:
            open_[p] = open_[q] = True
            unsettled.append(e)
            continue
        lam, total, x, y = 1.0 / max(w[e], MIN_DISTANCE), size[p] + size[q], cl[p], cl[q]
        members: list[int] = []
        if x >= 0 and y >= 0 or x < 0 and y < 0 and total >= least:
            c = made.begin(int(min(ids[p], ids[q])), total, lam)
            for k in (x, y):
                if k >= 0:
                    made.up[k], made.birth[k] = c, lam
            gone = loose[p] + loose[q]
        elif x >= 0 or y >= 0:
            c, light = (x, q) if x >= 0 else (y, p)
            made.mass[c] += size[light] * lam
            made.size[c] += size[light]
            gone = loose[light]
        else:
            c, gone = -1, []
            members = loose[p] + loose[q] if len(loose[p]) > len(loose[q]) else loose[q] + loose[p]
        for i in gone:
            home[i], left[i] = c, lam
        # The smaller place names the component, so its smallest point does.
        p, q = min(p, q), max(p, q)
        up[q], size[p], cl[p], loose[p], top[p] = p, total, c, members, float(w[e])

    roots = [find(i) for i in range(n)]
    worth, below, topmost = [0.0] * len(made.name), [0.0] * len(made.name), [-1] * len(made.name)
    going = {cl[r] for r in set(roots) if open_[r] and cl[r] >= 0}
    stability = [m - f * s for m, f, s in zip(made.mass, made.birth, made.size)]
    kept = [False] * len(made.name)
    for c in range(len(made.name)):
        if c not in going:
            root = single and made.up[c] < 0
            kept[c] = not root and stability[c] >= below[c]
            worth[c] = stability[c] if kept[c] else below[c]
            if made.up[c] >= 0:
                below[made.up[c]] += worth[c]
    for c in range(len(made.name) - 1, -1, -1):
        above = topmost[made.up[c]] if made.up[c] >= 0 else -1
        topmost[c] = above if above >= 0 else c if kept[c] else -1
    rows = []

    def add(kind: str, **values) -> None:
        rows.append({"kind": kind, **values})

    for i, r in enumerate(roots):
        c = home[i]
        values = {"cluster": made.name[c], "nth": c, "lam": left[i]} if c >= 0 else {}
        if open_[r]:
            values["rep"] = int(ids[r])
        elif c >= 0 and topmost[c] >= 0:
            t = topmost[c]
            values |= {"up": made.name[t], "up_nth": t, "peak": made.peak[t]}
        add("point", point_id=int(ids[i]), **values)
    for r in sorted(set(roots)):
        if open_[r]:
            c = cl[r]
            held = {"cluster": made.name[c], "nth": c, "w": top[r], "mass": made.mass[c], "peak": made.peak[c]} if c >= 0 else {}
            add("vertex", rep=int(ids[r]), size=size[r], **held)
    for c, name in enumerate(made.name):
        u = made.up[c]
        if u >= 0 and open_[find(int(np.searchsorted(ids, name)))]:
            add("cluster", cluster=name, nth=c, up=made.name[u], up_nth=u, peak=made.peak[c], best=worth[c],
                stability=stability[c])
    for e in unsettled:
        add("edge", a=int(a[e]), b=int(b[e]), w=float(w[e]))
    fields = [f.split() for f in SCHEMA.split(", ")[1:]]
    out = pd.DataFrame(rows, columns=[f[0] for f in fields])
    for name, kind in fields:
        if kind != "string":
            out[name] = out[name].astype("Int64" if kind == "long" else "float64")
    return out
