"""Density clustering: condensed tree, stability selection, membership.

Edges of mutual reachability become a spanning forest, its merge order a tree of
clusters of at least the minimum size, and the clusters with the most mass above
their birth are kept.  Parts of the forest that no edge joins hang under a
virtual root at density zero, which like a single root is never a cluster.

Sets of every size take the same way: blocks of points settle what is theirs whatever
the rest of the forest is (:mod:`themeloom.operators.contract`), and what they leave takes
rounds of joins (:mod:`themeloom.operators.forest`), all sets of a run together.  A
point without edges is noise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.contract import MIN_DISTANCE, SCHEMA, contract
from themeloom.operators.forest import merge_order, reduced_forest, running_sums
from themeloom.operators.skew import attach, fits_broadcast, meet
from themeloom.session import cut

# Points a block holds at most.
CAPACITY = 200_000


# -- the tree --------------------------------------------------------------------

def _chase(df: DataFrame, keys: list[str], nxt: list[str], value: str) -> DataFrame:
    """Give every key the value of the first key along ``nxt`` that has one."""
    cur = cut(df.select(*keys, *nxt, value))
    while cur.where(F.col(value).isNull() & F.col(nxt[-1]).isNotNull()).limit(1).count():
        ahead = cur.select(F.col(keys[0]), *[F.col(k).alias(n) for k, n in zip(keys[1:], nxt)],
                           *[F.col(n).alias(f"_{n}") for n in nxt], F.col(value).alias("_value"))
        step = attach(cur, ahead, [keys[0], *nxt], how="left", row_bytes=96,
                      spread=F.struct(*keys))
        cur = cut(step.select(*keys, *[F.when(F.col(value).isNull(), F.col(f"_{n}")).alias(n) for n in nxt],
                              F.coalesce(value, "_value").alias(value)))
    return cur.select(*keys, value)


def _open_tree(vertices: DataFrame, edges: DataFrame, sizes: DataFrame, grown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters above what blocks have settled, and where the blocks' vertices leave.

    ``grown`` has ``set_id, point_id, more, peak``: of vertices that are clusters already, the mass
    beyond that of leaving at once, and their density.  Returns ``set_id, cluster, parent, mass, size,
    birth, peak`` and ``set_id, point_id, cluster, lam``.
    """
    forest = merge_order(edges, vertices)
    lam = 1.0 / F.greatest(F.col("w"), F.lit(MIN_DISTANCE))
    chain = ["set_id", "level", "comp"]
    least = sizes.select("set_id", "min_size")

    # Sizes along each chain, and which edges really split a cluster.
    runs = running_sums(forest.chains, chain, ["w", "a", "b"], {"upto": "h"})
    runs = attach(runs, least, ["set_id"], row_bytes=16)
    m = F.col("min_size")
    lowest = F.col("y").isNotNull()
    hung_on = F.col("x_level") > 0
    x_on = hung_on & (F.col("hx") >= m)
    under = F.col("upto") - F.col("h")
    other_on = F.when(lowest, hung_on & (F.col("hy") >= m)).otherwise(under >= m)
    other = F.when(lowest, F.col("hy")).otherwise(under)
    runs = runs.where(F.col("upto") >= m).withColumns({
        "splits": (x_on & other_on).cast("int"), "lam": lam,
        "gone": F.when(x_on == other_on, F.col("upto")).when(x_on, other).otherwise(F.col("hx"))})
    runs = cut(running_sums(runs, chain, ["w", "a", "b"], {"seg": "splits"}))

    # Segments of chains between splits; a segment is part of one cluster.
    segs = runs.groupBy(*chain, "seg").agg(
        F.sum("gone").alias("size"), F.sum(F.col("gone") * F.col("lam")).alias("mass"),
        F.max("lam").alias("peak"), F.max("splits").alias("split_end"),
        F.min(F.struct("w", "a", "b")).alias("low"))
    next_split = segs.where("split_end = 1").select(
        *chain, (F.col("seg") - 1).alias("seg"), F.col("low.w").alias("w"), F.lit(True).alias("in_chain"))
    segs = meet(segs.drop("split_end", "low"), next_split, [*chain, "seg"], "left")
    # The top segment of a chain continues at the component's edge out.
    where = runs.select("set_id", "w", "a", "b", F.col("level").alias("up_level"),
                        F.col("comp").alias("up_comp"), F.col("seg").alias("up_seg"), "splits")
    outs = meet(forest.links.select(*chain, "w", "a", "b"), where, ["set_id", "w", "a", "b"])
    outs = outs.select(*chain, F.col("w").alias("out_w"), "up_level", "up_comp", "up_seg",
                       (F.col("splits") == 1).alias("out_splits"))
    segs = meet(segs, outs, chain, "left")
    inner = F.col("in_chain").isNotNull()
    born = inner | F.col("out_splits") | F.col("out_w").isNull()
    name = F.struct("level", "comp", "seg")
    up = (F.when(inner, F.struct("level", "comp", (F.col("seg") + 1).alias("seg")))
           .when(F.col("out_w").isNotNull(), F.struct(F.col("up_level").alias("level"),
                                                      F.col("up_comp").alias("comp"),
                                                      F.col("up_seg").alias("seg"))))
    edge = F.when(inner, F.col("w")).otherwise(F.col("out_w"))
    birth = F.when(edge.isNotNull(), 1.0 / F.greatest(edge, F.lit(MIN_DISTANCE)))
    segs = cut(segs.select("set_id", name.alias("part"), up.alias("up"), "size", "mass", "peak",
                           F.coalesce(born, F.lit(True)).alias("born"),
                           F.coalesce(birth, F.lit(0.0)).alias("birth")))
    owner = _chase(segs.withColumn("cluster", F.when(F.col("born"), F.col("part"))),
                   ["set_id", "part"], ["up"], "cluster")
    owned = meet(segs, owner, ["set_id", "part"])
    totals = owned.groupBy("set_id", "cluster").agg(
        F.sum("mass").alias("mass"), F.sum("size").alias("size"), F.max("peak").alias("peak"))
    heads = owned.where("born").select("set_id", "cluster", "birth", "up")
    parents = owner.select("set_id", F.col("part").alias("up"), F.col("cluster").alias("parent"))
    tree = meet(meet(heads, totals, ["set_id", "cluster"]), parents, ["set_id", "up"], "left").drop("up")

    # The edge at which each vertex leaves: first on its way up with enough below.
    first = runs.groupBy(*chain).agg(F.min(F.struct("w", "a", "b", "seg", "lam")).alias("e"))
    own = runs.select("set_id", "w", "a", "b", "level", "comp", "seg", "lam")
    exit_ = F.struct(F.struct("level", "comp", "seg").alias("part"), "lam")
    at_edge = own.select("set_id", "w", "a", "b", exit_.alias("exit"))
    at_chain = first.select(*chain, F.col("e.seg").alias("seg"), F.col("e.lam").alias("lam")).select(
        *chain, exit_.alias("chain_exit"))
    edge_key = ["set_id", "w", "a", "b"]
    on = forest.chains.select(*edge_key, F.col("level").alias("on_level"), F.col("comp").alias("on_comp"))
    ways = meet(meet(forest.links, at_edge, edge_key, "left"), on, edge_key)
    at_on = at_chain.select("set_id", F.col("level").alias("on_level"), F.col("comp").alias("on_comp"),
                            "chain_exit")
    ways = meet(ways, at_on, ["set_id", "on_level", "on_comp"], "left")
    ways = ways.select(*chain, "on_level", "on_comp", F.coalesce("exit", "chain_exit").alias("exit"))
    exits = _chase(ways, chain, ["on_level", "on_comp"], "exit").where("level = 0")
    left = exits.select("set_id", F.col("comp").alias("point_id"), F.col("exit.part").alias("part"),
                        F.col("exit.lam").alias("lam"))
    flat = cut(owner.select("set_id", "part", "cluster"))
    found = cut(attach(left, flat, ["set_id", "part"], how="left", row_bytes=96, spread=F.col("point_id")).select(
        "set_id", "point_id", "cluster", "lam"))
    more = meet(grown, found, ["set_id", "point_id"]).groupBy("set_id", "cluster").agg(
        F.sum("more").alias("more"), F.max("peak").alias("own_peak"))
    tree = meet(tree, more, ["set_id", "cluster"], "left")
    return cut(tree.select("set_id", "cluster", "parent", "birth", "size",
                           (F.col("mass") + F.coalesce("more", F.lit(0.0))).alias("mass"),
                           F.greatest("peak", "own_peak").alias("peak"))), found


def worths(tree: DataFrame) -> DataFrame:
    """``set_id, cluster, best``: the most that a cluster or those below it are worth, in O(log n) rounds.

    ``tree`` has ``set_id, cluster, parent, stability`` and ``given``, the worth of children that are not
    rows of it; a cluster with null stability is never worth anything itself.  A cluster is worth the
    larger of its stability and its children's sum.  A round settles those without unsettled
    children; one with a single unsettled child is a function max(s, x + c) of what that child is
    worth, and functions along a chain are put together two by two, so chains of any length take
    as many rounds as doubling takes.
    """
    low = F.lit(float("-inf"))
    state = cut(tree.select("set_id", "cluster", "parent", F.coalesce("stability", low).alias("s"),
                            F.coalesce("given", F.lit(0.0)).alias("c"), F.lit(None).cast(tree.schema["cluster"].dataType).alias("down"),
                            F.lit(False).alias("chained"), F.lit(None).cast("double").alias("best")))
    while state.where("best is null").limit(1).count():
        kids = state.where("parent is not null").groupBy("set_id", F.col("parent").alias("cluster")).agg(
            F.count_if(F.col("best").isNull()).alias("open"), F.sum("best").alias("got"),
            F.min(F.when(F.col("best").isNull(), F.col("cluster"))).alias("only"))
        seen = meet(state, kids, ["set_id", "cluster"], "left")
        fresh = F.col("best").isNull() & ~F.col("chained")
        total = F.col("c") + F.coalesce("got", F.lit(0.0))
        chain, leaf = fresh & (F.col("open") == 1), fresh & (F.coalesce("open", F.lit(0)) == 0)
        now = cut(seen.select(
            "set_id", "cluster", "parent", "s", F.when(chain, total).otherwise(F.col("c")).alias("c"),
            F.when(chain, F.col("only")).otherwise(F.col("down")).alias("down"), (F.col("chained") | chain).alias("chained"),
            F.when(leaf, F.greatest("s", total)).otherwise(F.col("best")).alias("best")))
        ahead = now.select("set_id", F.col("cluster").alias("down"), F.col("s").alias("s2"), F.col("c").alias("c2"),
                           F.col("down").alias("down2"), F.col("chained").alias("chained2"), F.col("best").alias("best2"))
        step = meet(now, ahead, ["set_id", "down"], "left")
        waits = F.col("best").isNull() & F.col("chained")
        joined = waits & F.col("best2").isNull() & F.col("chained2")
        state = cut(step.select(
            "set_id", "cluster", "parent",
            F.when(joined, F.greatest("s", F.col("s2") + F.col("c"))).otherwise(F.col("s")).alias("s"),
            F.when(joined, F.col("c") + F.col("c2")).otherwise(F.col("c")).alias("c"),
            F.when(joined, F.col("down2")).otherwise(F.col("down")).alias("down"), "chained",
            F.when(waits & F.col("best2").isNotNull(), F.greatest("s", F.col("best2") + F.col("c")))
             .otherwise(F.col("best")).alias("best")))
    return state.select("set_id", "cluster", "best")


def choose(tree: DataFrame) -> DataFrame:
    """``set_id, cluster, label, death`` of every row of ``tree``: the topmost kept cluster above it, and that one's density.

    ``tree`` has ``set_id, cluster, parent, stability, peak`` and ``best``, known for some.  A cluster is kept if
    its stability is not below its children's worth together.
    """
    known = tree.where("best is not null")
    # What is settled counts as given to its parent.
    gifts = known.groupBy("set_id", F.col("parent").alias("cluster")).agg(F.sum("best").alias("given"))
    rest = meet(tree.where("best is null").drop("best"), gifts, ["set_id", "cluster"], "left")
    best = cut(known.select("set_id", "cluster", "best").unionByName(worths(rest)))
    below = meet(tree.select("set_id", "cluster", "parent"), best, ["set_id", "cluster"]).groupBy(
        "set_id", F.col("parent").alias("cluster")).agg(F.sum("best").alias("below"))
    full = meet(tree, below, ["set_id", "cluster"], "left")
    kept = F.col("stability") >= F.coalesce("below", F.lit(0.0))
    # The topmost kept one on the way up: each looks twice as far in every round.
    now = cut(full.select("set_id", "cluster", "parent", F.when(kept, F.struct("cluster", "peak")).alias("label")))
    while now.where("parent is not null").limit(1).count():
        ahead = now.select("set_id", F.col("cluster").alias("parent"), F.col("parent").alias("further"), F.col("label").alias("above"))
        now = cut(meet(now, ahead, ["set_id", "parent"], "left").select(
            "set_id", "cluster", F.col("further").alias("parent"), F.coalesce("above", "label").alias("label")))
    return now.select("set_id", "cluster", F.col("label.cluster").alias("label"), F.col("label.peak").alias("death"))


# -- blocks and what they leave -----------------------------------------------------

def in_blocks(points: DataFrame, edges: DataFrame, sizes: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """``points`` and ``edges`` with ``block``; an edge between blocks is in both.

    ``sizes`` has ``set_id, n``.  Points of a set stand in the order of ``place``, where they have one,
    and go to blocks of ``capacity``, so that near points share a block.
    """
    order = ["place", "point_id"] if "place" in points.columns else ["point_id"]
    if sizes.where(F.col("n") > capacity).limit(1).count():
        ranked = running_sums(points.withColumn("_one", F.lit(1)), ["set_id"], order, {"_nth": "_one"})
        points = cut(ranked.withColumn("block", F.floor((F.col("_nth") - 1) / capacity).cast("int")).drop("_nth", "_one"))
        of = points.select("set_id", F.col("point_id"), F.col("block"))
        for end in ("a", "b"):
            edges = meet(edges, of.select("set_id", F.col("point_id").alias(end), F.col("block").alias(f"block_{end}")),
                         ["set_id", end])
        edges = edges.withColumn("block", F.explode(F.array_distinct(F.array("block_a", "block_b"))))
        return points, edges.select("set_id", "block", "a", "b", "w")
    return points.withColumn("block", F.lit(0)), edges.select("set_id", F.lit(0).alias("block"), "a", "b", "w")


def settled(points: DataFrame, edges: DataFrame, sizes: DataFrame, capacity: int) -> DataFrame:
    """What blocks settle by themselves, stored: rows of :data:`themeloom.operators.contract.SCHEMA`."""
    held, links = in_blocks(points, edges, sizes, capacity)
    held = attach(held, sizes.select("set_id", "min_size", "single"), ["set_id"], row_bytes=24, spread=F.col("point_id"))
    held = held.select("set_id", "block", "point_id", "weight", "core", "min_size", "single")

    def run(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one):
            return pd.DataFrame(columns=[f.split()[0] for f in SCHEMA.split(", ")])
        out = contract(*(one[c].to_numpy() for c in ("point_id", "weight", "core")), int(one["min_size"].iloc[0]),
                       bool(one["single"].iloc[0]), *(two[c].to_numpy() for c in "abw"))
        out.insert(0, "set_id", key[0])
        return out

    return cut(held.groupBy("set_id", "block").cogroup(links.groupBy("set_id", "block")).applyInPandas(run, SCHEMA))


def leave_points(points: DataFrame, edges: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``set_id, point_id, label, lam, death``: chosen cluster (null: none) of every point, and densities.

    ``points`` has ``set_id, point_id, weight, core``, ``edges`` the forest, ``sizes`` ``min_size`` per set.
    """
    n = points.groupBy("set_id").agg(F.count("*").alias("n"))
    e = edges.groupBy("set_id").agg(F.count("*").alias("e"))
    sizes = cut(sizes.select("set_id", "min_size").join(n, "set_id").join(e, "set_id", "left").withColumn(
        "single", F.col("n") - F.coalesce("e", F.lit(0)) == 1))
    found = settled(points, edges, sizes, capacity)
    each = found.where("kind = 'point'")
    name = F.when(F.col("cluster").isNotNull(), F.struct(F.lit(-1).alias("level"), F.col("cluster").alias("comp"),
                                                         F.col("nth").alias("seg")))
    up = F.when(F.col("up").isNotNull(), F.struct(F.lit(-1).alias("level"), F.col("up").alias("comp"), F.col("up_nth").alias("seg")))
    done = each.where("rep is null").select("set_id", "point_id", up.alias("label"), "lam", F.col("peak").alias("death"))
    if not found.where("kind = 'vertex'").limit(1).count():
        return done
    # What is left: one vertex a component, unsettled edges in blocks and edges between blocks.
    tops = found.where("kind = 'vertex'").select("set_id", F.col("rep").alias("point_id"), F.col("size").alias("weight"),
                                                 name.alias("name"), "w", "mass", "peak")
    tops = cut(tops)
    reps = cut(each.where("rep is not null").select("set_id", "point_id", "rep", name.alias("cluster"), "lam"))
    ends = [reps.select("set_id", F.col("point_id").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab"]
    rest = meet(meet(edges.select("set_id", "a", "b", "w"), ends[0], ["set_id", "a"]), ends[1], ["set_id", "b"])
    rest = rest.where("rep_a <> rep_b").select("set_id", F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), "w")
    # A vertex that is a cluster already gets an empty partner at its heaviest edge: below that its points are apart.
    grown = tops.where("name is not null")
    partner = -F.col("point_id") - 1
    vertices = tops.select("set_id", "point_id", "weight").unionByName(
        grown.select("set_id", partner.alias("point_id"), F.lit(0).cast("long").alias("weight")))
    rest = rest.unionByName(grown.select("set_id", partner.alias("a"), F.col("point_id").alias("b"), "w"))
    at_once = F.col("weight") / F.greatest(F.col("w"), F.lit(MIN_DISTANCE))
    extra = grown.select("set_id", "point_id", (F.col("mass") - at_once).alias("more"), "peak")
    tree, leaves = _open_tree(cut(vertices), cut(rest), sizes, extra)
    # An open component's cluster is the one its vertex is in from there on.
    alias = cut(meet(grown.select("set_id", "name", "point_id"), leaves, ["set_id", "point_id"]).select(
        "set_id", "name", F.col("cluster").alias("real")))
    tree = attach(tree, sizes.select("set_id", "single"), ["set_id"], row_bytes=16)
    root = F.col("single") & F.col("parent").isNull()
    tree = tree.select("set_id", "cluster", "parent", "peak", F.when(~root, F.col("mass") - F.col("birth") * F.col("size")).alias("stability"),
                       F.lit(None).cast("double").alias("best"))

    def renamed(rows: DataFrame, column: str) -> DataFrame:
        to = alias.select("set_id", F.col("name").alias(column), "real")
        return meet(rows, to, ["set_id", column], "left").withColumn(column, F.coalesce("real", column)).drop("real")

    small = found.where("kind = 'cluster'").select("set_id", name.alias("cluster"), up.alias("parent"), "peak", "stability", "best")
    chosen = choose(cut(tree.unionByName(renamed(small, "parent"))))
    late = leaves.select("set_id", F.col("point_id").alias("rep"), F.col("cluster").alias("late"), F.col("lam").alias("late_lam"))
    rows = meet(renamed(reps, "cluster"), late, ["set_id", "rep"], "left").select(
        "set_id", "point_id", F.coalesce("cluster", "late").alias("cluster"),
        F.when(F.col("cluster").isNull(), F.col("late_lam")).otherwise(F.col("lam")).alias("lam"))
    rows = meet(rows, chosen, ["set_id", "cluster"], "left").select("set_id", "point_id", "label", "lam", "death")
    return done.unionByName(rows)


# -- entry ---------------------------------------------------------------------------------

def density_clusters(edges: DataFrame, cores: DataFrame, sizes: DataFrame) -> DataFrame:
    """Clusters of a graph ``set_id, a, b, w``, as :func:`forest_clusters` has them."""
    return forest_clusters(reduced_forest(edges), cores, sizes)


def forest_clusters(forest: DataFrame, cores: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``set_id, point_id, cluster_id, probability``; -1 is noise.

    ``forest`` are the edges ``set_id, a, b, w`` of a spanning forest; ``cores`` are ``set_id,
    point_id, weight, core`` and may have ``place``, by which near points stand near;
    ``sizes`` give ``min_size`` per set.  Clusters are numbered from 0 in the order of their
    smallest point.
    """
    raw = leave_points(cores, forest, sizes, capacity)
    raw = cut(raw.select("set_id", "point_id", F.when(F.col("label").isNull(), F.lit(-1)).otherwise(F.xxhash64("label")).alias("cluster"),
                         F.coalesce("lam", F.lit(0.0)).alias("lam"), F.coalesce("death", F.lit(0.0)).alias("death")))
    names = cut(raw.where("cluster <> -1").groupBy("set_id", "cluster").agg(F.min("point_id").alias("first")))
    if fits_broadcast(names, 64):
        nth = F.row_number().over(Window.partitionBy("set_id").orderBy("first"))
        ids = names.withColumn("nth", nth)
    else:
        ids = running_sums(names.withColumn("one", F.lit(1)), ["set_id"], ["first"], {"nth": "one"})
    ids = ids.select("set_id", "cluster", (F.col("nth") - 1).cast("long").alias("cluster_id"))
    out = attach(raw, ids, ["set_id", "cluster"], how="left", row_bytes=40, spread=F.col("point_id"))
    share = F.least("lam", "death") / F.col("death")
    return out.select("set_id", "point_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"),
                      F.when(F.col("cluster") == -1, F.lit(0.0))
                       .otherwise(F.coalesce(share, F.lit(1.0))).alias("probability"))
