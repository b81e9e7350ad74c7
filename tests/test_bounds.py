"""What must not grow with the points: broadcasts, and the blocks a vector is sent to."""

import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from themeloom.llm import simhash
from themeloom.functions.vectors import unit
from themeloom.operators.knn import document_neighbours, into_blocks, knn, near_members
from themeloom.operators.points import distinct_points
from themeloom.operators.reach import core_distances, mutual_reachability
from themeloom.operators.reduce import fuzzy_weights
from themeloom.operators import skew
from themeloom.operators.skew import attach, fits_broadcast
from themeloom.session import TASK_ROWS, cut, spread


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_with_the_points_are_not_broadcast(spark):
    points = cut(spark.range(300).selectExpr("0L AS set_id", "id AS point_id", "1L AS weight"))
    edges = cut(spark.range(300).selectExpr("0L AS set_id", "id AS point_id", "(id + 1) % 300 AS nbr_id", "1.0D AS dist"))
    m = spark.createDataFrame([(0, 1)], "set_id long, m int")
    cores = cut(core_distances(edges, points, m))
    assert "Broadcast" not in _plan(mutual_reachability(edges, cores))
    assert mutual_reachability(edges, cores).agg(F.count("*"), F.sum("w")).first() == (300, 300.0)


def test_a_broadcast_counts_what_the_driver_holds_of_a_row(spark):
    assert fits_broadcast(spark.range(100_000), 24)
    assert not fits_broadcast(spark.range(200_000), 24)


def test_number_of_blocks_does_not_grow_with_the_points(spark):
    for n in (1_000, 8_000):
        points = cut(spark.range(n).selectExpr("0L AS set_id", "id AS point_id", "array(CAST(id AS DOUBLE), rand(7)) AS vector"))
        subs = into_blocks(points, 8, 2, wide=True).cells.agg(F.sum("subs")).first()[0]
        assert subs <= 20


def test_tasks_over_short_rows_are_bounded(spark):
    table = cut(spark.range(40).coalesce(1))
    assert spread(table, 10 * TASK_ROWS).rdd.getNumPartitions() == 10
    assert spread(table, 10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_layouts_do_not_broadcast_coordinates(spark):
    from themeloom.operators import reduce

    seen = []
    weights = cut(spark.range(60).selectExpr("0L AS set_id", "id AS point_id", "(id + 1) % 60 AS nbr_id", "1.0D AS weight"))
    both = cut(weights.unionByName(weights.selectExpr("set_id", "nbr_id AS point_id", "point_id AS nbr_id", "weight")))

    def watched(df):
        seen.append(_plan(df))
        return cut(df)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(reduce, "cut", watched)
        assert reduce.spectral(both, 2, rounds=4).count() == 60
    joined = [p for p in seen if "s0#" in p]
    assert joined and not any("BroadcastHashJoin" in p for p in joined)


def test_one_row_an_id_whatever_its_texts(spark):
    rows = [(1, "b b b b b"), (1, "a a a a a"), (1, "a a a a a"), (2, "c d e f g"), (3, "c d e f g"), (None, "x"), (None, "x")]
    kept = simhash.one_per_class(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(kept.collect(), key=str) == sorted([(1, "a a a a a"), (2, "c d e f g"), (None, "x"), (None, "x")], key=str)


def test_salted_copies_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 64)
    rows = cut(spark.range(500).selectExpr("id AS k", "id AS v"))
    out = attach(rows, rows.withColumnRenamed("v", "w"), ["k"], row_bytes=16)
    assert "Broadcast" not in _plan(out) and out.where("v = w").count() == 500


def test_two_blocks_are_compared_in_bounded_memory():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(4000, 256)), 2)
    left = pd.DataFrame({"point_id": np.arange(2000), "vec": list(x[:2000]), "bound": [None] * 2000})
    right = pd.DataFrame({"host_id": np.arange(1000, 4000)[::-1], "host_vec": list(x[1000:][::-1])})
    tracemalloc.start()
    point, near, dist = near_members(left, right, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    for i in (0, 999, 1000, 1999):
        d = np.round(np.sqrt(((x[i] - x[1000:]) ** 2).sum(1)), 9)
        want = [j for j in (np.lexsort((np.arange(3000), d)) + 1000).tolist() if j != i][:40]
        assert near[point == i].tolist() == want and np.allclose(dist[point == i], d[np.array(want) - 1000], atol=1e-8)
    close = left.assign(bound=np.where(np.arange(2000) % 2, dist.reshape(2000, 40)[:, 2], np.inf))
    point_2, near_2, _ = near_members(close, right, 40)
    kept = (point % 2 == 0) | (np.arange(len(point)) % 40 < 3)
    assert point_2.tolist() == point[kept].tolist() and near_2.tolist() == near[kept].tolist()


def test_members_are_sent_as_often_as_their_visitors_fill_blocks(spark, monkeypatch):
    """Not once for each home block that has a visitor."""
    from themeloom.operators import knn as module

    taken, stack = spark.sparkContext.accumulator(0), module._matrix

    def counted(column):
        taken.add(len(column))
        return stack(column)

    monkeypatch.setattr(module, "_matrix", counted)
    n = 3000
    points = cut(spark.range(n).selectExpr("0L AS set_id", "id AS point_id", "array(CAST(id AS DOUBLE), 0.5D) AS vector"))
    got = module.knn(points, 2, block=40, pivots=10).orderBy("point_id", "rank").collect()
    assert [r["nbr_id"] for r in got] == [j for i in range(n) for j in sorted(range(max(0, i - 3), min(n, i + 4)), key=lambda j: (abs(i - j), j))[1:3]]
    assert taken.value < 9.5 * n


def test_documents_are_given_neighbours_of_one_search(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(dist):
        read.add(1)
        return dist

    v = cut(spark.range(40).selectExpr("0L AS set_id", "id AS doc_id", "array(CAST(id DIV 2 AS DOUBLE), 1.0D) AS vector"))
    p = cut(distinct_points(v, keep=4))
    edges = cut(knn(p, 3))
    got = document_neighbours(v, p, edges.withColumn("dist", F.udf(seen, "double")("dist")), 3).collect()
    assert len(got) == 120 and read.value == edges.count() == 60


def test_the_length_of_a_vector_is_summed_once(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, None])], "id long, v array<double>")
    made = rows.select("id", unit(F.col("v")).alias("u"))
    assert [r["u"] for r in made.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None, [], [1.0, None]]
    assert not re.search(r"transform\([^)]*lambdafunction\(.*aggregate", _plan(made))


def test_neighbour_weights_scale_every_list_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(nbr):
        read.add(1)
        return nbr

    edges = cut(spark.range(90).selectExpr("0L AS set_id", "id DIV 3 AS point_id", "(id DIV 3 + id % 3 + 1) % 30 AS nbr_id", "1.0D + id % 3 AS dist"))
    got = fuzzy_weights(edges.withColumn("nbr_id", F.udf(seen, "long")("nbr_id"))).collect()
    weight = {(r["point_id"], r["nbr_id"]): r["weight"] for r in got}
    assert len(got) == 180 and all(weight[b, a] == w and 0 < w <= 1 for (a, b), w in weight.items())
    assert read.value == 90
    assert str(_plan(fuzzy_weights(edges))).count("MapInPandas") == 1
