"""The mix against a plain version, its targets, its order in time, and awkward tables."""

import hashlib
from collections import defaultdict

import pytest
from check import SF, compare, oracle_rows
from helpers import EXTRA, WORD, documents, frame, prose
from pyspark.sql import functions as F

from themeloom.llm import catalog, mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight; what is over a cap is shared again, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.remove(s)
    return target


def skewed():
    rows = documents()
    rows += [(1000 + i, prose(40 + i, 30), "en", "hot", *EXTRA) for i in range(60)]
    rows += [(2000 + i, prose(140 + i, 3 + i), "en", f"x{i % 4}é", *EXTRA) for i in range(20)]
    rows += [(3000, "", "en", "only empty", *EXTRA), (3001, None, "en", "only null", *EXTRA)]
    return rows


def test_like_the_plain_version(spark):
    rows = skewed()
    count = {id(r): len(WORD.findall(r[1] or "")) for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += count[id(r)]
    target = plain_targets(sizes)
    want = []
    for s, total in sizes.items():
        at, quota = 0, int(target[s] + 0.5)
        place = lambda r: (-1, -1) if r[0] is None else (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16), r[0])
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (place(r), count[id(r)])):
            n = count[id(r)]
            taken = sum(max(0, min(quota - (e * total + at), n)) for e in range(2))
            want.append((r[0], n, total, round(target[s], 6), taken))
            at += n
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.report(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    per_source = defaultdict(int)
    for r in mixing.mix(mixing.placed(frame(spark, rows))).collect():
        per_source[r.source] += r.taken
    assert all(abs(per_source[s] - target[s]) <= 0.5 for s in sizes)


def test_equals_sql(spark):
    df = catalog.REGISTRY["op13_mixing"](spark, SF)
    assert compare(df, *oracle_rows(SF, catalog.ORACLES["op13_mixing"])) == ""


def test_mix_is_one_gapless_order_and_follows_the_curves(spark):
    rows = [(i, prose(i, 20), "en", "abc"[i % 3], *EXTRA) for i in range(300)]
    order = mixing.mix(mixing.placed(frame(spark, rows)))
    got = sorted(order.collect(), key=lambda r: r.begin)
    at, last = 0, -1.0
    for r in got:
        assert r.begin == at and r.time >= last
        at, last = at + r.taken, r.time
    # Early, late and middle curves: shares of a source's words taken before half of the time.
    half = {s: sum(r.taken for r in got if r.source == s and r.time < 0.5) / sum(r.taken for r in got if r.source == s)
            for s in "abc"}
    assert half["a"] == pytest.approx(0.625, abs=0.02)
    assert half["b"] == pytest.approx(0.375, abs=0.02)
    assert half["c"] == pytest.approx(0.5, abs=0.02)
    again = sorted(mixing.mix(mixing.placed(frame(spark, rows).repartition(7))).drop("row").collect(), key=lambda r: r.begin)
    assert [(r.begin, r.doc_id) for r in again] == [(r.begin, r.doc_id) for r in got]


def test_time_inverts_the_integral(spark):
    curve = ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 0.0))
    times = spark.range(101).select((F.col("id") / 100).alias("done"), mixing.time_of(F.col("id") / 100, curve).alias("t")).collect()

    def area(t):
        total = 0.0
        for (a, h), (b, k) in zip(curve, curve[1:]):
            x = min(max(t - a, 0.0), b - a)
            total += x * (h + (h + (k - h) * x / (b - a))) / 2
        return total

    assert all(area(r.t) == pytest.approx(r.done * area(1.0), abs=1e-9) for r in times)


def test_no_documents_and_no_words(spark):
    assert mixing.report(frame(spark, [])).count() == 0
    assert mixing.mix(mixing.placed(frame(spark, []))).count() == 0
    none = mixing.report(frame(spark, [(1, None, "en", None, *EXTRA), (1, " ", "en", None, *EXTRA)])).collect()
    assert [(r.doc_id, r["size"], r.target, r.taken, r.time) for r in none] == [(1, 0, 0.0, 0, None)] * 2
