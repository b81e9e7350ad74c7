"""SimHash classes and line dedup against plain versions."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import EXTRA, WORD, documents, frame, of_texts, prose

from themeloom.llm import graph, linetree, simhash


def plain_fingerprint(text, size=4):
    w = [x.encode() for x in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < size else [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints, bits=4):
    """Smallest id reachable of each row of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(prints))]


def test_position_sets_cover_every_four_bytes():
    sets = [set(t) for t in simhash.position_sets()]
    assert len(sets) == 20
    assert all(any(t <= set(four) for t in sets) for four in combinations(range(8), 4))


def test_classes_equal_brute_force(spark):
    rows = documents()
    got = sorted(map(tuple, simhash.classes(frame(spark)).collect()), key=str)
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_classes(prints), strict=True)), key=str)
    assert got == want


def test_links_lose_nothing_in_dense_and_random_groups(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(1 << 62))
    values = {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(500)}
    values |= {int(v) for v in rng.integers(0, 1 << 62, 100)}
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    nodes = spark.createDataFrame(list(enumerate(values)), "node long, sig long")
    # Blocks far smaller than the groups, so that hot keys are cut and meet block by block.
    links = simhash.links(nodes, 4, block=32)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    want = plain_classes([(i, v & (2**64 - 1)) for i, v in enumerate(values)])
    assert [roots.get(i, i) for i in range(len(values))] == want


def test_no_documents(spark):
    assert simhash.classes(frame(spark, [])).count() == 0
    assert linetree.report(frame(spark, [])).count() == 0
    assert simhash.one_per_class(frame(spark, [])).count() == 0


def test_components_of_chains_and_null_ends(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (None, 1), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_one_of_each_class_stays(spark):
    originals = [prose(100 + i, 700) for i in range(12)]
    copies = []
    for k, t in enumerate(originals):
        for j in range(k % 3):
            changed = t.split()
            changed[20 + 50 * j] = "changed"
            copies.append((1000 + 10 * k + j, " ".join(changed)))
    texts = [*enumerate(originals), *copies, (50, ""), (51, None)]
    prints = [(d, plain_fingerprint(t)) for d, t in texts]
    want = {*plain_classes(prints)}
    assert len(want) < len(texts) - 4, "some copies are within four bits"
    rows = [(d, t, "en", "s", *EXTRA) for d, t in texts]
    kept = simhash.one_per_class(frame(spark, [*rows, (None, originals[0], "en", "s", *EXTRA), rows[0]]))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*want, None], key=str)


BOILER = "Please read the terms of service at page {} before you go on reading"


def line_docs():
    return [prose(1, 40) + "\n" + BOILER.format(3), BOILER.format(77) + "\n" + prose(2, 40),
            prose(3, 40) + "\n" + "Please read the terms of service at page seven before you go on reading",
            prose(4, 40) + "\n\n" + prose(4, 9), prose(1, 40) + "\n" + BOILER.format(3), "", None, "Of. Of.\nOf.", "Of.\nOf."]


def test_recurring_lines_are_dropped_but_for_the_first_text(spark):
    docs = line_docs()
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linetree.report(of_texts(spark, docs)).collect()}
    assert got[0] == (docs[0], 2, 0)
    assert got[4] == (docs[4], 2, 0), "a copy of the first text is the first text"
    assert got[1] == (prose(2, 40), 2, 1), "a digit field is variable"
    assert got[2] == (prose(3, 40), 2, 1), "a word field is variable"
    assert got[3] == (docs[3], 3, 0)
    assert got[5] == ("", 1, 0) and got[6] == (None, 0, 0)
    assert got[7] == (docs[7], 2, 0) and got[8] == (docs[8], 2, 0), "short lines stay"


def test_long_passage_shared_by_documents_is_dropped_once_kept(spark):
    passage = prose(77, 60)
    docs = [prose(200 + i, 50) + ("\n" + passage if i % 4 == 0 else "") for i in range(20)]
    got = {r.doc_id: r.n_dropped for r in linetree.report(of_texts(spark, docs)).collect()}
    assert got == {i: int(i % 4 == 0 and i > 0) for i in range(20)}


def test_templates_of_one_leaf_are_found_apart(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiourstlnmd") for _ in range(6))
    fixed = [[word() for _ in range(9)] for _ in range(5)]
    docs = []
    for i in range(240):
        if i < 120:
            # Five templates with one word field and equal leading tokens; the fifth is rare.
            words = list(fixed[4 if i < 4 else i % 4])
            words[3 if i < 4 else i % 4 + 3] = word()
        else:
            words = [word() for _ in range(9)]
        docs.append(prose(700 + i, 20) + f"\n{i} {i} {i} " + " ".join(words))
    got = {r.doc_id: (r.text, r.n_dropped) for r in linetree.report(of_texts(spark, docs)).collect()}
    first = {0, 4, 5, 6, 7}
    assert {i for i in got if not got[i][1]} == first | {*range(120, 240)}
    assert all(got[i][0] == docs[i] for i in first)


def test_line_dedup_keeps_rows_and_columns(spark):
    rows = documents()
    out = linetree.without_recurring(frame(spark))
    assert out.columns == frame(spark, []).columns
    assert out.count() == len(rows)


@pytest.mark.parametrize("line,n", [("", 0), ("a", 1), ("  a \t b1\x0bc ", 3), ("\r", 0)])
def test_masked_tokens(spark, line, n):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(line,)], "t string").select(linetree.masked(F.col("t")).alias("m")).select(
        "m", linetree.tokens(F.col("m")).alias("n")).first()
    assert r.n == n and "1" not in r.m
