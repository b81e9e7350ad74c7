"""Spelling variants against brute force over all pairs, and the neighbourhoods of reduced words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from check import SF
from helpers import EXTRA, documents, frame, of_texts
from pyspark.sql import functions as F

from themeloom.llm import variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def plain_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def plain_groups(rows):
    count = plain_words(rows)
    near = {w: [] for w in count}
    by_length = {}
    for w in count:
        by_length.setdefault(len(w), []).append(w)
    for w in count:
        near[w] = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(size, ()) if one_edit(w, v)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def chains():
    """Chains of forms, ties of counts, accents, capitals, and one very long word with its variant."""
    words = {"banane": 40, "bananee": 10, "bananeex": 4, "bananeexy": 3, "banana": 40, "Banané": 6, "bananÉ": 3,
             "planet": 5, "planets": 9, "plane": 10, "plänet": 3, "w" * 3000: 6, "w" * 2999: 3, "straße": 7, "strase": 3}
    return [" ".join([w] * n) for w, n in words.items()]


@pytest.mark.parametrize("n_symbols", [2, 5, 40])
def test_groups_equal_brute_force(spark, n_symbols):
    r = random.Random(n_symbols)
    texts = [" ".join("".join(r.choices("abé", [6, 3, 1], k=r.randint(3, 8))) for _ in range(800)) for _ in range(4)]
    docs = of_texts(spark, chains() + texts).unionByName(frame(spark))
    rows = [(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]
    want = plain_groups(rows)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] and w[1] for w in want)
    assert rows_of(variants.groups(docs, n_symbols)) == want


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_groups([(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()])
    assert len(want) > 500
    assert rows_of(variants.groups(docs)) == want


def test_misprints_lose_the_letter_the_checksum_names():
    runs = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzéèàü'[i // 100]}" for i in range(1000)]
    got = [r.decode("latin-1") for r in variants.runs_of(7, " ".join(runs))]
    changed = 0
    for run, new in zip(runs, got, strict=True):
        h = zlib.crc32(f"7:{run}".encode())
        want = run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run
        assert new == want
        changed += new != run
    assert changed > 3


def test_neighbourhood_is_full():
    def code(word):
        return int((np.array(word, np.uint64) * variants.powers(max(1, len(word)))[:len(word)]).sum(dtype=np.uint64))

    words = [(1, 2, 3, 1), (1, 1, 1, 1), (3, 3, 2, 1)]
    row, near = variants.neighbourhood(np.array(words, np.uint8), 3)
    for i, w in enumerate(words):
        want = {w} | {w[:k] + w[k + 1:] for k in range(4)}
        want |= {w[:k] + (x,) + w[k + 1:] for k in range(4) for x in (1, 2, 3)}
        want |= {w[:k] + (x,) + w[k:] for k in range(5) for x in (1, 2, 3)}
        assert sorted(near[row == i].tolist()) == sorted(code(x) for x in want)


def test_no_documents_and_no_words(spark):
    assert variants.groups(frame(spark, [])).count() == 0
    assert variants.groups(frame(spark, [(1, None, "en", None, *EXTRA), (2, "tiny 123", "en", None, *EXTRA)])).count() == 0
    assert variants.followed(spark.createDataFrame([], "word string, form string")).count() == 0


def test_candidates_join_on_both_sides(spark):
    words = spark.createDataFrame([("planet", 3), ("planets", 4), ("garden", 9)], "word string, n long")
    got = {tuple(r) for r in variants.near_words(words, 4).select("word", "n", "near", "near_n").collect()}
    assert got == {("planet", 3, "planets", 4), ("planets", 4, "planet", 3)}
    assert variants.near_words(words.where(F.lit(False)), 4).count() == 0


def test_tables_that_grow_with_the_vocabulary_are_not_broadcast(spark, monkeypatch):
    plans, stored = [], variants.cut

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(variants, "cut", watched)
    rows = [(1, " ".join(["planet planet planet planets garden"] * 3), "en", None, *EXTRA)]
    out = variants.groups(frame(spark, rows))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert rows_of(out) == [("garden", None, "garden", 3, 0, None), ("planet", None, "planet", 9, 1, None),
                            ("planets", "planet", "planet", 3, 1, 9)]
    joined = [p for p in plans if "Join" in p]
    assert len(joined) >= 4 and not any("Broadcast" in p for p in joined)
