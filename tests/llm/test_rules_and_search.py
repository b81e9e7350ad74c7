"""Quality rules, URL filter, top-k search and toxicity against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import EXTRA, WORD, documents, frame, of_texts, prose

from themeloom.llm import quality, topk, toxicity, urlfilter
from themeloom.llm.catalog import RULES


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force(spark):
    extra = ["a b c a b c a b", "x\nx\n\nx \n", "### $$ <b>", "\u00a0 \u2003 y", "a b c d " * 30]
    rows = documents() + [(100 + i, t, "en", None, *EXTRA) for i, t in enumerate(extra)]
    got = sorted(((r.doc_id, *(r[n] for n in NAMES), r.base_failed) for r in quality.judge(frame(spark, rows)).collect()), key=str)
    want = []
    for r in rows:
        c = plain_counts(r[1])
        want.append((r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want, key=str)


def plain_verdicts(rows):
    """Kept or not by the same sketch rule, with exact sorting of binned values."""
    def low(v):
        drop = max(0, v.bit_length() - 7)
        return v >> drop << drop

    kept, groups, counted = [], {}, []
    for _, text, lang, source, *_ in rows:
        c = dict(zip([x.split()[0] for x in quality.COUNTS.split(", ")], quality.counts(text), strict=True))
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        v = {r: low(quality.SCALE * c[o] // max(1, c[u])) for r, (o, u, _) in quality.RATIOS.items()}
        counted.append((failed, v, lang, source))
        if not failed:
            groups.setdefault((lang, source), []).append(v)
    for failed, v, lang, source in counted:
        if failed:
            kept.append(False)
            continue
        own = groups[lang, source]
        used = own if len(own) >= quality.MIN_GROUP else [x for (g, _), xs in groups.items() if g == lang for x in xs]
        ok = True
        for r, (_, _, slack) in quality.RATIOS.items():
            values = sorted(x[r] for x in used)
            q1, q3 = (values[math.ceil(p * len(values)) - 1] for p in (0.25, 0.75))
            ok &= v[r] <= q3 + quality.SPREAD * (q3 - q1) + slack
        kept.append(ok)
    return kept


def test_thresholds_and_verdicts_equal_brute_force(spark):
    rows = []
    for i in range(150):
        t = prose(i, 60 + i % 40)
        if i % 10 == 0:
            t = " ".join(f"{w}###" for w in t.split())
        elif i % 10 == 1:
            t = t.upper()
        rows.append((i, t, ["en", "de", None][i % 3], ["hot", "hot", f"s{i}"][i % 3 if i % 2 else 0], *EXTRA))
    want = {r[0]: k for r, k in zip(rows, plain_verdicts(rows), strict=True)}
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    assert got == want
    assert not any(got[i] for i in range(150) if i % 10 < 2) and sum(got.values()) > 100
    kept = quality.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(150) if got[i]]


def test_quality_of_no_documents(spark):
    assert quality.judge(frame(spark, [])).count() == 0


URLS = ["http://www.Example.com/en/1?utm_source=x", "https://a.example.net/es/2#top", "http://net/fr/", "http://x.net/en/9",
        "ftp://Spam.example.org/a/?ref=1&b=2", "https://www.spam.example.org/a?b=2", "no scheme", None, "", "http://", "http://com",
        "http://example.com/en", "http://blog.example.com/en/7", "http://ÄEx.org/p://q", "http://spam.example.org/a?c=1"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(URLS)] + [(0, URLS[0], 1, 2), (None, URLS[1], 1, 2)],
                                  "page_id long, url string, block long, canonical long")
    listed = spark.createDataFrame([("https://spam.example.org/a/?b=2",), (None,), ("zzz",)], "url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, listed, RULES).collect()}
    assert (0, "www.example.com", "/en/1", "www.example.com/en/", "allow") in got
    assert (1, "a.example.net", "/es/2", "net/es/", "block") in got
    assert (2, "net", "/fr/", "net/fr/", "block") in got
    assert (3, "x.net", "/en/9", None, "allow") in got
    assert (4, "spam.example.org", "/a/", None, "block") in got and (5, "www.spam.example.org", "/a", None, "block") in got
    assert {(i, "", "", None, "allow") for i in (6, 7, 8, 9)} <= got
    assert (10, "com", "", None, "allow") in got and (11, "example.com", "/en", "com/", "allow") in got
    assert (12, "blog.example.com", "/en/7", "example.com/en/", "block") in got
    assert (13, "ÄEx.org".replace("E", "e"), "/p://q", None, "allow") in got
    assert (14, "spam.example.org", "/a", None, "allow") in got
    assert urlfilter.judge(pages, listed.limit(0), RULES).where("rule is null and verdict = 'block'").count() == 0
    assert urlfilter.judge(pages.limit(0), listed, RULES).count() == 0


def test_bloom_filter_has_no_false_negatives_and_few_false_hits(spark):
    from pyspark.sql import functions as F

    made = spark.range(4000).select(F.concat(F.lit("h/"), "id").alias("canonical"), "id")
    words, blocks = urlfilter.bloom(made.where("id < 2000"), 2000)
    block, mask = urlfilter._block_and_mask(F.col("canonical"), blocks)
    hit = (made.withColumn("block", block).withColumn("mask", mask).join(words, "block", "left")
               .select("id", F.coalesce(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)).alias("hit")))
    assert hit.where("id < 2000 and not hit").count() == 0
    assert hit.where("id >= 2000 and hit").count() < 200


def plain_top(rows, k=10):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % 100 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in ok if c != q and len(w) == len(v))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    rows += [(2000, [0.0] * 16), (2001, None), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1e300] + [float("inf")] * 15),
             (None, rows[0][1]), (2100, []), (2200, [0.5, -0.5]), (2201, [1.0, 1.0]), (2300, [1.5])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, v long")).collect()))
    assert got == plain_top(rows)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_index_stops_early_when_impacts_are_uneven():
    rng = np.random.default_rng(1)
    m = (rng.exponential(1, (2000, 32)) ** 3 * 30).astype(int)
    index = topk.ImpactIndex(m)
    q = (rng.exponential(1, 32) ** 3 * 30).astype(int)
    (near,) = index.candidates(q[None, :], np.array([10]))
    assert set(np.argsort(-(m @ q), kind="stable")[:10]) <= set(near.tolist()) and len(near) < 200
    read = [index.segment_bounds(r)[0].astype(bool).sum() for r in range(len(index.floors))]
    assert read == sorted(read) and len(read) > 1


def toxic_rows():
    r = random.Random(4)
    bad = ["vermin", "filthmonger", "scumlord"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = prose(i, r.randint(30, 200)).split()
        if toxic:
            for _ in range(r.randint(3, 8)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), "en", "s", *EXTRA))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_is_learned_and_held_out_rows_are_not_used(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in got if got[i].held_out] == held and len(held) > 50
    assert sum(got[i].predicted == labels[i][2] for i in held) >= 0.97 * len(held)
    # Held-out labels turned round: the same model.
    turned = spark.createDataFrame([(i, 1, 1 - y if i in set(held) else y) for i, _, y in labels], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, turned) == model
    odd = {r.doc_id: r.score for r in toxicity.score(of_texts(spark, [None, "", "v3rm1n vеrmin VERMIN", "calm words here", "x" * 90_000]), model).collect()}
    assert odd[0] == odd[1] and odd[2] > 0.5 > odd[3] and all(0 <= s <= 1 for s in odd.values())


def test_exception_phrases_silence_an_entry():
    model = toxicity.Model({" clown ": 4.0}, frozenset(["clown fish"]), (-2.0, 3.0, 1.0, 1.0))
    m = toxicity.Matcher(model)
    loud, quiet, none = m.scores(["you clown there", "a clown fish swims", "a cat"])
    assert loud > 0.5 and quiet == pytest.approx(m.scores(["a fish cat swims"])[0]) and none < 0.5


def test_no_labels_no_scores(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark), none)
    assert {r.score for r in toxicity.score(frame(spark), model).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_runs_of_signs_and_compatibility_letters_are_folded():
    assert toxicity.fold("b@$tard tr@$h disgu57ing m00n v3rm1n") == ["bastard", "trash", "disgusting", "moon", "vermin"]
    assert toxicity.fold("ｆｏｏｌ 𝐟𝐨𝐨𝐥 moro0 cash$$$ wow!!! 2024") == ["fool", "fool", "moroo", "cash", "wow"]


def test_only_words_that_mix_scripts_are_folded():
    assert toxicity.fold("vеrmin ѕcum клоун και νερό") == ["vermin", "scum", "клоун", "και", "νερό"]


def test_words_that_share_a_beginning_with_one_toxic_word_stay_clean(spark):
    rows, labels = toxic_rows()
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {" vermin ", " filthmonger ", " scumlord "} <= model.lexicon.keys()
    texts = ["the vermilion path", "filthy scumble of filth", "vermicelli and vermouth"]
    assert all(s < 0.5 for s in toxicity.Matcher(model).scores(texts))


def test_beginnings_of_many_toxic_words_are_entries_and_copies_are_one_witness(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(800):
        words = prose(5000 + i, 60).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), "grumph" + "".join(r.choice("abcdefgh") for _ in range(4)))
        rows.append((i, " ".join(words), "en", "s", *EXTRA))
        labels.append((i, 1, int(i % 4 == 0)))
    # Two hundred copies of a toxic text with words of its own.
    rows += [(i, "zanzibar quokka marmalade " + rows[0][1], "en", "s", *EXTRA) for i in range(1000, 1200)]
    labels += [(i, 1, 1) for i in range(1000, 1200)]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert " grumph" in model.lexicon and not {" quokka ", " zanzibar ", " marmalade "} & model.lexicon.keys()
    new, calm = toxicity.Matcher(model).scores(["some grumphzzzz grumphyyyy here", "zanzibar quokka marmalade here"])
    assert new > 0.5 > calm


def plain_score(text, model):
    """The score by trying every entry and every exception at every word."""
    words = toxicity.fold(text)
    found = []
    for i, w in enumerate(words):
        tries = [(len(e), x) for e, x in model.lexicon.items() if f" {w} ".startswith(e)]
        tries += [(len(e) + 2, 0.0) for e in model.exceptions if e == w or (i + 1 < len(words) and e == f"{w} {words[i + 1]}")]
        if tries and max(tries)[1] > 0:
            found.append(max(tries)[1])
    n = len(words) + 20
    z = float(np.dot(model.curve, (1, np.log1p(sum(found)), np.sqrt(sum(found) / n), np.sqrt(len(found) / n))))
    return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def test_scores_equal_a_plain_search_of_every_entry(spark):
    model = toxicity.Model({" clown ": 4.0, " clow": 1.0, " moron ": 2.5, " mor": 0.75}, frozenset(["clown fish", "more", "mort"]),
                           (-2.0, 1.0, 3.0, 0.5))
    r = random.Random(3)
    words = ["clown", "cl0wn", "fish", "clowning", "more", "mort", "moron", "m0r0n!", "morning", "and", "é", "CLOWN", "cloѡn", "сlown"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", " \n", "clown " * 50_000]
    got = {x.doc_id: x.score for x in toxicity.score(of_texts(spark, texts), model).collect()}
    assert all(got[i] == pytest.approx(plain_score(t, model), abs=1e-12) for i, t in enumerate(texts))


def test_likelihood_ratio_equals_its_formula(spark):
    from pyspark.sql import functions as F

    rows = [(a, b) for a in (0, 1, 7, 30) for b in (0, 2, 40, 90)]
    out = spark.createDataFrame(rows, "t long, c long").select("t", "c", toxicity.likelihood_ratio(F.col("t"), F.col("c"), 30, 90).alias("g"))
    for x in out.collect():
        cells = [(x.t, x.t + x.c, 30), (x.c, x.t + x.c, 90), (30 - x.t, 120 - x.t - x.c, 30), (90 - x.c, 120 - x.t - x.c, 90)]
        assert x.g == pytest.approx(2 * sum(o * np.log(o * 120 / (m * n)) for o, m, n in cells if o))
