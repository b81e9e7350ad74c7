"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, look-alike letters in words that mix scripts, digits and signs
that stand for letters inside words.  The lexicon has whole words and beginnings of words,
each with its log-odds of toxic texts, learned from labelled rows.  An entry must pass a
likelihood-ratio test corrected for the number of entries tried; a beginning must pass it with
the other words behind it when its most frequent one is left out.  Words and two-word phrases under an entry
that clean texts use are exceptions.  The sum of weights
found, normalised by length, goes through a logistic curve fitted on labelled rows the
lexicon wasn't learned from.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.session import cut

# Small letters of other scripts that look like Latin ones (Cyrillic, Greek, Armenian, Latin alpha).
LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһԛԝѵкӏαορνικτυγχεօոսհզɑ",
                           "aeopcyxijsdhqwvklaopviktuyxeonuhqa")
# What stands for letters inside words.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
BEGINNINGS = range(4, 9)
TRAIN_ROWS = 20_000
MAX_ENTRIES = 5_000
ALPHA = 0.05


@dataclass
class Model:
    """Lexicon (pattern between word borders: weight), exceptions, and the curve's coefficients."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = ()


def fold(text: str | None) -> list[str]:
    """Words of a text after folding."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        # Only words that have Latin letters too: a word of one script is what it seems.
        text = re.sub(r"\S*[ɑͰ-֏]\S*", lambda m: m[0].translate(LOOK_ALIKE) if re.search("[a-z]", m[0]) else m[0], text)
    if re.search(r"[0134578@$]", text):
        # Runs between letters, at a word's start, and one or two that end a word of two letters or more.
        text = re.sub(r"(?<=[^\W\d_])[0134578@$]+(?=[^\W\d_])|(?<![\w@$])[0134578@$]{1,2}(?=[^\W\d_]{2})"
                      r"|(?<=[^\W\d_]{2})[0134578@$]{1,2}(?![\w@$])", lambda m: "".join(map(STANDS_FOR.get, m[0])), text)
    return re.findall(r"[^\W\d_]+", text)


class Matcher:
    """Automaton over the lexicon and its exceptions."""

    def __init__(self, model: Model):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for pattern, weight in model.lexicon.items():
            self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        self.automaton.make_automaton()

    def hits(self, joined: str) -> dict[int, tuple[int, float]]:
        """Longest match at each place where a word begins."""
        best: dict[int, tuple[int, float]] = {}
        if len(self.automaton):
            for end, match in self.automaton.iter(joined):
                start = end + 1 - match[0]
                if start not in best or match[0] > best[start][0]:
                    best[start] = match
        return best

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Bounded functions of the summed weights, alone and by length, and of the matches by length."""
        words = fold(text)
        found = [w for _, w in self.hits(f" {' '.join(words)} ").values() if w > 0]
        total, n = sum(found), len(words) + 20
        return (np.log1p(total), np.sqrt(total / n), np.sqrt(len(found) / n))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.curve:
            return np.zeros(len(texts))
        x = np.array([(1.0, *self.features(t)) for t in texts]).reshape(len(texts), 4)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.curve), -30, 30)))


def _doc_counts(rows: DataFrame, entries) -> DataFrame:
    """``entry, toxic, docs``: in how many texts of each label an entry stands; ``entries`` gives a text's."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                count.update((e, toxic) for e in entries(text))
            if len(count) > 200_000:
                yield pd.DataFrame([(e, y, n) for (e, y), n in count.items()], columns=["entry", "toxic", "docs"])
                count.clear()
        yield pd.DataFrame([(e, y, n) for (e, y), n in count.items()], columns=["entry", "toxic", "docs"])

    made = rows.mapInPandas(run, "entry string, toxic int, docs long")
    yes, no = (F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("docs"))), F.lit(0)) for y in (1, 0))
    return made.groupBy("entry").agg(yes.alias("toxic_docs"), no.alias("clean_docs"))


def likelihood_ratio(toxic: Column, clean: Column, toxic_texts: int, clean_texts: int) -> Column:
    """Twice the log likelihood ratio of an entry's share of toxic and of clean texts against one share."""
    total = toxic_texts + clean_texts
    part = lambda seen, rows, of: F.when(seen > 0, seen * F.log(seen * total / (rows * of))).otherwise(0.0)
    have, lack = toxic + clean, total - toxic - clean
    return 2 * (part(toxic, have, toxic_texts) + part(clean, have, clean_texts)
                + part(toxic_texts - toxic, lack, toxic_texts) + part(clean_texts - clean, lack, clean_texts))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts, chosen by a hash of their id, none of them held out, copies once.

    ``half`` 0 is for the lexicon, 1 for the curve.  Texts with the same smallest hash of five words in
    a row are copies, toxic if one of them is: many copies of a text are one witness, in one half.
    """
    able = labels.where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
    chosen = (able.select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                  .withColumn("_h", F.xxhash64("doc_id")).orderBy("_h").limit(rows).select("doc_id", "toxic"))
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - 4, F.lit(1))),
                       lambda i: F.xxhash64(F.array_join(F.slice("_words", i, 5), " ")))
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_words", words)
                .withColumn("_key", F.array_min(runs)).groupBy("_key")
                .agg(F.max_by("text", F.struct("toxic", F.xxhash64("text"))).alias("text"), F.max("toxic").alias("toxic"))
                .select("text", "toxic", F.pmod(F.xxhash64("_key"), F.lit(2)).alias("half")))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_entries: int = MAX_ENTRIES) -> Model:
    """A model fitted on at most ``rows`` labelled texts, with at most ``max_entries`` lexicon entries.

    Without labelled texts of both kinds the model is empty: all scores are 0.  Null texts are empty
    ones, repeated rows of an id are one label (toxic wins), other columns are ignored; whole texts count.
    """
    train = cut(training_rows(docs, labels, rows))
    number = {(r.half, r.toxic): r.n for r in train.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(number.get((h, y)) for h in (0, 1) for y in (0, 1)):
        return Model()
    learn = train.where("half = 0").select("text", "toxic")

    def beginnings(text: str | None) -> set[str]:
        out = set()
        for w in set(fold(text)):
            if len(w) >= 3:
                out.add(f" {w} ")
                out.update(f" {w[:k]}" for k in BEGINNINGS if k < len(w))
        return out

    odds = (F.log((F.col("toxic_docs") + 0.5) / (number[0, 1] + 1)) - F.log((F.col("clean_docs") + 0.5) / (number[0, 0] + 1)))
    counted = cut(_doc_counts(learn, beginnings).withColumn("weight", odds).withColumn(
        "gain", likelihood_ratio(F.col("toxic_docs"), F.col("clean_docs"), number[0, 1], number[0, 0])))
    # An entry no text could make pass, were all that have it toxic, is no trial.
    sure = -2 * math.log(number[0, 1] / (number[0, 0] + number[0, 1]))
    trials = counted.where((F.col("toxic_docs") + F.col("clean_docs")) * sure >= NormalDist().inv_cdf(1 - ALPHA / 2) ** 2).count()
    bar = NormalDist().inv_cdf(1 - ALPHA / 2 / max(1, trials)) ** 2
    passed = (F.col("weight") > 0) & (F.col("gain") >= bar)
    whole = F.col("entry").endswith(" ")
    # What each beginning has behind it, from the words' own rows.
    behind = (counted.where(whole).withColumn("stem", F.explode(F.transform(
                  F.filter(F.array(*map(F.lit, BEGINNINGS)), lambda k: k < F.length(F.trim("entry"))),
                  lambda k: F.substring(F.col("entry"), F.lit(1), k + 1))))
                     .groupBy("stem").agg((F.sum("toxic_docs") - F.max("toxic_docs")).alias("other_docs")))
    rest = F.least("toxic_docs", "other_docs")
    without = (number[0, 0] * rest > number[0, 1] * F.col("clean_docs")) & (
        likelihood_ratio(rest, F.col("clean_docs"), number[0, 1], number[0, 0]) >= bar)
    stems = (counted.where(~whole & passed).join(behind, F.col("entry") == F.col("stem"))
                    .where(without).select(*counted.columns))
    entries = (counted.where(whole & passed).unionByName(stems)
               .orderBy(F.desc(F.col("weight") * F.log1p("toxic_docs")), "entry").limit(max_entries).collect())
    lexicon = {r.entry: float(r.weight) for r in entries}
    matcher = Matcher(Model(lexicon))

    def used(text: str | None) -> set[str]:
        joined = f" {' '.join(fold(text))} "
        out = set()
        for start in matcher.hits(joined):
            first = joined.index(" ", start + 1)
            second = joined.find(" ", first + 1)
            out.add(joined[start + 1:first])
            if second > 0:
                out.add(joined[start + 1:second])
        return out

    clean = (_doc_counts(learn, used).withColumn("weight", odds).where((F.col("clean_docs") >= 3) & (F.col("weight") <= 0))
             .orderBy(F.desc("clean_docs"), "entry").limit(max_entries).collect())
    exceptions = frozenset(r.entry for r in clean)
    matcher = Matcher(Model(lexicon, exceptions))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([matcher.features(t) for t in batch["text"]], columns=["a", "b", "c"])
            out["y"] = batch["toxic"].to_numpy(float)
            yield out

    # At most ``rows`` rows of four numbers.
    points = train.where("half = 1").mapInPandas(measured, "a double, b double, c double, y double").toPandas().to_numpy()
    x, y = np.column_stack([np.ones(len(points)), points[:, :3]]), points[:, 3]
    curve = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(4), x.T @ (y - p) - 1e-2 * curve)
        curve += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(lexicon, exceptions, tuple(map(float, curve)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Only texts count for scores; null ones are empty, and empty ones have a score like any other.
    Null ids are not held out (their remainder is unknown: null).  Repeated rows and very long
    texts are scored whole, one by one; no rows give none; other columns are ignored.
    """
    # Plain values, as workers have no module to find the class in; at most ``max_entries`` of each.
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.exceptions, model.curve))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(Model(*shared.value))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": matcher.scores(list(batch["text"]))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
