"""Quality rules with thresholds that adapt to each language and source.

Fixed base rules come first.  For the documents that pass them, ratios (symbols, words in
capitals, repeated lines, repeated word windows, word length) go into quantile sketches:
counts of values in bins of bounded relative error, one sketch per language, source and
ratio.  Bins add up, so sketches merge by sums, in any order, with equal results; a
group too small for its own sketch takes the merged one of its language.  Thresholds are
the upper quartile plus a multiple of the distance between the quartiles and a least
slack; documents above one are rejected by a join on language and source.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import carried, text_key
from themeloom.session import cut

# Ratio: (numerator, denominator, least slack above the upper quartile); in parts of SCALE.
SCALE = 10_000
RATIOS = {
    "symbols": ("n_symbols", "n_words", 1_000),
    "capitals": ("n_capitals", "n_words", 3_000),
    "dup_lines": ("n_dup_lines", "n_lines", 3_000),
    "repeats": ("n_repeat_words", "n_words", 2_000),
    "word_length": ("word_chars", "n_words", 60_000),
}
SPREAD = 3
MIN_GROUP = 30
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def repeat_words(words: list[str], window: int = 3) -> int:
    """Words inside windows that occur twice or more in the text, each word once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    code = ids[:n]
    for k in range(1, window):
        # Renumbered after each step, so that the product fits 64 bits for any text.
        code = np.unique(code * len(number) + ids[k:n + k], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The seven counts of one text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, repeat_words(words), lines,
            len(re.findall(r"[A-ZÀ-ÖØ-Þ]{2,}", text)))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every row, stored."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame([counts(t) for t in batch["text"]], columns=names, dtype="int64")
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), made], axis=1)

    kept = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source", "_k1", "_k2")
            if c in docs.columns]
    return cut(docs.select(*[k.split()[0] for k in kept], "text").mapInPandas(run, ", ".join([*kept, COUNTS])))


def bin_of(value: Column) -> Column:
    """Lower end of a whole number's bin: exact below 128, then 64 bins for each doubling."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - 7)
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    over, under, _ = RATIOS[name]
    return F.floor(SCALE * F.col(over) / F.greatest(F.lit(1), F.col(under))).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, ratio, bin, n``: the quantile sketches of the documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bin_of(ratio(r)).alias("bin")) for r in RATIOS]))
    return (measured.where(~base_failed()).select("lang", "source", pairs.alias("p"))
                    .groupBy("lang", "source", "p.ratio", "p.bin").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles and size of each sketch."""
    by = Window.partitionBy(*keys, "ratio")
    run = F.sum("n").over(by.orderBy("bin"))
    part = sketch.withColumn("upto", run).withColumn("size", F.sum("n").over(by))
    return part.groupBy(*keys, "ratio").agg(
        F.max("size").alias("size"), F.min(F.when(4 * F.col("upto") >= F.col("size"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("size"), F.col("bin"))).alias("q3"))


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per language and source with the highest bin allowed for each ratio."""
    own = cut(sketches(measured))
    merged = own.groupBy("lang", "ratio", "bin").agg(F.sum("n").alias("n"))
    by_lang = quartiles(merged, ["lang"]).select(
        F.col("lang").alias("_lang"), F.col("ratio").alias("_ratio"), F.col("q1").alias("m1"), F.col("q3").alias("m3"))
    both = quartiles(own, ["lang", "source"]).join(
        by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("ratio") == F.col("_ratio")), "left")
    small = F.col("size") < MIN_GROUP
    q1, q3 = F.when(small, F.col("m1")).otherwise(F.col("q1")), F.when(small, F.col("m3")).otherwise(F.col("q3"))
    slack = F.create_map(*[x for r, (_, _, s) in RATIOS.items() for x in (F.lit(r), F.lit(s))])
    limit = q3 + SPREAD * (q3 - q1) + F.element_at(slack, F.col("ratio"))
    return both.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(
        *[F.max(F.when(F.col("ratio") == r, limit)).alias(f"max_{r}") for r in RATIOS])


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every row of ``docs`` with ``base_failed`` and ``kept``.

    Null texts count as empty and fail the base rules.  A null language or source is a group of
    its own.  Repeated rows and null ids are judged one by one; no documents give no rows; other
    columns are ignored.
    """
    measured = measure(docs)
    limits = thresholds(measured)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
                           "left")
    within = F.lit(True)
    for r in RATIOS:
        within = within & (bin_of(ratio(r)) <= F.coalesce(F.col(f"max_{r}"), F.lit(2**62)))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, unchanged, with all their columns."""
    k1, k2 = text_key(F.col("text"))
    held = carried(docs).withColumn("_k1", k1).withColumn("_k2", k2)
    small = held.select("doc_id", "text", "_k1", "_k2", F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"))
    good = judge(small).where("kept").select("_k1", "_k2", "lang", "source").distinct().alias("good")
    same = ((F.col("held._k1") == F.col("good._k1")) & (F.col("held._k2") == F.col("good._k2"))
            & F.col("held.doc.lang").eqNullSafe(F.col("good.lang"))
            & F.col("held.doc.source").eqNullSafe(F.col("good.source")))
    return held.alias("held").join(good, same, "left_semi").select("doc.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
