"""Keyword labels of clusters: TF-IDF over a cluster's own documents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.text import usable_text, words
from themeloom.operators.skew import meet
from themeloom.session import cut, dealt

NO_TEXT = "(no text)"
NO_VOCABULARY = "(no vocabulary)"
# Texts whose terms a task counts at once.
TASK_TEXTS = 1024

# Spark's default English stop words, so that no session is needed
# to name them.
STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is
    are was were be been being have has had having do does did doing a an the and but if or because as until
    while of at by for with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now
    i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
    won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would
""".split()


def telling_words(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of a text without stop words."""
    return F.filter(words(text), lambda w: ~w.isin(list(stop_words)))


def words_and_pairs(kept: Column) -> Column:
    """Single words and pairs of neighbouring words."""
    pairs = F.zip_with(kept, F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))),
                       lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.concat(kept, F.filter(pairs, lambda p: p.isNotNull()))


def term_weights(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS, *, max_docs: int | None = None,
                 max_terms: int | None = None) -> DataFrame:
    """Summed TF-IDF weight of every term of a cluster: ``set_id, cluster_id, term, weight``.

    ``docs`` has ``set_id, cluster_id, doc_id, text``, and ``rank`` if ``max_docs`` is
    given.  All documents and terms of a cluster are used, unless a limit is set.
    Counts are grouped sums, combined before each shuffle, so that a large cluster
    is no single task.
    """
    used = docs if max_docs is None else docs.where(F.col("rank") <= max_docs)
    # Stored, the texts are looked up once; dealt by their number, a task's terms stay few.
    texts = cut(used.select("set_id", "cluster_id", "doc_id", usable_text(F.col("text")).alias("text")).where("text IS NOT NULL"))
    used = dealt(texts, "set_id", "cluster_id", "doc_id", rows=TASK_TEXTS)
    used = used.withColumn("_kept", telling_words(F.col("text"), stop_words))
    rows = used.select("set_id", "cluster_id", "doc_id", F.explode(words_and_pairs(F.col("_kept"))).alias("term"))
    # Counts are read twice: stored, texts are taken apart once.
    tf = cut(rows.groupBy("set_id", "cluster_id", "doc_id", "term").agg(F.count("*").alias("tf")))
    cluster = ["set_id", "cluster_id"]
    terms = tf.groupBy(*cluster, "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    if max_terms is not None:
        by_total = Window.partitionBy(*cluster).orderBy(F.col("total").desc(), "term")
        terms = terms.withColumn("place", F.row_number().over(by_total)).where(F.col("place") <= max_terms)
    tf = tf.join(terms.select(*cluster, "term", "df"), [*cluster, "term"])
    n = texts.groupBy(*cluster).agg(F.count("*").alias("n"))
    tf = tf.join(n, cluster)
    gain = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    tf = tf.select(*cluster, "doc_id", "term", gain.alias("gain"))
    # A document's own terms meet in one place, and once.
    length = F.sqrt(F.sum(F.col("gain") * F.col("gain")).over(Window.partitionBy(*cluster, "doc_id")))
    tf = tf.withColumn("length", length)
    return tf.groupBy(*cluster, "term").agg(F.sum(F.col("gain") / F.col("length")).alias("weight"))


def heaviest(kept: Sequence[Sequence[str]], top: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of one cluster and their summed TF-IDF weights: the ``top`` heaviest, and those that rounding may put beside them.

    ``kept`` are the telling words of its documents, in order.
    """
    named: dict[str, int] = {}
    of, ids = [], []
    for k, own in enumerate(kept):
        own = list(own)
        own += [f"{x} {y}" for x, y in zip(own, own[1:])]
        ids += [named.setdefault(t, len(named)) for t in own]
        of.append(np.full(len(own), k, np.int64))
    if not named:
        return np.empty(0, object), np.empty(0)
    pair, tf = np.unique(np.concatenate(of) * len(named) + np.array(ids, np.int64), return_counts=True)
    doc, term = np.divmod(pair, len(named))
    gain = tf * (np.log((1 + len(kept)) / (1 + np.bincount(term, minlength=len(named)))) + 1)[term]
    length = np.sqrt(np.bincount(doc, gain * gain, minlength=len(kept)))
    weight = np.bincount(term, gain / length[doc], minlength=len(named))
    least = np.partition(weight, -top)[-top] if len(weight) > top else -np.inf
    best = np.flatnonzero(weight >= least - 1e-8)
    return np.array(list(named), object)[best], weight[best]


def few_terms(members: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """``set_id, cluster_id, term, weight``: weights as :func:`term_weights` has them, of the heaviest terms.

    ``members`` has a bounded number of documents a cluster, as ``set_id, cluster_id, doc_id``; ``kept`` the telling
    words of a document.  A document's words are found once, whatever number of clusters it is in, and a
    cluster's terms meet in one task.
    """
    def weigh(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        term, weight = heaviest(pdf["kept"].tolist(), max(1, top))
        return pd.DataFrame({"set_id": np.full(len(term), key[0]), "cluster_id": np.full(len(term), key[1]), "term": term, "weight": weight})

    kinds = dict(members.dtypes)
    return meet(members.select("set_id", "cluster_id", "doc_id"), kept, ["doc_id"]).groupBy("set_id", "cluster_id").applyInPandas(
        weigh, f"set_id {kinds['set_id']}, cluster_id {kinds['cluster_id']}, term string, weight double")


def ranked_terms(weights: DataFrame, top: int) -> DataFrame:
    """The heaviest terms of every cluster, ties alphabetical."""
    w = Window.partitionBy("set_id", "cluster_id").orderBy(F.round("weight", 9).desc(), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, top))


def cluster_terms(docs: DataFrame, top: int = 5, stop_words: Sequence[str] = STOP_WORDS, *,
                  max_docs: int | None = None, max_terms: int | None = None) -> DataFrame:
    """The heaviest terms of every cluster, ties alphabetical."""
    return ranked_terms(term_weights(docs, stop_words, max_docs=max_docs, max_terms=max_terms), top)


def _joined(ranked: DataFrame, usable: DataFrame) -> DataFrame:
    """``set_id, cluster_id, label`` of clusters with ``n`` usable texts."""
    terms = ranked.groupBy("set_id", "cluster_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))),
                                 lambda e: e.term), ", ").alias("terms"))
    label = F.when(F.col("n") == 0, NO_TEXT).otherwise(F.coalesce("terms", F.lit(NO_VOCABULARY)))
    return (usable.join(terms, ["set_id", "cluster_id"], "left")
            .select("set_id", "cluster_id", label.alias("label")))


def labels_of_few(members: DataFrame, texts: DataFrame, top: int = 5, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """:func:`keyword_labels` of clusters of a bounded number of documents each.

    ``members`` has ``set_id, cluster_id, doc_id``; ``texts``, a stored table, ``doc_id, text`` once for each document.
    """
    # Dealt by their number: texts of a few files are long work for few tasks.  A filter on them would be moved before.
    kept = telling_words(usable_text(F.col("text")), stop_words).alias("kept")
    kept = cut(dealt(texts, "doc_id", rows=TASK_TEXTS).select("doc_id", kept)).where("kept IS NOT NULL")
    members = cut(members.select("set_id", "cluster_id", "doc_id"))
    has = kept.select("doc_id", F.lit(1).alias("usable"))
    usable = meet(members, has, ["doc_id"], "left").groupBy("set_id", "cluster_id").agg(F.count("usable").alias("n"))
    return _joined(ranked_terms(few_terms(members, kept, top), top), usable)


def keyword_labels(docs: DataFrame, top: int = 5, stop_words: Sequence[str] = STOP_WORDS, *,
                   max_docs: int | None = None, max_terms: int | None = None) -> DataFrame:
    """``set_id, cluster_id, label``: heaviest terms joined by a comma."""
    # Read for the terms and for the number of texts.
    docs = cut(docs.select(*[c for c in docs.columns if c in ("set_id", "cluster_id", "doc_id", "rank", "text")]))
    counted = docs if max_docs is None else docs.where(F.col("rank") <= max_docs)
    usable = (counted.groupBy("set_id", "cluster_id")
              .agg(F.count(usable_text(F.col("text"))).alias("n")))
    return _joined(cluster_terms(docs, top, stop_words, max_docs=max_docs, max_terms=max_terms), usable)
