"""Labelled-data jobs: alignment, splits, label indexes, models and their scores."""

from __future__ import annotations

import math
from string import ascii_lowercase, digits

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.text import blank_tokens, words
from themeloom.operators.skew import attach
from themeloom.session import cut, dealt

SPLIT_BUCKETS = 4096


# -- examples --------------------------------------------------------------------

def align_tokens(rows: DataFrame) -> DataFrame:
    """Add ``tokens``, ``labels`` and ``aligned`` to rows of ``text, labels``."""
    tokens, labels = blank_tokens(F.col("text")), blank_tokens(F.col("labels"))
    return (rows.withColumn("tokens", tokens).withColumn("label_list", labels)
            .withColumn("aligned", F.size("tokens") == F.size("label_list")))


def token_examples(rows: DataFrame, id_column: str, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Aligned examples and rejected rows; ``strict`` fails naming a rejected row."""
    both = align_tokens(rows)
    bad = both.where(~F.col("aligned"))
    if strict:
        first = bad.select(id_column, F.size("tokens").alias("t"), F.size("label_list").alias("l")).head()
        if first is not None:
            raise ValueError(f"row {first[0]} has {first['t']} tokens, but {first['l']} labels")
    good = both.where("aligned").select(id_column, "tokens", F.col("label_list").alias("labels"))
    return good, bad.select(id_column, "text", "labels")


def token_rows(examples: DataFrame, id_column: str) -> DataFrame:
    """One row per token: ``id, pos, word, tag``."""
    return examples.select(id_column, F.posexplode(F.arrays_zip("tokens", "labels")).alias("pos", "e")).select(
        id_column, "pos", F.col("e.tokens").alias("word"), F.col("e.labels").alias("tag"))


def first_piece_labels(pieces: DataFrame, id_column: str) -> DataFrame:
    """Keep the label on a word's first piece only; later pieces get -100.

    ``pieces`` has ``id, word_index, piece, label_id``.
    """
    w = Window.partitionBy(id_column, "word_index").orderBy("piece")
    first = F.row_number().over(w) == 1
    return pieces.withColumn("label_id", F.when(first & F.col("word_index").isNotNull(), F.col("label_id"))
                             .otherwise(F.lit(-100)))


# -- splits ------------------------------------------------------------------------

def _cut_split(rows: DataFrame, keys: list[str], id_column: str, wanted: DataFrame, seed: int) -> DataFrame:
    """Mark the first ``n_train`` rows of every group in hash order.

    Counts per hash bucket locate the cut, and only the bucket it falls into is
    ranked, so a group of any size is never sorted as a whole.
    """
    draw, bucket = _draw(id_column, seed)
    hashed = rows.withColumns({"_h": draw, "_bucket": bucket})
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.join(wanted, keys)
    place = (F.when(F.col("_start") + F.col("_n") <= F.col("n_train"), "train")
              .when(F.col("_start") >= F.col("n_train"), "eval").otherwise("cut"))
    marks = starts.select(*keys, "_bucket", place.alias("_place"),
                          (F.col("n_train") - F.col("_start")).alias("_take"))
    marked = attach(hashed, marks, [*keys, "_bucket"], row_bytes=64, spread=F.col(id_column))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_h", id_column)
    edge = marked.where("_place = 'cut'").withColumn("_rank", F.row_number().over(inside))
    edge = edge.withColumn("split", F.when(F.col("_rank") <= F.col("_take"), "train").otherwise("eval"))
    rest = marked.where("_place <> 'cut'").withColumn("split", F.col("_place"))
    return rest.unionByName(edge.drop("_rank")).drop("_h", "_bucket", "_place", "_take")


def _draw(id_column: str, seed: int) -> tuple[Column, Column]:
    """Hash of an id and the bucket it falls into."""
    h = F.xxhash64(F.lit(seed), F.col(id_column))
    return h, F.pmod(F.shiftrightunsigned(h, 32), F.lit(SPLIT_BUCKETS)).cast("int")


def _split_together(rows: DataFrame, id_column: str, ratio: float, seed: int) -> DataFrame:
    """Mark rows by their id: a train id is at most the last one in order of bucket, hash and id.

    That id is found among the distinct ids, so that the rows themselves are not joined with them.
    """
    h, bucket = _draw(id_column, seed)
    ids = cut(rows.select(id_column).distinct())
    counts = dict(ids.groupBy(bucket.alias("b")).count().collect())
    take = math.floor(sum(counts.values()) * ratio)
    place = -1
    while take > 0:
        place += 1
        take -= counts.get(place, 0)
    train = F.lit(False)
    if place >= 0:
        rank = F.row_number().over(Window.orderBy("h", id_column))
        inside = ids.where(bucket == place).select(h.alias("h"), id_column)
        last = inside.withColumn("rank", rank).where(F.col("rank") == counts[place] + take).head()
        train = (bucket < place) | ((bucket == place) & ((h < last["h"]) | ((h == last["h"]) & (F.col(id_column) <= last[id_column]))))
    return rows.withColumn("split", F.when(train, "train").otherwise("eval"))


def ratio_split(rows: DataFrame, id_column: str, ratio: float = 0.8, seed: int = 42, *, together: bool = False) -> DataFrame:
    """Add ``split``: a seeded shuffle cut at exactly floor(n * ratio) rows.

    ``together`` counts ids, not rows: all rows of an id go to the same part.
    """
    if together:
        return _split_together(rows, id_column, ratio, seed)
    whole = rows.withColumn("_all", F.lit(0))
    wanted = whole.groupBy("_all").agg(F.floor(F.count("*") * F.lit(ratio)).alias("n_train"))
    return _cut_split(whole, ["_all"], id_column, wanted, seed).drop("_all")


def stratified_split(rows: DataFrame, id_column: str, label: str = "label", ratio: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """Add ``split``: every label keeps its share, the total is exact.

    The evaluation part is rounded up; labels with the largest remainders get
    the rows left over, ties alphabetical.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    # One row per label: the window over all of them is as small as the label list.
    everything = Window.partitionBy(F.lit(0))
    share = counts.withColumn("all", F.sum("n").over(everything)).withColumn(
        "want", F.col("all") - F.ceil(F.round(F.col("all") * F.lit(1 - ratio), 9)))
    share = share.withColumn("exact", F.col("n") * F.col("want") / F.col("all"))
    share = share.withColumn("low", F.floor("exact"))
    order = everything.orderBy((F.col("exact") - F.col("low")).desc(), label)
    spare = F.col("want") - F.sum("low").over(everything)
    wanted = share.withColumn("n_train", F.col("low") + F.when(
        F.row_number().over(order) <= spare, 1).otherwise(0)).select(label, "n_train")
    return _cut_split(rows, [label], id_column, wanted, seed)


# -- label indexes --------------------------------------------------------------------

def label_vocabulary(rows: DataFrame, label: str = "label") -> DataFrame:
    """``label, label_id, n``: distinct labels in sorted order, from 0."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)) - 1
    return counts.withColumn("label_id", nth)


# -- intent --------------------------------------------------------------------------

def fit_intent(rows: DataFrame, *, features: int = 1 << 12, rounds: int = 30) -> PipelineModel:
    """Multinomial model from ``text`` to ``label``."""
    prepared = rows.select(words(F.col("text")).alias("tokens"), "label")
    return Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="label_id", stringOrderType="alphabetAsc",
                      handleInvalid="keep"),
        HashingTF(inputCol="tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        LogisticRegression(featuresCol="_idf", labelCol="label_id", maxIter=rounds, regParam=0.01,
                           family="multinomial"),
    ]).fit(prepared)


def score_intent(rows: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """Add ``scores`` (class to probability) and ``intent``, the best class."""
    names = list(model.stages[0].labels)
    scored = rows.withColumn("tokens", words(F.col(text)))
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    probs = F.slice(vector_to_array("probability"), 1, len(names))
    scores = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), probs)
    kept = [F.col(c) for c in rows.columns]
    return scored.select(*kept, scores.alias("scores")).withColumn("intent", best_label(F.col("scores")))


def best_label(scores: Column, allowed: list[str] | None = None) -> Column:
    """Class with the highest score, ties alphabetical; optionally of some classes only."""
    if allowed is not None:
        scores = F.map_filter(scores, lambda k, _: k.isin(allowed))
    ranked = F.array_sort(F.transform(F.map_entries(scores),
                                      lambda e: F.struct((-e.value).alias("s"), e.key.alias("k"))))
    return F.try_element_at(ranked, F.lit(1)).k


# -- token tagging ------------------------------------------------------------------------

def _token_features(tokens: DataFrame, id_column: str) -> DataFrame:
    w = Window.partitionBy(id_column).orderBy("pos")
    word = F.col("_w")
    # Plain letters and digits by a table, the pattern only where a word has other characters.
    plain = F.translate(word, ascii_lowercase + digits, "a" * 26 + "9" * 10)
    shape = F.when(F.octet_length(word) == F.length(word), plain).otherwise(F.regexp_replace(plain, r"\p{L}", "a"))
    t = tokens.withColumn("_w", F.lower("word")).withColumn("_s", shape)
    t = t.withColumns({"_p": F.lag("_w").over(w), "_n": F.lead("_w").over(w)})
    feats = F.array(F.concat(F.lit("w="), "_w"), F.concat(F.lit("s="), "_s"),
                    F.concat(F.lit("p="), F.coalesce("_p", F.lit("^"))),
                    F.concat(F.lit("n="), F.coalesce("_n", F.lit("$"))),
                    F.concat(F.lit("h="), F.substring("_w", 1, 3)))
    return t.withColumn("features_text", feats).drop("_w", "_s", "_p", "_n")


def fit_tagger(tokens: DataFrame, id_column: str, *, features: int = 1 << 13, rounds: int = 30) -> PipelineModel:
    """Multinomial model of a token's tag from itself and its neighbours.

    ``tokens`` has ``id, pos, word, tag``.
    """
    names = StringIndexer(inputCol="tag", outputCol="tag_id", stringOrderType="alphabetAsc", handleInvalid="keep").fit(tokens)
    hashing = HashingTF(inputCol="features_text", outputCol="_tf", numFeatures=features, binary=True)
    model = LogisticRegression(featuresCol="_tf", labelCol="tag_id", maxIter=rounds, regParam=0.001,
                               family="multinomial", predictionCol="tag_pred")
    # The model reads its examples several times: stored, neighbours are looked up and hashed once.
    examples = cut(names.transform(hashing.transform(_token_features(tokens, id_column))).select("_tf", "tag_id"))
    return PipelineModel([names, hashing, model.fit(examples)])


def tag_tokens(tokens: DataFrame, id_column: str, model: PipelineModel) -> DataFrame:
    """Add ``predicted``, the best tag of every token."""
    scored = _token_features(tokens, id_column)
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    back = IndexToString(inputCol="tag_pred", outputCol="predicted",
                         labels=[*model.stages[0].labels, "__unknown"])
    return back.transform(scored).select(*tokens.columns, "predicted")


# -- spans and scores -----------------------------------------------------------------------

def collapse_spans(tokens: DataFrame, id_column: str, tag: str = "tag") -> DataFrame:
    """Runs of B-/I- tags to spans: ``id, start, end, entity_group, text``.

    A ``B-`` tag, or any change of type, starts a span; ``O`` and empty words end
    one.
    """
    w = Window.partitionBy(id_column).orderBy("pos")
    kind = F.regexp_replace(F.col(tag), "^[BI]-", "")
    rows = tokens.where((F.col(tag) != "") & (F.trim("word") != "")).withColumn("_kind", kind)
    fresh = (F.col(tag).startswith("B-") | (F.coalesce(F.lag("_kind").over(w), F.lit("")) != F.col("_kind"))
             | F.col(tag).eqNullSafe("O"))
    rows = rows.withColumn("_new", fresh.cast("int"))
    rows = rows.withColumn("_span", F.sum("_new").over(w)).where(F.col(tag) != "O")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))),
                                    lambda e: e.word), " ")
    return rows.groupBy(id_column, "_span", F.col("_kind").alias("entity_group")).agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), text.alias("text")).drop("_span")


def entity_f1(gold: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """Micro scores over exact spans: one row ``tp, fp, fn, precision, recall, f1``."""
    key = [id_column, "start", "end", "entity_group"]
    # Spans without an id are nobody's: they meet no others.
    sides = [rows.select(*key, F.lit(side).alias("_side"), F.when(F.col(id_column).isNull(), side).alias("_alone"))
             for rows, side in ((gold, 1), (found, 2))]
    # Both sides are stored, so that their number says how many tasks compare them.
    met = dealt(cut(sides[0].unionByName(sides[1])), *key).groupBy(*key, "_alone").agg(
        F.min("_side").alias("_first"), F.max("_side").alias("_last"))
    both = met.agg(F.count_if((F.col("_first") == 1) & (F.col("_last") == 2)).alias("tp"),
                   F.count_if(F.col("_first") == 2).alias("fp"), F.count_if(F.col("_last") == 1).alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    zero = F.lit(0.0)
    return both.select("tp", "fp", "fn",
                       F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero).alias("precision"),
                       F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero).alias("recall"),
                       F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(zero).alias("f1"))


def accuracy(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """One row ``n, accuracy``."""
    return rows.agg(F.count("*").alias("n"),
                    F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))
