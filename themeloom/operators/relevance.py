"""BM25 relevance of documents to topic terms, over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import words
from themeloom.operators.skew import attach, top_per_group
from themeloom.session import cut

# The usual BM25 constants.
K1 = 1.2
B = 0.75


def bm25(docs: DataFrame, requests: DataFrame, text_fields: list[str]) -> DataFrame:
    """Scores ``set_id, doc_id, relevance`` of documents holding a requested term.

    ``requests`` has ``set_id, terms``; a term listed twice counts twice.  Term
    and length statistics cover all of ``docs``; the best text field counts.
    Occurrences are summed inside each input partition before any shuffle,
    because all words of one document sit in one row.
    """
    wanted = (requests.select("set_id", F.explode("terms").alias("term"))
              .groupBy("set_id", "term").agg(F.count("*").alias("times")))
    vocabulary = wanted.select("term").distinct()
    fields = F.array(*[F.struct(F.lit(i).alias("field"), words(F.col(f)).alias("tokens"))
                       for i, f in enumerate(text_fields)])
    tokens = (docs.select("doc_id", F.explode(fields).alias("f"))
              .select("doc_id", "f.field", F.size("f.tokens").alias("dl"), "f.tokens"))
    stats = (tokens.where("dl > 0").groupBy("field")
             .agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl")))
    hits = attach(tokens.select("doc_id", "field", "dl", F.explode("tokens").alias("term")),
                  vocabulary, ["term"], row_bytes=48, spread=F.col("doc_id"))
    # Stored: term statistics and scores both start from it.
    tf = cut(hits.groupBy("doc_id", "field", "dl", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    # One row of statistics per text field of the profile.
    weights = (df.join(F.broadcast(stats), "field")
               .select("field", "term", "avg_dl",
                       F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    tf = attach(tf, weights, ["field", "term"], row_bytes=64, spread=F.col("doc_id"))
    gain = F.col("idf") * F.col("tf") / (
        F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = attach(tf.select("doc_id", "field", "term", gain.alias("gain")), wanted, ["term"],
                    row_bytes=56, spread=F.col("doc_id"))
    per_field = (scored.groupBy("set_id", "doc_id", "field")
                 .agg(F.sum(F.col("gain") * F.col("times")).alias("relevance")))
    return per_field.groupBy("set_id", "doc_id").agg(F.max("relevance").alias("relevance"))


def ranked_cap(found: DataFrame, scores: DataFrame, size: int) -> DataFrame:
    """The ``size`` most relevant candidates of every set, ties by id.

    Sets without topic terms have no scores and keep their first ids.
    """
    joined = found.join(scores, ["set_id", "doc_id"], "left")
    relevance = F.round(F.coalesce("relevance", F.lit(0.0)), 9)
    ranked = top_per_group(joined.withColumn("_rel", relevance), ["set_id"],
                           [F.col("_rel").desc(), F.col("doc_id")], size, spread="doc_id")
    return ranked.drop("_rel", "rank", "relevance")
