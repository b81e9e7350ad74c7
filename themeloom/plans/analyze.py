"""From a table of questions and a table of documents to reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import first_text
from themeloom.operators import exemplars as X
from themeloom.operators import report as R
from themeloom.operators.density import forest_clusters
from themeloom.operators.exact import exact_forest
from themeloom.operators.keywords import labels_of_few
from themeloom.operators.knn import knn
from themeloom.operators.points import distinct_points, to_documents
from themeloom.operators.reach import adapted_cluster_size, core_distances, mutual_reachability
from themeloom.operators.reduce import fuzzy_weights, neighbour_layout, pca, spectral
from themeloom.operators.relevance import bm25, ranked_cap
from themeloom.operators.retrieve import (candidate_gates, candidates, filter_sets, lookup,
                                          topic_terms, with_message)
from themeloom.operators.skew import attach, meet
from themeloom.plans.questions import parse_questions
from themeloom.profile import Profile, logical, text_columns
from themeloom.session import cut, spread


@dataclass(frozen=True)
class Settings:
    """Parameters of a run.  The second form users know is :data:`FIVE_EXAMPLES`."""

    minimum: int = 20                 # fewer candidates are not clustered
    size: int | None = None           # cap on candidates per question, by relevance
    method: str = "pca"               # "pca", "spectral", "layout" or "none"
    n_components: int = 20
    n_neighbors: int = 30
    min_dist: float = 0.0
    min_cluster_size: int = 25
    min_samples: int | None = None    # default: the adapted minimum cluster size
    exemplars: int = 1
    label_docs: int = 50              # documents nearest the centre used for a label
    top_terms: int = 5
    by_size: bool = False             # largest cluster first instead of by id
    rating_mode: str = "tags"
    with_topic: bool = True


FIVE_EXAMPLES = Settings(minimum=10, exemplars=5, by_size=True, with_topic=False)


def reduce_points(points: DataFrame, settings: Settings) -> DataFrame:
    """``set_id, point_id, z`` by the chosen method."""
    if settings.method == "none":
        return points.select("set_id", "point_id", F.col("vector").alias("z"))
    if settings.method == "pca":
        return pca(points, settings.n_components)
    weights = cut(fuzzy_weights(knn(points, settings.n_neighbors, metric="cosine")))
    if settings.method == "spectral":
        return spectral(weights, settings.n_components)
    if settings.method == "layout":
        return neighbour_layout(weights, settings.n_components, min_dist=settings.min_dist)
    raise ValueError(f"unknown reduction method: {settings.method}")


def cluster_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Cluster every set of ``set_id, doc_id, vector`` on its own.

    Result: ``set_id, doc_id, cluster_id, probability, z``.
    """
    points = cut(distinct_points(vectors))
    z = cut(reduce_points(points, settings))
    plane = cut(z.select("set_id", "point_id", F.col("z").alias("vector")))
    least = adapted_cluster_size(F.col("n"), settings.min_cluster_size)
    n = points.groupBy("set_id").agg(F.sum("weight").alias("n"))
    sizes = cut(n.select("set_id", least.alias("min_size"),
                         (F.lit(settings.min_samples) if settings.min_samples else least).alias("m")))
    # Never fewer neighbours than the core distance needs.
    k = settings.min_samples or max(5, settings.min_cluster_size)
    edges = cut(knn(plane, k))
    cores = cut(core_distances(edges, points, sizes))
    forest = exact_forest(plane, cores, mutual_reachability(edges, cores))
    # The first coordinate is the one along which points differ most.
    first = z.select("set_id", "point_id", F.get("z", F.lit(0)).alias("place"))
    labels = forest_clusters(forest, meet(cores, first, ["set_id", "point_id"]), sizes)
    per_point = meet(points.select("set_id", "key", "point_id"), labels, ["set_id", "point_id"])
    per_point = meet(per_point, z, ["set_id", "point_id"])
    return to_documents(vectors, cut(per_point), ["cluster_id", "probability", "z"])


def describe_clusters(members: DataFrame, texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``set_id, cluster_id, size, label, exemplar_ids, text``: one row per cluster.

    Texts are fetched for the chosen documents only.
    """
    near = cut(X.exemplars(members, max(settings.exemplars, settings.label_docs)))
    text = first_text(text_columns(texts)).alias("text")
    fetched = cut(lookup(texts.select("doc_id", text), near, ["text"]))
    label = labels_of_few(near.where(F.col("rank") <= settings.label_docs), fetched, settings.top_terms)
    first = near.where(F.col("rank") <= settings.exemplars)
    ids = first.groupBy("set_id", "cluster_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda e: e.doc_id).alias("exemplar_ids"))
    rep = near.where("rank = 1").join(fetched, "doc_id").select("set_id", "cluster_id", "text")
    key = ["set_id", "cluster_id"]
    return (X.cluster_sizes(members).join(ids, key).join(label, key, "left").join(rep, key, "left")
            .withColumn("label", F.coalesce("label", F.lit("(no text)"))))


def analyze(questions: DataFrame, docs: DataFrame, profile: Profile,
            settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answer a table of questions.

    ``questions`` has ``query_id, query, intent``; ``docs`` has the profile's
    columns.  Returns the questions with filters, status and message; the
    clusters of every distinct filter set; and the totals of every set.
    Questions with equal filters share one set and are clustered once.
    """
    # A text that many ask is read once; distinct ones are few bytes, which would be one task.
    texts = parse_questions(spread(cut(questions.select("query").distinct())), rating_mode=settings.rating_mode)
    terms = topic_terms(F.col("query"), profile) if settings.with_topic else F.array().cast("array<string>")
    texts = cut(filter_sets(texts.withColumn("terms", terms)))
    asked = cut(attach(questions, texts, ["query"], row_bytes=400, spread=F.col("query_id")))
    table = logical(docs, profile)
    on_topic = asked.where(F.col("intent") == "trend_analysis")
    found = candidates(on_topic, table, profile, with_topic=settings.with_topic).where("vector IS NOT NULL")
    if settings.size is not None:
        wanted = on_topic.select("set_id", "terms").dropDuplicates(["set_id"])
        fields = [c for c in table.columns if c.startswith("text_")]
        found = ranked_cap(found, bm25(table, wanted, fields), settings.size)
    found = cut(found)
    counts = cut(found.groupBy("set_id").agg(F.count("*").alias("n_candidates")))
    gated = cut(candidate_gates(asked, counts, minimum=settings.minimum))
    enough = counts.where(F.col("n_candidates") >= settings.minimum).select("set_id")
    members = cut(cluster_vectors(attach(found, enough, ["set_id"], row_bytes=16, spread=F.col("doc_id")),
                                  settings))
    clusters = cut(describe_clusters(members, table, settings))
    totals = cut(X.noise_counts(members))
    status = attach(gated, totals.select("set_id", "n_clusters"), ["set_id"], how="left", row_bytes=24)
    none_found = (F.col("status") == "ok") & (F.coalesce("n_clusters", F.lit(0)) == 0)
    status = with_message(status.withColumn("status", F.when(none_found, "no_clusters")
                                            .otherwise(F.col("status"))).drop("message", "n_clusters"))
    return status, clusters, totals


def reports(questions: DataFrame, clusters: DataFrame, totals: DataFrame,
            settings: Settings = Settings()) -> DataFrame:
    """One report row per question: status, summary, totals and clusters."""
    body = R.cluster_structs(clusters, by_size=settings.by_size)
    lines = R.summaries(clusters)
    prompt = R.prompts(clusters.select("set_id", "cluster_id", "text"))
    per_set = cut(body.join(lines, "set_id").join(prompt, "set_id").join(totals, "set_id"))
    # Rows of any width: Spark broadcasts by stored size, or splits a set many questions share.
    out = questions.join(per_set, "set_id", "left")
    return out.withColumn("summary", F.coalesce("message", "summary"))


def report_rows(questions: DataFrame, clusters: DataFrame, totals: DataFrame) -> DataFrame:
    """The same report in long form: one row per question and cluster, one for a question without clusters."""
    # The side of the sets is stored, so a set that many questions share is split.
    sets = cut(totals.join(clusters, "set_id", "left"))
    reported = questions.withColumn("_set", F.when(F.col("status") == "ok", F.col("set_id")))
    return reported.join(sets.withColumnRenamed("set_id", "_set"), "_set", "left").drop("_set")
