"""Registered queries: every operator over the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import dates as D
from themeloom.functions import text as T
from themeloom.operators import exemplars as X
from themeloom.operators import report as R
from themeloom.operators import training as L
from themeloom.operators.exact import exact_forest
from themeloom.operators.forest import components, spanning_forest
from themeloom.operators.keywords import keyword_labels
from themeloom.operators.knn import adapted_components, adapted_neighbours, document_neighbours, knn
from themeloom.operators.points import distinct_points
from themeloom.operators.reach import adapted_cluster_size, core_distances, mutual_reachability
from themeloom.operators.reduce import fuzzy_weights, neighbour_layout, pca, spectral
from themeloom.operators.relevance import bm25, ranked_cap
from themeloom.operators.retrieve import (candidate_gates, candidates, filter_sets, has_keyword, lookup,
                                          matches_terms, score_predicate, score_violations, topic_terms,
                                          vector_scan)
from themeloom.operators.skew import attach, top_per_group
from themeloom.plans import questions as Q
from themeloom.plans.analyze import Settings, analyze, cluster_vectors, report_rows
from themeloom.plans.views import (TOPICS, all_questions, given_clusters, planted, questions, reviews, table, tagged_words)
from themeloom.profile import Profile, ScoreField, logical
from themeloom.session import cut, dealt
from themeloom.sources.documents import fit_text_vectors, read_documents, text_vectors

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
MEMBERS = 11            # copies kept per point: one more than the neighbours asked for
NEIGHBOURS = 10
LEVEL = 1.5             # density level at which planted groups are apart


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def r6(c):
    return F.round(c, 6)


# -- sources and scans ------------------------------------------------------------

@register
def document_source(spark, sf):
    docs = read_documents(spark, f"{sf}/documents.parquet", {"text": "text", "score": "n_chars"},
                          fmt="parquet", id_column="doc_id")
    return docs.select("doc_id", F.length("text").alias("chars"), F.col("score").cast("double").alias("score"))


@register
def vector_only_scan(spark, sf):
    hits = vector_scan(reviews(spark, sf))
    return hits.select("doc_id", F.size("vector").alias("dim"), r6(F.get("vector", F.lit(0))).alias("v0"))


@register
def doc_filter_date_score(spark, sf):
    hits = vector_scan(reviews(spark, sf),
                       ranges={"timestamp": {"gte": "1996-01-01", "lte": "1997-12-31"}, "score": {"gte": 4}},
                       extra=F.col("lang") != "es")
    return hits.select("doc_id", F.size("vector").alias("dim"))


@register
def equality_filter_cap(spark, sf):
    """The size cap is the feature: the first documents by id that match a term filter."""
    return vector_scan(reviews(spark, sf), filters={"lang": "en"}, size=100).select("doc_id")


@register
def lookup_by_ids(spark, sf):
    ids = table(spark, sf, "labels").where("toxic = 1").select("doc_id").unionByName(
        table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("doc_id")))
    return lookup(table(spark, sf, "documents"), ids, ["lang", "n_chars"])


@register
def profile_fields(spark, sf):
    p = Profile(id="o_orderkey", vector="v", text=("o_orderpriority", "o_orderstatus"), timestamp="o_orderdate",
                score=ScoreField("o_totalprice", "numeric"), category="o_orderstatus")
    rows = logical(table(spark, sf, "orders").withColumn("v", F.array(F.col("o_totalprice"))), p)
    return rows.select("doc_id", F.col("timestamp").cast("date").alias("day"), "score", "text_0", "text_1", "category")


# -- scalar expressions ---------------------------------------------------------------

@register
def first_text(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("a"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("b"))
    return docs.join(items, "doc_id", "left").select(
        "doc_id", F.md5(T.first_text([F.lit(""), F.col("a"), F.col("b")])).alias("text_md5"))


@register
def clean_docs(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("clean", T.usable_text(F.concat(F.lit(" \n"), "text", F.lit("\t "))))
    return turns.where("clean IS NOT NULL").select("conv_id", "turn", F.md5("clean").alias("clean_md5"))


@register
def month_bounds(spark, sf):
    d = F.col("o_orderdate").cast("date")
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format(d, "MMMM").alias("name"),
                                             F.concat(F.date_format(d, "MMM"), F.lit(".")).alias("short"),
                                             F.year(d).alias("y"))
    m = D.month_number(F.col("short"))
    return rows.select("o_orderkey", D.month_number(F.upper("name")).alias("m_full"), m.alias("m_short"),
                       D.month_number_wide(F.lit("Sept")).alias("m_wide"),
                       D.month_number(F.lit("sept")).alias("m_sept"),
                       D.month_first(F.col("y"), m).alias("first_day"), D.month_last(F.col("y"), m).alias("last_day"),
                       D.year_first(F.col("y")).alias("year_first"), D.year_last(F.col("y")).alias("year_last"),
                       F.date_format(D.month_last(F.col("y"), m), "yyyy-MM-dd").alias("iso"))


@register
def tag_and_digits(spark, sf):
    p = table(spark, sf, "part")
    tag = (F.when(F.col("p_size") < 15, F.concat(F.lit("B-"), "p_type"))
            .when(F.col("p_size") < 30, F.concat(F.lit("I-LABEL_"), "p_size")).otherwise(F.col("p_type")))
    return p.select("p_partkey", T.tag_group(tag).alias("grp"), T.digits_int(F.col("p_brand")).alias("brand_no"),
                    T.digits_int(F.col("p_name")).alias("name_no"))


@register
def token_counts(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"),
                       F.size(F.array_distinct(T.words(F.col("text")))).alias("n_distinct"),
                       F.size(T.blank_tokens(F.col("text"))).alias("n_tokens"))


# -- filters ---------------------------------------------------------------------------

@register
def score_terms_filter(spark, sf):
    numeric, keyword = ScoreField(type="numeric"), ScoreField()
    text = ScoreField(cast="string")
    s = F.col("score")
    return reviews(spark, sf).select(
        "doc_id", score_predicate(s, keyword, gte=4).alias("kw_from_4"),
        score_predicate(s, keyword, gte=5, lte=3).alias("kw_swapped"),
        score_predicate(s.cast("string"), text, lte=2).alias("text_to_2"),
        score_predicate(s, numeric, gte=2).alias("num_from_2"),
        score_predicate(s, numeric).alias("num_all"))


@register
def topic_must_match(spark, sf):
    docs = table(spark, sf, "documents")
    q = F.concat(F.lit("trends in FOODS "), F.when(F.col("lang") == "de", "and Electronics").otherwise(""))
    hit = matches_terms([F.col("text")], topic_terms(q, TOPICS))
    return docs.where(hit).select("doc_id", "lang")


@register
def synonym_union(spark, sf):
    q = questions(spark, sf)
    return q.select("query_id", F.array_join(topic_terms(F.col("query"), TOPICS), " ").alias("terms"))


@register
def category_from_query(spark, sf):
    return questions(spark, sf).select("query_id", Q.coarse_category(F.col("query")).alias("category"))


@register
def keyword_filter(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    ents = F.transform(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0)), lambda w, i: F.struct(
        i.alias("pos"), w.alias("word"),
        F.when(F.length(w) > 14, "ORG").when(F.length(w) > 11, "PRODUCT").otherwise("PER").alias("entity_group")))
    keys = Q.keywords(ents)
    return turns.select("conv_id", "turn", F.size(keys).alias("n_keywords"),
                        has_keyword(F.col("text"), F.array(F.lit("und"), F.lit("les"))).alias("hit"),
                        has_keyword(F.col("text"), keys).alias("own_hit"))


# -- questions ----------------------------------------------------------------------------

@register
def gazetteer_tags(spark, sf):
    return questions(spark, sf).select("query_id", F.explode(Q.entities(F.col("query"))).alias("e")).select(
        "query_id", "e.pos", "e.word", "e.entity_group")


@register
def query_meta_entities(spark, sf):
    rows = Q.entity_dates(questions(spark, sf).withColumn("entities", Q.entities(F.col("query"))))
    return rows.select("query_id", F.col("tag_start").alias("start_date"), F.col("tag_end").alias("end_date"),
                       F.col("tag_score").alias("rating_gte"), F.col("tag_score").alias("rating_lte"))


def _textual(spark, sf):
    return Q.text_dates(questions(spark, sf)).select(
        "query_id", F.col("text_start").alias("start_date"), F.col("text_end").alias("end_date"),
        F.col("text_gte").alias("rating_gte"), F.col("text_lte").alias("rating_lte"))


@register
def query_meta_fallback(spark, sf):
    return _textual(spark, sf)


@register
def query_meta_merged(spark, sf):
    return Q.parse_questions(questions(spark, sf)).select(
        "query_id", "start_date", "end_date", "rating_gte", "rating_lte")


@register
def rating_comparators(spark, sf):
    return Q.parse_questions(questions(spark, sf), rating_mode="comparators").select(
        "query_id", "rating_gte", "rating_lte")


@register
def date_range_iso_relative(spark, sf):
    return Q.date_range(questions(spark, sf)).select("query_id", "start_date", "end_date")


@register
def span_months_rating(spark, sf):
    return Q.metadata_row(questions(spark, sf)).select(
        "query_id", "start_date", "end_date", "rating_gte", "rating_lte")


@register
def months_in_span(spark, sf):
    d = F.col("o_orderdate").cast("date")
    span = F.concat(F.date_format(d, "MMMM"),
                    F.when(F.col("o_orderstatus") == "F", " to ").when(F.col("o_orderstatus") == "O", "-").otherwise("–"),
                    F.lower(F.date_format(F.add_months(d, 2), "MMM")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(
        F.transform(Q.months_in_span(span), lambda m: m.cast("string")), ",").alias("months"))


@register
def normalised_bounds(spark, sf):
    q = _textual(spark, sf)
    rating = F.when(F.col("rating_gte").isNotNull(), F.struct(F.col("rating_gte").alias("gte"), F.col("rating_lte").alias("lte")))
    day = F.dayofmonth("start_date")
    rng = F.when(F.month("start_date") > 6, F.struct(F.lit(1).alias("gte"), F.month("start_date").alias("lte")))
    b = Q.normal_bounds(rating, rng, day)
    return q.withColumn("b", b).select("query_id", "b.gte", "b.lte")


@register
def span_collapse(spark, sf):
    return L.collapse_spans(dealt(cut(tagged_words(spark, sf)), "query_id"), "query_id")


# -- retrieval for many questions -------------------------------------------------------------

def _asked(spark, sf):
    q = Q.parse_questions(questions(spark, sf)).drop("entities")
    return cut(filter_sets(q.withColumn("terms", topic_terms(F.col("query"), TOPICS))))


def _review_table(spark, sf):
    p = TOPICS
    return logical(reviews(spark, sf), p), p


@register
def query_doc_range_join(spark, sf):
    docs, p = _review_table(spark, sf)
    asked = _asked(spark, sf)
    per_set = candidates(asked, docs, p, keep=()).groupBy("set_id").agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return attach(asked.select("query_id", "set_id"), per_set, ["set_id"], row_bytes=32).drop("set_id")


@register
def candidate_status(spark, sf):
    docs, p = _review_table(spark, sf)
    asked = _asked(spark, sf)
    # Documents without a vector can't be clustered and don't count.
    usable = docs.where("vector IS NOT NULL")
    counts = candidates(asked.where("intent = 'trend_analysis'"), usable, p, keep=()).groupBy("set_id").agg(
        F.count("*").alias("n_candidates"))
    return candidate_gates(asked, counts).select("query_id", "n_candidates", "status", "message")


@register
def score_violation_probe(spark, sf):
    docs, p = _review_table(spark, sf)
    asked = _asked(spark, sf)
    none = F.lit(None).cast("int")
    loose = asked.withColumns({"rating_gte": none, "rating_lte": none})
    found = candidates(loose, docs, p, keep=("score",))
    per_set = score_violations(found, asked, p)
    return attach(asked.select("query_id", "set_id"), per_set, ["set_id"], row_bytes=32).drop("set_id")


def _topic_requests(docs: DataFrame) -> DataFrame:
    langs = docs.select("lang").distinct()
    q = F.concat(F.lit("food "), F.when(F.col("lang") == "de", "electronics").otherwise(""))
    return langs.select(F.xxhash64("lang").alias("set_id"), "lang", topic_terms(q, TOPICS).alias("terms"))


@register
def bm25_topk(spark, sf):
    """The most relevant twenty documents for each language's topic terms."""
    docs = table(spark, sf, "documents")
    asked = _topic_requests(docs)
    scores = bm25(docs, asked, ["text", "source"])
    best = top_per_group(scores, ["set_id"], [F.round("relevance", 9).desc(), F.col("doc_id")], 20)
    return attach(best, asked, ["set_id"]).select("lang", "doc_id", "rank", r6("relevance").alias("relevance"))


@register
def relevance_cap(spark, sf):
    """The size cap by relevance: at most fifty documents per language."""
    docs = table(spark, sf, "documents")
    asked = _topic_requests(docs)
    found = docs.select(F.xxhash64("lang").alias("set_id"), "doc_id")
    return attach(ranked_cap(found, bm25(docs, asked, ["text"]), 50), asked, ["set_id"]).select("lang", "doc_id")


# -- vectors ---------------------------------------------------------------------------------

def _points(spark, sf):
    v = planted(spark, sf)
    return v, cut(distinct_points(v, keep=MEMBERS))


def _reach(spark, sf):
    _, p = _points(spark, sf)
    edges = cut(knn(p, NEIGHBOURS))
    m = p.select("set_id").distinct().withColumn("m", F.lit(NEIGHBOURS))
    cores = cut(core_distances(edges, p, m))
    return p, cores, mutual_reachability(edges, cores)


@register
def knn_cosine_exact(spark, sf):
    v, p = _points(spark, sf)
    near = document_neighbours(v, p, knn(p, NEIGHBOURS, metric="cosine"), NEIGHBOURS)
    return near.select("doc_id", "nbr_doc", "rank", r6("dist").alias("dist"))


@register
def knn_euclidean_pivots(spark, sf):
    v, p = _points(spark, sf)
    near = document_neighbours(v, p, knn(p, NEIGHBOURS, block=128, pivots=8), NEIGHBOURS)
    return near.select("doc_id", "nbr_doc", "rank", r6("dist").alias("dist"))


@register
def core_distance(spark, sf):
    return _reach(spark, sf)[1].select("point_id", r6("core").alias("core"))


@register
def mutual_reach_edges(spark, sf):
    return _reach(spark, sf)[2].select("a", "b", r6("w").alias("w"))


@register
def components_at_level(spark, sf):
    p, _, edges = _reach(spark, sf)
    near = cut(edges.where(F.col("w") <= LEVEL))
    return components(near, p).select("point_id", "comp")


@register
def spanning_forest_edges(spark, sf):
    return spanning_forest(cut(_reach(spark, sf)[2])).select("a", "b", r6("w").alias("w"))


@register
def exact_forest_weights(spark, sf):
    """The tree of all pairs, not only of neighbours."""
    p, cores, near = _reach(spark, sf)
    rows = exact_forest(p, cores, near)
    return rows.agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 4).alias("total"), r6(F.max("w")).alias("heaviest"))


@register
def adaptive_params(spark, sf):
    n = F.col("n").cast("int")
    return reviews(spark, sf).groupBy(F.year("timestamp").alias("y"), "score").agg(F.count("*").alias("n")).select(
        "y", "score", "n", adapted_neighbours(n, 30).alias("neighbours"), adapted_components(n, 20).alias("components"),
        adapted_cluster_size(n, 25).alias("min_size"))


@register
def density_planted(spark, sf):
    """Clusters of the planted points, each named by its smallest document."""
    found = cluster_vectors(planted(spark, sf).drop("label"), Settings(method="none", min_cluster_size=25))
    name = found.groupBy("set_id", "cluster_id").agg(F.min("doc_id").alias("cluster"))
    return attach(found, name, ["set_id", "cluster_id"], row_bytes=32, spread=F.col("doc_id")).select("doc_id", "cluster")


@register
def density_review_sets(spark, sf):
    """Clusters and membership of the reviews of every score, after reduction."""
    rows = reviews(spark, sf).where("vector IS NOT NULL").select(
        F.col("score").cast("long").alias("set_id"), "doc_id", "vector")
    return cluster_vectors(rows).select("set_id", "doc_id", "cluster_id", r6("probability").alias("probability"))


@register
def reduce_pca(spark, sf):
    _, p = _points(spark, sf)
    return pca(p, 20).select("point_id", F.size("z").alias("dim"), r6(F.abs(F.get("z", F.lit(0)))).alias("z0"))


def _fuzzy(spark, sf):
    _, p = _points(spark, sf)
    return fuzzy_weights(knn(p, 15, metric="cosine"))


@register
def neighbour_weights(spark, sf):
    return _fuzzy(spark, sf).select("point_id", "nbr_id", r6("weight").alias("weight"))


@register
def reduce_spectral(spark, sf):
    z = spectral(cut(_fuzzy(spark, sf)), 10, rounds=8)
    return z.select("point_id", F.size("z").alias("dim"))


@register
def reduce_layout(spark, sf):
    z = neighbour_layout(cut(_fuzzy(spark, sf)), 5, rounds=5)
    return z.select("point_id", F.size("z").alias("dim"))


@register
def document_text_vectors(spark, sf):
    docs = table(spark, sf, "documents")
    vec = text_vectors(docs, fit_text_vectors(docs, features=256, size=16))
    return vec.select("doc_id", F.size("vector").alias("dim"))


# -- clusters -----------------------------------------------------------------------------------

@register
def cluster_sizes(spark, sf):
    return X.cluster_sizes(given_clusters(spark, sf))


@register
def noise_counts(spark, sf):
    return X.noise_counts(given_clusters(spark, sf))


@register
def distinct_clusters(spark, sf):
    return X.distinct_clusters(given_clusters(spark, sf))


@register
def centroids(spark, sf):
    c = X.centroids(given_clusters(spark, sf))
    return c.select("set_id", "cluster_id", F.posexplode("centroid").alias("dim", "v")).select(
        "set_id", "cluster_id", "dim", r6("v").alias("value"))


@register
def exemplars_topk(spark, sf):
    near = X.exemplars(given_clusters(spark, sf), 5)
    return near.select("set_id", "cluster_id", "doc_id", "rank", r6("dist").alias("dist"))


@register
def tfidf_labels(spark, sf):
    members = given_clusters(spark, sf)
    near = cut(X.exemplars(members, 50))
    docs = lookup(table(spark, sf, "documents"), near, ["text"]).join(near, "doc_id")
    return keyword_labels(docs, max_docs=50, max_terms=2000)


@register
def tfidf_labels_all(spark, sf):
    """Labels from all members of each cluster and all of their terms."""
    members = given_clusters(spark, sf).where("cluster_id <> -1").select("set_id", "cluster_id", "doc_id")
    return keyword_labels(members.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"))


def _described(spark, sf):
    """Clusters with size, a label made of their sources, and their smallest documents."""
    rows = given_clusters(spark, sf).where("cluster_id <> -1").join(
        table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.groupBy("set_id", "cluster_id").agg(
        F.count("*").alias("size"), F.concat_ws(", ", F.min("lang"), F.max("source")).alias("label"),
        F.array(F.min("doc_id"), F.max("doc_id")).alias("exemplar_ids"))


@register
def summary_lines(spark, sf):
    return R.summaries(_described(spark, sf))


@register
def report_struct_long(spark, sf):
    rows = R.cluster_structs(_described(spark, sf), by_size=True)
    return rows.select("set_id", F.posexplode("clusters").alias("place", "c")).select(
        "set_id", "place", "c.cluster_id", "c.size", "c.label",
        F.array_join(F.transform("c.exemplar_ids", lambda i: i.cast("string")), ",").alias("exemplars"))


@register
def prompt_column(spark, sf):
    ids = _described(spark, sf).select("set_id", "cluster_id", F.get("exemplar_ids", F.lit(0)).alias("doc_id"))
    text = lookup(table(spark, sf, "documents"), ids, ["text"])
    told = R.prompts(ids.join(text, "doc_id"))
    sets = given_clusters(spark, sf).select("set_id").distinct()
    return sets.join(told, "set_id", "left").select("set_id", F.md5(R.prompt_or_none(F.col("prompt"))).alias("prompt_md5"))


@register
def title_extract(spark, sf):
    clusters = _described(spark, sf)
    bullet = F.concat(F.lit("• **About "), "label", F.lit("** — seen often, **very** often"))
    lines = F.sort_array(F.collect_list(F.struct("cluster_id", bullet.alias("b"))))
    told = clusters.where("cluster_id < 6").groupBy("set_id").agg(F.concat(
        F.lit("Here they are:\n"), F.array_join(F.transform(lines, lambda e: e.b), "\n")).alias("answer"))
    return R.titled_clusters(clusters, told).select("set_id", "cluster_id", "title", "line")


# -- labelled data ---------------------------------------------------------------------------------

def _rows(spark, sf):
    """Question text and one label per word: dates with dashes do not align."""
    q = questions(spark, sf).select("query_id", F.col("query").alias("text"))
    labels = F.array_join(F.transform(T.words(F.col("text")), lambda w: F.coalesce(
        F.concat(F.lit("B-"), Q.guess_group(w)), F.lit("O"))), " ")
    return q.withColumn("labels", labels)


@register
def token_alignment(spark, sf):
    rows = L.align_tokens(_rows(spark, sf))
    return rows.select("query_id", F.size("tokens").alias("n_tokens"), F.size("label_list").alias("n_labels"), "aligned")


@register
def label_vocabulary(spark, sf):
    good, _ = L.token_examples(_rows(spark, sf), "query_id")
    return L.label_vocabulary(L.token_rows(good, "query_id"), "tag")


@register
def first_piece_labels(spark, sf):
    w = tagged_words(spark, sf)
    size = F.ceil(F.length("word") / 4).cast("int")
    pieces = w.select("query_id", F.col("pos").alias("word_index"), F.length("tag").alias("label_id"),
                      F.explode(F.sequence(F.lit(1), size)).alias("piece"))
    return L.first_piece_labels(pieces, "query_id")


@register
def ratio_split_sizes(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id")
    return L.ratio_split(rows, "doc_id", 0.8).groupBy("split").agg(F.count("*").alias("n"))


@register
def stratified_split_sizes(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    return L.stratified_split(rows, "doc_id").groupBy("label", "split").agg(F.count("*").alias("n"))


@register
def argmax_label(spark, sf):
    items = table(spark, sf, "lineitem")
    scores = F.create_map(F.lit("quantity"), F.col("l_quantity") / 50, F.lit("discount"), F.col("l_discount") * 10,
                          F.lit("tax"), F.col("l_tax") * 12)
    rows = items.select("l_orderkey", "l_linenumber", scores.alias("scores"))
    return rows.groupBy(L.best_label(F.col("scores")).alias("best"),
                        L.best_label(F.col("scores"), ["tax", "discount"]).alias("best_of_two")).agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


@register
def accuracy(spark, sf):
    rows = table(spark, sf, "labels").withColumn("guess", 1 - F.col("toxic"))
    return L.accuracy(rows, "guess", "quality").select("n", r6("accuracy").alias("accuracy"))


@register
def entity_f1(spark, sf):
    gold = dealt(cut(tagged_words(spark, sf)), "query_id")
    plain = gold.withColumn("tag", F.coalesce(F.concat(F.lit("B-"), Q.guess_group(F.col("word"))), F.lit("O")))
    s = L.entity_f1(L.collapse_spans(gold, "query_id"), L.collapse_spans(plain, "query_id"), "query_id")
    return s.select("tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@register
def intent_scores(spark, sf):
    rows = questions(spark, sf).select("query_id", F.col("query").alias("text"), F.col("intent").alias("label"))
    split = cut(L.stratified_split(rows, "query_id"))
    model = L.fit_intent(split.where("split = 'train'"))
    scored = L.score_intent(split.where("split = 'eval'"), model)
    return scored.select("query_id", "label", "intent", F.size("scores").alias("classes"))


@register
def trained_tagger(spark, sf):
    words = L.ratio_split(cut(tagged_words(spark, sf)), "query_id", together=True)
    model = L.fit_tagger(dealt(words.where("split = 'train'"), "query_id"), "query_id", features=1 << 10, rounds=15)
    return L.tag_tokens(dealt(words.where("split = 'eval'"), "query_id"), "query_id", model).select(
        "query_id", "pos", "word", "tag", "predicted")


# -- end to end ----------------------------------------------------------------------------------------

@register
def analyze_report(spark, sf):
    """Reports of all questions: a row for each cluster, one row for a question without any."""
    asked, clusters, totals = analyze(all_questions(spark, sf), reviews(spark, sf), TOPICS)
    return report_rows(asked, clusters, totals).select(
        "query_id", "query", "status", "n_candidates", "cluster_id", "size", "label",
        F.array_join(F.transform("exemplar_ids", lambda i: i.cast("string")), ",").alias("exemplars"),
        "total_vectors", "noise_points")


@register
def analyze_totals(spark, sf):
    """Of every question: the gate it stops at, its candidates, and how many of them its clusters and noise hold."""
    asked, clusters, totals = analyze(all_questions(spark, sf), reviews(spark, sf), TOPICS)
    sizes = clusters.groupBy("set_id").agg(F.sum("size").alias("in_clusters"))
    held = totals.join(sizes, "set_id", "left").select(
        "set_id", (F.coalesce("in_clusters", F.lit(0)) + F.col("noise_points")).alias("held"))
    gate = F.when(F.col("status") == "no_clusters", "ok").otherwise(F.col("status"))
    held = attach(asked, held, ["set_id"], how="left", row_bytes=24, spread=F.col("query_id"))
    return held.select("query_id", gate.alias("gate"), "n_candidates", F.when(gate == "ok", F.col("held")).alias("held"))
