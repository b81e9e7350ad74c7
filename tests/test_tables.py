"""Sources, sinks, filters, splits and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.functions import text as T
from themeloom.operators import training as L
from themeloom.operators.keywords import heaviest, keyword_labels, labels_of_few
from themeloom.operators.reduce import curve_constants, fuzzy_weights
from themeloom.operators.relevance import bm25
from themeloom.operators.retrieve import candidates, date_window, score_predicate, topic_terms, vector_scan
from themeloom.plans.analyze import FIVE_EXAMPLES, Settings, analyze, describe_clusters, reports
from themeloom.profile import ELECTRONICS_REVIEWS, FOOD_REVIEWS, Profile, ScoreField, logical
from themeloom.session import cut
from themeloom.sources.documents import read_documents, write_documents
from themeloom.sources.labelled import read_labelled, read_token_labels, write_token_labels


def test_csv_documents(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Text,Score,timestamp\n"good, ""very""\ntea",5,2011-05-01\nbad,x,2011-06-31\n')
    rows = read_documents(spark, str(tmp_path / "r.csv")).orderBy(F.length("text").desc()).collect()
    assert rows[0]["text"] == 'good, "very"\ntea' and rows[0]["score"] == 5.0
    assert rows[1]["score"] is None and rows[1]["timestamp"] is None
    assert all(r["doc_id"] >= 0 for r in rows)
    with pytest.raises(ValueError):
        read_documents(spark, str(tmp_path / "r.csv"), {"text": "Body"})


def test_document_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2011-05-01"), (2, "2011-06-03")], "doc_id long, timestamp string").withColumn(
        "timestamp", F.to_date("timestamp"))
    path = str(tmp_path / "docs")
    write_documents(rows, path, recreate=True)
    write_documents(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert {r["month"] for r in back.select(F.col("month").cast("string").alias("month")).collect()} == {"2011-05", "2011-06"}
    write_documents(rows, path, recreate=True)
    assert spark.read.parquet(path).count() == 2


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"hi, bot",greeting\n')
    (tmp_path / "b.csv").write_text("text,intent\nx,y\n")
    assert read_labelled(spark, str(tmp_path / "a.csv")).collect()[0]["text"] == "hi, bot"
    with pytest.raises(ValueError):
        read_labelled(spark, str(tmp_path / "b.csv"))


def test_token_label_lines(spark, tmp_path):
    rows = spark.createDataFrame([(["may", "2011"], ["B-MONTH", "B-YEAR"])], "tokens array<string>, labels array<string>")
    write_token_labels(rows, str(tmp_path / "t"))
    assert read_token_labels(spark, str(tmp_path / "t")).collect() == rows.collect()


def test_profiles(spark):
    assert FOOD_REVIEWS.terms_for("food") == ["food", "foods", "grocery", "snack", "snacks"]
    docs = spark.createDataFrame([(1, "a", "b", "c", 3, [1.0])],
                                 "doc_id long, text string, title string, timestamp string, rating int, review_embedding array<double>")
    out = logical(docs.withColumn("category", F.lit("x")), ELECTRONICS_REVIEWS)
    assert out.columns == ["doc_id", "timestamp", "score", "vector", "text_0", "text_1", "category"]


def test_text_functions(spark):
    df = spark.createDataFrame([("  ab cd　",), ("abc",), (None,), (" \t",)], "t string")
    assert [r[0] for r in df.select(T.usable_text(F.col("t"))).collect()] == ["ab cd", None, None, None]
    assert [r[0] for r in df.select(T.blank_tokens(F.col("t"))).collect()] == [["ab", "cd"], ["abc"], None, []]
    one = spark.range(1)
    assert one.select(T.words(F.lit("Éa-b_1 ß"))).head()[0] == ["éa", "b_1", "ß"]
    assert one.select(T.first_text([F.lit(None).cast("string"), F.lit(""), F.lit("x")])).head()[0] == "x"
    assert one.select(T.digits_int(F.lit("x99999999999"))).head()[0] is None
    assert one.select(T.tag_group(F.lit("B-LABEL_3"))).head()[0] == ""


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    (spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 6).cast("int").alias("score"),
                             F.date_add(F.lit("2011-01-01").cast("date"), F.col("id").cast("int")).alias("timestamp"),
                             F.array(F.lit(1.0)).alias("vector"), F.lit("long text").alias("text")).write.parquet(path))
    hits = vector_scan(spark.read.parquet(path), ranges={"timestamp": {"gte": "2011-02-01"}, "score": {"lte": 3}})
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp)" in plan or "GreaterThanOrEqual(timestamp" in plan
    assert "text" not in plan.split("ReadSchema")[1]


def test_date_window_keeps_the_whole_last_day(spark):
    t = spark.createDataFrame([("2011-01-31 23:59:59",), ("2011-02-01 00:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    d = lambda s: F.lit(s).cast("date")
    assert t.where(date_window(F.col("t"), d("2011-01-01"), d("2011-01-31"))).count() == 1


def test_score_predicates(spark):
    s = spark.range(7).select(F.col("id").cast("int").alias("s"))
    pick = lambda f, **kw: [r[0] for r in s.where(score_predicate(F.col("s"), f, **kw)).orderBy("s").collect()]
    assert pick(ScoreField(), gte=4) == [4, 5]
    assert pick(ScoreField(type="numeric"), gte=4) == [4, 5, 6]
    assert pick(ScoreField(), gte=4, lte=2) == [2, 3, 4]
    assert pick(ScoreField(type="numeric")) == list(range(7))


def _reviews(spark, n=400):
    d = F.date_add(F.lit("2011-01-01").cast("date"), (F.col("id") % 365).cast("int"))
    axis = (F.col("id") % 4).cast("int")
    vec = F.array(*[F.when(axis == i, 3.0).otherwise(0.0) + (F.xxhash64(F.lit(i), "id") % 1000) / 4000.0 for i in range(6)])
    return spark.range(n).select(F.col("id").alias("doc_id"), d.alias("timestamp"), (F.col("id") % 5 + 1).cast("int").alias("score"),
                                 vec.alias("vector"), F.concat(F.lit("Great food number "), axis.cast("string")).alias("text"))


def _profile():
    return Profile(query_term_map={"food": ("food",), "tea": ("tea",)}, synonyms={"food": ("snack",)})


def _asked(spark):
    rows = [(1, "top trends in food for jan to dec 2011", "trend_analysis"), (2, "food themes, jan to dec 2011", "trend_analysis"),
            (3, "tea trends jan to dec 2011", "trend_analysis"), (4, "trends in 2011", "trend_analysis"), (5, "hi", "greeting"),
            (6, "trends jan to dec 2011 score 5", "trend_analysis")]
    return spark.createDataFrame(rows, "query_id long, query string, intent string")


def test_analyze_every_status(spark):
    s = Settings(min_cluster_size=10)
    asked, clusters, totals = analyze(_asked(spark), _reviews(spark), _profile(), s)
    got = {r["query_id"]: r for r in reports(asked, clusters, totals, s).collect()}
    assert [got[i]["status"] for i in range(1, 7)] == ["ok", "ok", "too_few", "no_date_range", "not_trend", "ok"]
    assert got[1]["set_id"] == got[2]["set_id"] and got[1]["summary"] == got[2]["summary"]
    assert len(got[1]["clusters"]) == 4
    assert got[1]["total_vectors"] == got[1]["noise_points"] + sum(c["size"] for c in got[1]["clusters"])
    assert got[3]["summary"] == "Not enough reviews (0) with the specified filters."
    assert "great food" in got[1]["clusters"][0]["label"]
    assert got[1]["summary"].splitlines()[0].startswith("- Cluster 0 (n=")


def test_five_example_form_and_cap(spark):
    s = Settings(**{**FIVE_EXAMPLES.__dict__, "min_cluster_size": 10})
    asked, clusters, totals = analyze(_asked(spark), _reviews(spark), _profile(), s)
    r = [x for x in reports(asked, clusters, totals, s).collect() if x["query_id"] == 1][0]
    sizes = [c["size"] for c in r["clusters"]]
    assert sizes == sorted(sizes, reverse=True) and all(len(c["exemplar_ids"]) == 5 for c in r["clusters"])
    capped = Settings(size=50, min_cluster_size=10)
    _, _, totals = analyze(_asked(spark), _reviews(spark), _profile(), capped)
    assert max(t["total_vectors"] for t in totals.collect()) == 50


def test_large_filter_table_uses_salted_join(spark, monkeypatch):
    from themeloom.operators import retrieve
    from themeloom.plans.questions import parse_questions

    p = _profile()
    asked = parse_questions(_asked(spark)).withColumn("terms", topic_terms(F.col("query"), p))
    docs = logical(_reviews(spark), p)
    want = sorted(map(tuple, candidates(asked, docs, p, keep=()).collect()))
    monkeypatch.setattr(retrieve, "fits_broadcast", lambda df, n: False)
    assert sorted(map(tuple, candidates(asked, docs, p, keep=()).collect())) == want


def test_bm25_counts_repeated_terms_twice(spark):
    docs = spark.createDataFrame([(1, "tea tea milk"), (2, "milk"), (3, None)], "doc_id long, text string")
    ask = spark.createDataFrame([(0, ["tea"]), (1, ["tea", "tea"])], "set_id long, terms array<string>")
    got = {(r["set_id"], r["doc_id"]): r["relevance"] for r in bm25(docs, ask, ["text"]).collect()}
    assert set(got) == {(0, 1), (1, 1)} and abs(got[1, 1] - 2 * got[0, 1]) < 1e-12


def test_label_edge_cases(spark):
    rows = [(0, 0, 1, 1, "  "), (0, 1, 2, 1, "the and of"), (0, 2, 3, 1, "green tea, green cup"), (0, 2, 4, 2, "abcd")]
    docs = spark.createDataFrame(rows, "set_id long, cluster_id long, doc_id long, rank int, text string")
    got = {r["cluster_id"]: r["label"] for r in keyword_labels(docs).collect()}
    assert got == {0: "(no text)", 1: "(no vocabulary)", 2: "green, cup, green cup, green tea, tea"}


def test_labels_read_their_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = [(0, i % 2, i, f"green tea number {i % 3}") for i in range(12)]
    docs = spark.createDataFrame(rows, "set_id long, cluster_id long, doc_id long, text string")
    got = keyword_labels(docs.withColumn("text", F.udf(seen)("text")), 2).collect()
    assert len(got) == 2 and read.value == 12


def test_alignment_and_strict(spark):
    rows = spark.createDataFrame([(1, " a  b ", "O O"), (2, "a b", "O")], "id long, text string, labels string")
    good, bad = L.token_examples(rows, "id")
    assert good.collect()[0]["tokens"] == ["a", "b"] and [r["id"] for r in bad.collect()] == [2]
    with pytest.raises(ValueError, match="row 2"):
        L.token_examples(rows, "id", strict=True)


def test_splits_are_exact_and_repeatable(spark):
    rows = spark.range(1003).select("id", F.when(F.col("id") < 900, "x").when(F.col("id") < 990, "y").otherwise("z").alias("label"))
    a = {r["id"]: r["split"] for r in L.ratio_split(rows, "id").collect()}
    b = {r["id"]: r["split"] for r in L.ratio_split(rows.repartition(7), "id").collect()}
    assert a == b and sum(v == "train" for v in a.values()) == 802
    s = L.stratified_split(rows, "id").groupBy("label", "split").count().collect()
    n = {(r["label"], r["split"]): r["count"] for r in s}
    assert sum(v for (_, k), v in n.items() if k == "train") == 802
    assert n["z", "eval"] in (2, 3)


def test_split_of_several_rows_an_id(spark):
    ids = spark.range(1003).select("id")
    rows = ids.select("id", F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("pos"))
    for ratio in (0.0, 0.37, 0.8, 1.0):
        want = {r["id"]: r["split"] for r in L.ratio_split(ids, "id", ratio).collect()}
        got = L.ratio_split(rows, "id", ratio, together=True)
        assert all(want[r["id"]] == r["split"] for r in got.collect()) and got.count() == rows.count()
        # Rows are not joined with the ids.
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_tagged_in_their_row(spark):
    from check import SF
    from themeloom.plans.views import tagged_words

    plan = tagged_words(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" in plan


def test_word_shapes(spark):
    t = spark.createDataFrame([(1, 0, "Été2011"), (1, 1, "May-5"), (1, 2, "٣x")], "id long, pos int, word string")
    got = [next(f for f in r["features_text"] if f.startswith("s=")) for r in L._token_features(t, "id").orderBy("pos").collect()]
    assert got == ["s=aaa9999", "s=aaa-9", "s=٣a"]


def test_intent_model(spark):
    rows = [(i, f"top trends for item {i}", "trend_analysis") for i in range(20)] + [
        (100 + i, f"hello there {i}", "greeting") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    out = L.score_intent(df, L.fit_intent(df)).collect()
    assert all(r["intent"] == r["label"] for r in out)
    assert abs(sum(out[0]["scores"].values()) - 1) < 0.05


def test_span_f1_and_pieces(spark):
    t = [(1, 0, "nov", "B-MONTH"), (1, 1, "to", "I-MONTH"), (1, 2, "2011", "B-YEAR"), (1, 3, "x", "O"), (1, 4, "5", "I-SCORE")]
    tokens = spark.createDataFrame(t, "id long, pos int, word string, tag string")
    spans = L.collapse_spans(tokens, "id")
    assert {(r["start"], r["end"], r["entity_group"], r["text"]) for r in spans.collect()} == {
        (0, 1, "MONTH", "nov to"), (2, 2, "YEAR", "2011"), (4, 4, "SCORE", "5")}
    f = L.entity_f1(spans, spans.where("entity_group <> 'YEAR'"), "id").head()
    assert (f["tp"], f["fp"], f["fn"]) == (2, 0, 1) and abs(f["f1"] - 0.8) < 1e-9


def test_f1_deals_spans_to_tasks_by_their_number(spark, monkeypatch):
    from themeloom import session

    rows = [(None if i == 7 else i, 0, 1, "A") for i in range(200)]
    gold = spark.createDataFrame(rows + rows[:9], "id long, start int, end int, entity_group string")
    found = gold.where("id IS NULL OR id % 2 = 0")
    assert L.entity_f1(gold, found, "id").select("tp", "fp", "fn").head() == (100, 1, 100)
    monkeypatch.setattr(session, "SLIM_ROWS", 10)
    plan = L.entity_f1(gold, found, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Join" not in plan and session.dealt(gold, "id").rdd.getNumPartitions() == 21


def test_layout_constants_and_weights(spark):
    a, b = curve_constants(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02
    e = spark.createDataFrame([(0, i, j, abs(i - j) * 1.0) for i in range(6) for j in range(6) if i != j],
                              "set_id long, point_id long, nbr_id long, dist double")
    w = {(r["point_id"], r["nbr_id"]): r["weight"] for r in fuzzy_weights(e).collect()}
    assert all(abs(w[i, j] - w[j, i]) < 1e-12 and 0 < w[i, j] <= 1 for i, j in w)


def test_bounds_on_either_side_are_different_filters(spark):
    from themeloom.operators.retrieve import filter_sets

    rows = spark.createDataFrame([(4, None), (None, 4), (4, None)], "rating_gte int, rating_lte int").selectExpr(
        "date'2011-01-01' AS start_date", "date'2011-02-01' AS end_date", "*", "array('x') AS terms")
    assert filter_sets(rows).select("set_id").distinct().count() == 2


def test_labels_of_few_equal_those_of_all(spark):
    texts = {0: "tea pots and tea cups", 1: "green tea in pots", 2: "the and of", 3: "abc", 4: None, 5: "tea cups, green cups " * 9,
             6: "Ünter Zürich zürich", 7: "beta alpha gamma"}
    held = {(0, 0): [0, 1, 5, 6], (0, 1): [1, 2, 3], (1, 0): [2], (1, 1): [3, 4], (1, 2): [0, 5, 7, 2, 4], (2, 7): [7]}
    table = cut(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    members = cut(spark.createDataFrame([(s, c, d) for (s, c), ids in held.items() for d in ids], "set_id long, cluster_id long, doc_id long"))
    want = {(r.set_id, r.cluster_id): r.label for r in keyword_labels(members.join(table, "doc_id"), 3).collect()}
    got = labels_of_few(members, table, 3).collect()
    assert {(r.set_id, r.cluster_id): r.label for r in got} == want and len(got) == 6
    assert want[1, 0] == "(no vocabulary)" and want[1, 1] == "(no text)" and want[2, 7] == "alpha, alpha gamma, beta"
    term, weight = heaviest([["b", "a"], ["a"]], 1)
    assert term.tolist() == ["a"] and weight[0] == pytest.approx(1 + 1 / np.sqrt(1 + 2 * (np.log(1.5) + 1) ** 2))


def test_texts_of_a_report_are_taken_apart_once(spark, monkeypatch):
    """However many clusters a document stands for."""
    from themeloom.operators import keywords

    read = spark.sparkContext.accumulator(0)

    def seen(words):
        read.add(1)
        return words

    taken = keywords.telling_words
    monkeypatch.setattr(keywords, "telling_words", lambda *a: F.udf(seen, "array<string>")(taken(*a)))
    rows = [(s, 0, d, [float(d), 0.0]) for s in range(5) for d in range(4)]
    members = cut(spark.createDataFrame(rows, "set_id long, cluster_id long, doc_id long, z array<double>"))
    docs = cut(spark.range(4).selectExpr("id AS doc_id", "concat('word', id, ' shared other') AS text_0"))
    got = describe_clusters(members, docs).collect()
    assert len(got) == 5 and {r["label"] for r in got} == {got[0]["label"]} and "shared" in got[0]["label"]
    assert read.value == 4


def test_questions_are_parsed_by_all_cores(spark, monkeypatch):
    """Distinct questions are few bytes, which adaptive execution would give to one task."""
    from themeloom.plans import analyze as module

    class Seen(Exception):
        pass

    def parse(texts, **kw):
        raise Seen(texts.rdd.getNumPartitions(), texts.count())

    monkeypatch.setattr(module, "parse_questions", parse)
    asked = spark.range(90).selectExpr("id AS query_id", "concat('trends in may 20', 10 + id % 30) AS query", "'trend_analysis' AS intent")
    with pytest.raises(Seen) as seen:
        module.analyze(asked, None, Profile())
    assert seen.value.args == (spark.sparkContext.defaultParallelism, 30)
