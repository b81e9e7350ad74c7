"""Filters, candidate retrieval for many questions at once, gates and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import words
from themeloom.operators.skew import attach, fits_broadcast, SALTS
from themeloom.profile import Profile, ScoreField, text_columns

MIN_CANDIDATES = 20

# Per-question outcomes and the messages users see.
MESSAGES = {
    "not_trend": "I can only analyze trends right now. Please ask about 'top trends'.",
    "no_date_range": "Could not determine a date range from your query.",
    "too_few": "Not enough reviews (%d) with the specified filters.",
    "no_clusters": "No significant trends detected by clustering.",
}


# -- predicates for one fixed filter ------------------------------------------

def all_of(clauses: Sequence[Column]) -> Column:
    """Conjunction; no clause matches everything."""
    out = F.lit(True)
    for c in clauses:
        out = out & c
    return out


def term_predicate(filters: Mapping[str, object]) -> Column:
    return all_of([F.col(k) == F.lit(v) for k, v in filters.items()])


def range_predicate(ranges: Mapping[str, Mapping[str, object]]) -> Column:
    clauses = []
    for name, bounds in ranges.items():
        if bounds.get("gte") is not None:
            clauses.append(F.col(name) >= F.lit(bounds["gte"]))
        if bounds.get("lte") is not None:
            clauses.append(F.col(name) <= F.lit(bounds["lte"]))
    return all_of(clauses)


def date_window(ts: Column, start: Column, end: Column) -> Column:
    """Inclusive at both ends, for dates and for timestamps."""
    return (ts >= start) & (ts < F.date_add(end, 1))


def score_predicate(score: Column, field: ScoreField, gte: int | None = None,
                    lte: int | None = None) -> Column:
    """Bounds on a numeric score, or the list of values for a keyword score."""
    lo = field.min if gte is None else gte
    hi = field.max if lte is None else lte
    if lo > hi:
        lo, hi = hi, lo
    if field.type == "numeric":
        clauses = []
        if gte is not None:
            clauses.append(score >= lo)
        if lte is not None:
            clauses.append(score <= hi)
        return all_of(clauses)
    values = [str(v) if field.cast == "string" else v for v in range(lo, hi + 1)]
    return score.isin(values)


def vector_scan(docs: DataFrame, *, filters: Mapping[str, object] | None = None,
                ranges: Mapping[str, Mapping[str, object]] | None = None,
                extra: Column | None = None, size: int | None = None) -> DataFrame:
    """Ids and vectors of matching documents, nothing else is read.

    ``size`` keeps the first documents by id; by default all are kept.
    """
    hits = docs.where(term_predicate(filters or {})).where(range_predicate(ranges or {}))
    if extra is not None:
        hits = hits.where(extra)
    hits = hits.where(F.col("vector").isNotNull()).select("doc_id", "vector")
    return hits if size is None else hits.orderBy("doc_id").limit(size)


def lookup(docs: DataFrame, ids: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Selected fields of the given ids; unknown ids are absent."""
    picked = docs.select("doc_id", *fields)
    return attach(picked, ids.select("doc_id").distinct(), ["doc_id"], row_bytes=16, even=True)


# -- topic terms ---------------------------------------------------------------

def topic_terms(query: Column, profile: Profile) -> Column:
    """Terms of every profile key the question contains, as one array."""
    q = F.lower(query)
    none = F.array().cast("array<string>")
    groups = [F.when(q.contains(k), F.array(*[F.lit(t) for t in profile.terms_for(k)]))
               .otherwise(none) for k in profile.query_term_map]
    return F.concat(*groups) if groups else none


def matches_terms(texts: Sequence[Column], terms: Column) -> Column:
    """True if any text field holds any term; no terms match everything."""
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.arrays_overlap(F.coalesce(words(t), F.array().cast("array<string>")), terms)
    return (F.size(terms) == 0) | hit


def held_terms(docs: DataFrame, profile: Profile) -> Column:
    """Those of the profile's terms a document holds, found once per document."""
    known = F.array(*[F.lit(t) for t in sorted({t for k in profile.query_term_map for t in profile.terms_for(k)})])
    found = [F.array_intersect(F.coalesce(words(t), F.array().cast("array<string>")), known.cast("array<string>"))
             for t in text_columns(docs)]
    return F.concat(*found)


def has_keyword(text: Column, keywords: Column) -> Column:
    """True if a word of the text is among the keywords; no keywords match everything."""
    return (F.size(keywords) == 0) | F.arrays_overlap(words(text), keywords)


# -- candidates of a table of questions ------------------------------------------

FILTER_COLUMNS = ("start_date", "end_date", "rating_gte", "rating_lte", "terms")


def filter_sets(questions: DataFrame) -> DataFrame:
    """Add ``set_id``: equal filters share it, so equal questions are run once.

    Filters that are numbered already keep their number.
    """
    if "set_id" in questions.columns:
        return questions
    # Hashing the columns themselves would skip nulls, and "at least 4" equal "at most 4".
    marked = F.to_json(F.struct(*FILTER_COLUMNS), {"ignoreNullFields": "false"})
    return questions.withColumn("set_id", F.xxhash64(marked))


def _score_matches(score: Column, field: ScoreField) -> Column:
    gte, lte = F.col("rating_gte"), F.col("rating_lte")
    a = F.coalesce(gte, F.lit(field.min))
    b = F.coalesce(lte, F.lit(field.max))
    lo, hi = F.least(a, b), F.greatest(a, b)
    unbounded = gte.isNull() & lte.isNull()
    if field.type == "numeric":
        return ((gte.isNull() | (score >= lo)) & (lte.isNull() | (score <= hi)))
    if field.cast == "string":
        listed = F.transform(F.sequence(lo, hi), lambda v: v.cast("string"))
        return unbounded | F.array_contains(listed, score)
    return unbounded | (score.between(lo, hi) & (score == F.floor(score)))


def candidates(questions: DataFrame, docs: DataFrame, profile: Profile,
               keep: Sequence[str] = ("vector",), *, with_topic: bool = True) -> DataFrame:
    """Matching documents of every distinct filter: ``set_id, doc_id, *keep``.

    The date range becomes an equi-join on month with the exact range as
    residual.  A small filter table is broadcast, so documents are not moved; a
    large one is joined on month and a salt, since one month may hold a large
    share of the documents.
    """
    sets = (filter_sets(questions)
            .where("start_date IS NOT NULL AND end_date IS NOT NULL AND start_date <= end_date")
            .select("set_id", *FILTER_COLUMNS).dropDuplicates(["set_id"]))
    sets = sets.withColumn("month", F.explode(F.sequence(
        F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("INTERVAL 1 MONTH"))))
    narrow = (docs.select("doc_id", "timestamp", "score", *dict.fromkeys(keep),
                          held_terms(docs, profile).alias("_held"))
              .withColumn("month", F.trunc("timestamp", "month")))
    if fits_broadcast(sets, 256):
        pairs = narrow.join(F.broadcast(sets), "month")
    else:
        narrow = narrow.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        sets = sets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = narrow.join(sets, ["month", "_salt"])
    hit = (date_window(F.col("timestamp"), F.col("start_date"), F.col("end_date"))
           & _score_matches(F.col("score"), profile.score))
    if with_topic:
        hit = hit & ((F.size("terms") == 0) | F.arrays_overlap("_held", F.col("terms")))
    return pairs.where(hit).select("set_id", "doc_id", *keep)


def candidate_gates(questions: DataFrame, counts: DataFrame, *, intent: str = "intent",
                    minimum: int = MIN_CANDIDATES) -> DataFrame:
    """Status and message of every question before clustering.

    ``counts`` has ``set_id, n_candidates``; a set without a row has none.
    """
    q = filter_sets(questions)
    q = attach(q, counts.select("set_id", "n_candidates"), ["set_id"], how="left", row_bytes=24)
    n = F.coalesce(F.col("n_candidates"), F.lit(0)).cast("long")
    status = (F.when(F.col(intent) != "trend_analysis", "not_trend")
               .when(F.col("start_date").isNull() | F.col("end_date").isNull(), "no_date_range")
               .when(n < minimum, "too_few")
               .otherwise("ok"))
    return with_message(q.withColumn("n_candidates", n).withColumn("status", status))


def with_message(df: DataFrame) -> DataFrame:
    s = F.col("status")
    msg = (F.when(s == "too_few", F.format_string(MESSAGES["too_few"], F.col("n_candidates")))
            .when(s == "not_trend", MESSAGES["not_trend"])
            .when(s == "no_date_range", MESSAGES["no_date_range"])
            .when(s == "no_clusters", MESSAGES["no_clusters"]))
    return df.withColumn("message", msg)


def score_violations(found: DataFrame, sets: DataFrame, profile: Profile) -> DataFrame:
    """Candidates per set whose score breaks the requested bounds (should be 0)."""
    bounds = sets.select("set_id", "rating_gte", "rating_lte").dropDuplicates(["set_id"])
    joined = attach(found.select("set_id", "doc_id", "score"), bounds, ["set_id"], row_bytes=24,
                    spread=F.col("doc_id"))
    bad = ~_score_matches(F.col("score"), profile.score) | F.col("score").isNull()
    return joined.groupBy("set_id").agg(F.count("*").alias("n_candidates"),
                                        F.count_if(bad).alias("n_violations"))
