"""Tables of reviews, questions and labelled points derived from the given data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.profile import Profile
from themeloom.session import spread

# Tables whose rows take long to evaluate: texts, and the orders questions are made of.
TEXTUAL = ("documents", "conversations", "orders")

# A topic profile whose terms occur in a part of the documents.
TOPICS = Profile(
    query_term_map={"electronics": ("nicht", "von"), "food": ("une", "und", "avec")},
    synonyms={"electronics": ("sich",), "food": ("avec", "dans")},
)

# Wording of the derived questions, per order status and priority.  {mon}, {mon2}
# are short names of the order's month and the next, {month} is the full name.
SHAPES = {
    ("F", 1): "which Foods stood out in {mon} to {mon2} {y} at a {s} score",
    ("F", 2): "main subjects {mon} to {mon2} {y}, only score {s}",
    ("F", 3): "what was talked about in {month} {y} at score {s}",
    ("F", 4): "electronics talk {mon} to {mon2} {y} where score is greater than 3",
    ("F", 5): "complaints from {month} {y} to {mon2} {y2}",
    ("O", 1): "opinions since sept {y}",
    ("O", 2): "what parents say about food in {y}",
    ("O", 3): "from {day} {month} {y} to {mon2} {y2}",
    ("O", 4): "{iso2} to {iso}",
    ("O", 5): "whatever came up last month",
    ("P", 1): "find notes on squeaky chairs",
    ("P", 2): "good morning to you",
    ("P", 3): "opinions with score between 2 and 4 around {mon} {y}",
    ("P", 4): "talk of teapots with score 4 or above in {mon}. {y}",
    ("P", 5): "last week with at least 3 star or {day} {month} {y}",
}
INTENTS = {("P", 1): "simple_search", ("P", 2): "greeting"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Rows are counted from the files' footers.
    return spread(df, df.count()) if name in TEXTUAL else df


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``set_id, doc_id, vector, label``: embeddings with their label's axis raised."""
    raised = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(
        i == F.col("label"), 2.0).otherwise(0.0))
    return table(spark, sf_dir, "embeddings").select(
        F.lit(0).cast("long").alias("set_id"), F.col("vec_id").alias("doc_id"),
        raised.alias("vector"), "label")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dated and scored by the order of the same number."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("timestamp"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("score"))
    vectors = planted(spark, sf_dir).select("doc_id", "vector")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.join(orders, "doc_id").join(vectors, "doc_id", "left")


def given_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted points with their label as cluster; a low first value is noise.

    ``set_id`` is the score of the order of the same number.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("set_id"))
    cluster = F.when(F.col("vector")[0] < -0.15, F.lit(-1)).otherwise(F.col("label")).cast("long")
    return planted(spark, sf_dir).drop("set_id").join(orders, "doc_id").select(
        "set_id", "doc_id", F.col("vector").alias("z"), cluster.alias("cluster_id"))


def _wording(template: str) -> str:
    parts = []
    for i, bit in enumerate(template.replace("}", "{").split("{")):
        if bit:
            parts.append(f"p_{bit}" if i % 2 else f"'{bit}'")
    return f"concat({', '.join(parts)})"


def wording_sql() -> tuple[str, str]:
    """SQL for the text and the intent of a derived question, in any dialect."""
    text = " ".join(f"WHEN st = '{a}' AND pr = {b} THEN {_wording(t)}" for (a, b), t in SHAPES.items())
    intent = " ".join(f"WHEN st = '{a}' AND pr = {b} THEN '{v}'" for (a, b), v in INTENTS.items())
    return f"CASE {text} END", f"CASE {intent} ELSE 'trend_analysis' END"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query, as_of, intent``: one plain-language question per order."""
    d = F.col("as_of")
    nxt = F.add_months(d, 1)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").cast("date").alias("as_of"),
        F.col("o_orderstatus").alias("st"), F.substring("o_orderpriority", 1, 1).cast("int").alias("pr"))
    rows = rows.withColumns({
        "p_mon": F.date_format(d, "MMM"), "p_month": F.date_format(d, "MMMM"),
        "p_y": F.date_format(d, "yyyy"), "p_mon2": F.date_format(nxt, "MMM"),
        "p_y2": F.date_format(nxt, "yyyy"), "p_day": F.dayofmonth(d).cast("string"),
        "p_iso": F.date_format(d, "yyyy-MM-dd"),
        "p_iso2": F.date_format(F.date_add(d, 30), "yyyy-MM-dd"), "p_s": F.col("pr").cast("string")})
    text, intent = wording_sql()
    return rows.select("query_id", F.expr(text).alias("query"), "as_of", F.expr(intent).alias("intent"))


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of :func:`questions`, and a broad one for every year, whose id is the negative year."""
    rows = questions(spark, sf_dir)
    years = rows.groupBy(F.year("as_of").alias("y")).agg(F.max("as_of").alias("as_of")).select(
        (-F.col("y")).cast("long").alias("query_id"), F.concat(F.lit("subjects of the whole of jan to dec "), "y").alias("query"),
        "as_of", F.lit("trend_analysis").alias("intent"))
    return rows.unionByName(years)


def tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, pos, word, tag``: question words with B-/I-/O tags.

    "to" between two months continues a month span.
    """
    from themeloom.functions.dates import month_number_wide
    from themeloom.functions.text import blank_tokens
    from themeloom.plans.questions import guess_group

    # A question's words are at hand in its row: their neighbours need no shuffle.
    rows = questions(spark, sf_dir).select("query_id", blank_tokens(F.col("query")).alias("words"))
    # Not the bare column: Spark would infer a filter on it and cut texts once more, where the file is read.
    rows = rows.select("query_id", "words", F.posexplode(F.coalesce("words", F.array().cast("array<string>"))).alias("pos", "word"))
    at = lambda k: F.get("words", F.col("pos") + k)
    month = lambda k: month_number_wide(F.regexp_replace(at(k), r"^\.+|\.+$", "")).isNotNull()
    linked = (at(0).eqNullSafe("to") & month(-1) & month(1)) | (at(-1).eqNullSafe("to") & month(-2) & month(0))
    group = guess_group(F.col("word"))
    tag = F.when(linked, "I-MONTH").otherwise(F.coalesce(F.concat(F.lit("B-"), group), F.lit("O")))
    return rows.select("query_id", "pos", "word", tag.alias("tag"))
