"""Line dedup with a template tree.

As in log parsing, a line goes down a tree of fixed depth: by its number of tokens, then
by its leading tokens, with tokens that hold digits generalised.  A leaf is a group of
lines of any number of templates.  A line's template is made of those of its tokens that
most of the leaf's texts have in their places; other places are variable fields.  A
template that stands in several texts recurs, as does a line that recurs as it is.  The
text that has a template first keeps it; all other texts lose it.

DataFrame functions only.  Lines are masked once and stored; token counts are made only for leaves
that recur with different lines, once for each different line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import GAP, carried, text_key
from themeloom.session import cut

DEPTH = 3
MIN_TOKENS = 5
MIN_TEXTS = 2
LIKE = 0.6


def masked(line: Column) -> Column:
    """Tokens of a line joined by one space, those with a digit as ``<*>``."""
    plain = F.array_join(F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), GAP), " ")
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(plain)


def tokens(masked_line: Column) -> Column:
    """Number of tokens of a masked line."""
    return F.when(masked_line == "", 0).otherwise(F.length(masked_line) - F.length(F.replace(masked_line, F.lit(" "))) + 1)


def lines(docs: DataFrame) -> DataFrame:
    """``h1, h2, doc_id, pos, n, leaf, id`` and the masked ``line`` of every line of every text."""
    h1, h2 = text_key(F.col("text"))
    each = docs.where("text is not null").select(h1.alias("h1"), h2.alias("h2"), "doc_id",
                                                 F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    counted = each.withColumn("line", masked(F.col("raw"))).withColumn("n", tokens(F.col("line")))
    return counted.select("h1", "h2", "doc_id", "pos", "line", "n",
                          F.xxhash64("n", F.substring_index("line", " ", DEPTH)).alias("leaf"),
                          F.xxhash64(F.lit("line"), "line").alias("id"))


def generalised(stored: DataFrame, seen: DataFrame, min_texts: int, like: float) -> DataFrame:
    """``id, template`` of lines in leaves with different lines, where the template may recur.

    A line's template is made of its own most widespread tokens: the share ``like`` of its places
    behind the leading tokens, those whose token stands there in most of the leaf's texts.  Each of
    them must stand in ``min_texts`` texts.  Lines of one template thus agree in that share of places.

    ``seen`` has ``leaf, id, texts, first``: in how many distinct texts each line stands, and one of them.
    """
    leaves = cut(seen.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("texts").alias("leaf_texts"))
                     .where((F.col("kinds") > 1) & (F.col("leaf_texts") >= min_texts)).select("leaf"))
    asked = seen.join(leaves, "leaf").select("leaf", "id", "texts", F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2"))
    # Each different line is read from one text, though copies of that text give it again.
    forms = (stored.where(F.col("n") > DEPTH).select("h1", "h2", "leaf", "id", "n", "line")
                   .join(asked, ["leaf", "id", "h1", "h2"]))
    # Leading tokens are equal in all of the leaf.
    placed = cut(forms.select("leaf", "id", "n", "texts", "line").distinct().select(
        "leaf", "id", "n", "texts", F.posexplode(F.split("line", " ")).alias("pos", "token")).where(F.col("pos") >= DEPTH)
        .select("id", "n", "texts", "pos", F.xxhash64("leaf", "pos", "token").alias("place")))
    constant = placed.groupBy("place").agg(F.sum("texts").alias("with_token")).where(F.col("with_token") >= min_texts)
    # Ties go to the earlier place.
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("with_token")).alias("c"), "pos", "place")))
    enough = F.ceil(like * (F.col("n") - DEPTH)).cast("int")
    return (placed.join(constant, "place").groupBy("id").agg(F.max("n").alias("n"), ranked.alias("all"))
                  .where(F.size("all") >= enough)
                  .select("id", F.xxhash64("n", F.array_sort(F.slice("all.place", 1, enough))).alias("template")))


def recurring(stored: DataFrame, min_texts: int = MIN_TEXTS, min_tokens: int = MIN_TOKENS,
              like: float = LIKE) -> DataFrame:
    """``id, f1, f2``: lines that follow a recurring template, and the text that keeps it.

    That text is the one with the smallest ``doc_id`` (null ones last), then the smallest key.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("first")
    per_text = (stored.where(F.col("n") >= min_tokens).groupBy("leaf", "id", "h1", "h2")
                      .agg(F.min("doc_id").alias("doc_id")))
    seen = cut(per_text.groupBy("leaf", "id").agg(F.count(F.lit(1)).alias("texts"), first))
    alike = cut(generalised(stored, seen, min_texts, like))
    of_template = (per_text.join(alike, "id").groupBy("template", "h1", "h2").agg(
        F.min("doc_id").alias("doc_id")).groupBy("template").agg(F.count(F.lit(1)).alias("texts"), first)
        .where(F.col("texts") >= min_texts).drop("texts"))
    loose = cut(alike.join(of_template, "template").select("id", F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2")))
    exact = seen.where(F.col("texts") >= min_texts).select("id", F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2"))
    # A template's first text keeps its line of it, also if that line itself recurs.
    return loose.union(exact.join(loose.select("id"), "id", "left_anti"))


def drop_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, min_tokens: int = MIN_TOKENS,
               like: float = LIKE) -> DataFrame:
    """The rows of ``docs`` as ``doc`` with ``kept`` text, ``n_lines`` and ``n_dropped``.

    Equal texts count as one text and keep equal lines; a line of fewer than ``min_tokens`` tokens
    is never dropped, nor are repeats within one text.  Null texts stay null with no lines; empty
    ones have one, kept; no documents give no rows.  All rows and columns stay.
    """
    held = carried(docs)
    stored = cut(lines(held))
    gone = (stored.select("id", "h1", "h2", "pos").join(cut(recurring(stored, min_texts, min_tokens, like)), "id")
                  .where((F.col("h1") != F.col("f1")) | (F.col("h2") != F.col("f2")))
                  .groupBy("h1", "h2").agg(F.collect_set("pos").alias("gone")))
    h1, h2 = text_key(F.col("text"))
    marked = held.withColumns({"h1": h1, "h2": h2}).join(gone, ["h1", "h2"], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return marked.select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("kept"),
                         F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def without_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines dropped from their texts; all rows and columns stay."""
    done = drop_lines(docs)
    return done.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: every row's text without recurring lines."""
    return drop_lines(docs).select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.col("kept").alias("text"))
