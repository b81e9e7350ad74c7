"""Personal data, and terms that give it away.

Base patterns find e-mail addresses, network addresses, card and phone numbers.  Each
found value is a protected entity, and so is its mail domain.  How strongly a term reveals an
entity is estimated from the corpus: over distinct texts, the pointwise mutual information of
term and entity, as a share of the entity's own information.  A share of one means that whoever
reads the term knows the entity.  Shares are discounted by both / (both + 1), the smoothing of
Pantel and Lin, where both is the number of texts that have term and entity.  Term and entity
must also stand together more often than chance allows: their likelihood ratio (Dunning) passes
a bar corrected for the number of pairs that occur.  Terms whose share exceeds a threshold are
generalised, beyond a higher one removed, wherever they stand outside base spans, also in texts
without the entity.

All of it is DataFrame functions.  Equal texts are one text for every count.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import carried, text_key
from themeloom.llm.spans import counted, listed, named, spans
from themeloom.session import cut

KINDS = ("email", "ip", "card", "phone")
TERM = r"\p{L}{3,}"
BROADCAST_TERMS = 100_000
GENERALISE = 0.7
REMOVE = 0.9
ALPHA = 0.05


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn test."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
                       lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                           F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind: leftmost, non-overlapping; matches that fail their test are dropped.

    Patterns are written so that no run of characters is tried twice and no repetition recurses,
    whatever the text's length.
    """
    text = F.coalesce(text, F.lit(""))
    word = "[A-Za-z0-9._%+-]"
    email = spans(text, rf"(?:\G|(?<!{word})){word}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", text.contains("@"))
    ip = spans(text, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", text.contains("."))
    card = spans(text, r"[0-9](?:[\x20-]?[0-9])++", text.rlike("[0-9]"))
    phone = spans(text, r"\+[0-9][\x20().0-9-]+[0-9]", text.contains("+"))
    small = lambda s: ~F.exists(F.split(s["found"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3)
                                | (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) > 255))
    count = lambda s: F.length(_digits(s["found"]))
    return {"email": email, "ip": F.filter(ip, small),
            "card": F.filter(card, lambda s: count(s).between(13, 19) & luhn(_digits(s["found"]))),
            "phone": F.filter(phone, lambda s: count(s).between(9, 15))}


def with_base(docs: DataFrame) -> DataFrame:
    """Rows with their text's key and base spans; ``docs`` has ``text``."""
    h1, h2 = text_key(F.col("text"))
    found = base_spans(F.col("text"))
    return docs.withColumns({"h1": h1, "h2": h2, "base": F.concat(*[named(k, found[k]) for k in KINDS])})


def entities(rows: DataFrame) -> DataFrame:
    """``h1, h2, entity``: found values and their mail domains, once for each text."""
    found = F.lower("e.found")
    own = F.array(F.concat_ws(":", "e.kind", found),
                  F.when(F.col("e.kind") == "email", F.concat(F.lit("domain:"), F.substring_index(found, "@", -1))))
    return (rows.select("h1", "h2", F.explode("base").alias("e")).select("h1", "h2", F.explode(own).alias("entity"))
                .where("entity is not null").distinct())


def outside(text: Column, base: Column) -> Column:
    """The text with blanks in place of base spans."""
    return F.aggregate(base, F.coalesce(text, F.lit("")), lambda t, s: F.overlay(
        t, F.repeat(F.lit(" "), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))


def forms(text: Column, base: Column) -> Column:
    """Different terms of a text outside base spans, as written."""
    return F.array_distinct(F.regexp_extract_all(outside(text, base), F.lit(TERM), F.lit(0)))


def terms_of(text: Column, base: Column) -> Column:
    return F.array_distinct(F.transform(forms(text, base), F.lower))


def contexts(rows: DataFrame, support: int = 1) -> DataFrame:
    """``h1, h2, entity, term``: entities of ``support`` texts or more, and all terms of their texts outside base spans.

    ``rows`` are distinct texts with entities.
    """
    every = entities(rows)
    # Stored, so that the join has both sides in exchanges of its own and a domain of very many texts is split.
    often = cut(every.groupBy("entity").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= support).select("entity"))
    of_text = every.join(often, "entity").groupBy("h1", "h2").agg(F.collect_list("entity").alias("entities"))
    terms = rows.select("h1", "h2", terms_of(F.col("text"), F.col("base")).alias("terms"))
    return (terms.join(of_text, ["h1", "h2"]).select("h1", "h2", "terms", F.explode("entities").alias("entity"))
                 .select("h1", "h2", "entity", F.explode("terms").alias("term")))


def _beyond_chance(both: Column, of_entity: Column, of_term: Column, total: Column) -> Column:
    """Twice the log likelihood ratio of two things standing together against standing by chance."""
    def part(seen: Column, a: Column, b: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (a * b))).otherwise(0.0)

    no_entity, no_term = total - of_entity, total - of_term
    return 2 * (part(both, of_entity, of_term) + part(of_entity - both, of_entity, no_term)
                + part(of_term - both, no_entity, of_term) + part(total - of_entity - of_term + both, no_entity, no_term))


def revealing(docs: DataFrame, rows: DataFrame, near: DataFrame, support: int, alpha: float = ALPHA) -> DataFrame:
    """``entity, term, both, share``: how much of each entity's information each term of its texts gives away.

    Only pairs that stand together more often than chance allows at ``alpha`` over all pairs that occur.

    ``rows`` are the distinct texts with entities, ``near`` their :func:`contexts`; ``both`` is in how many
    texts the two stand, ``support`` at least.  All counts are of distinct texts of the whole corpus.
    """
    occurring = cut(near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")))
    bar = NormalDist().inv_cdf(1 - alpha / 2 / max(1, occurring.count())) ** 2
    pairs = occurring.where(F.col("both") >= support)
    of_entity = cut(entities(rows).groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")))
    held = terms_of(F.col("text"), F.col("base"))
    # Copies of a text send their terms once.  The empty term stands in every text: its count is their number.
    texts = with_base(docs.select("text")).select("h1", "h2", F.array_append(held, F.lit("")).alias("terms")).groupBy("h1", "h2").agg(
        F.first("terms").alias("terms"))
    of_any = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    asked = pairs.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    # An inner join, as Spark would move a semi join below the counts, where it reads every text's terms.
    of_term = cut(of_any.join(asked, "term"))
    counted = of_term.where("term = ''").first()
    total = F.lit(float(counted["with_term"] if counted else 0))
    own = F.log(total / F.col("with_entity"))
    mutual = F.log(total * F.col("both") / (F.col("with_entity") * F.col("with_term")))
    sure = _beyond_chance(F.col("both"), F.col("with_entity"), F.col("with_term"), total) >= bar
    return (pairs.join(of_entity, "entity").join(of_term, "term").where((F.col("with_entity") < total) & sure)
                 .select("entity", "term", "both", (mutual / own).alias("share")))


def spans_of(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The rows of ``docs`` (``text`` and whatever else) with ``base``, ``terms`` and the text's key.

    ``base`` and ``terms`` are arrays of kind, start, end (code points, exclusive) and found text;
    a term's kind is ``hint`` (to be generalised) or ``reveal`` (to be removed).
    """
    rows = with_base(docs)
    stored = cut(rows.select("h1", "h2", "text", "base").where(F.size("base") > 0).dropDuplicates(["h1", "h2"]))
    # Fewer texts can't reach the threshold after the discount, whatever the share.
    support = max(1, math.ceil(generalise / (1 - generalise) - 1e-9)) if generalise < 1 else 1
    share = revealing(docs, stored, contexts(stored, support), support).withColumn(
        "share", F.col("share") * F.col("both") / (F.col("both") + 1)).where(F.col("share") >= generalise)
    kind = F.when(F.max("share") >= remove, "reveal").otherwise("hint")
    known = cut(share.groupBy("term").agg(kind.alias("kind")))
    known = F.broadcast(known) if known.count() <= BROADCAST_TERMS else known
    held = with_base(docs.select("text")).select("h1", "h2", F.explode(forms(F.col("text"), F.col("base"))).alias("form"))
    hits = held.withColumn("term", F.lower("form")).join(known, "term").groupBy("h1", "h2").agg(
        F.map_from_entries(F.collect_set(F.struct("form", "kind"))).alias("hits"))
    # Forms are runs of letters, and whole ones only are meant.
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("hits"), "|"), F.lit(r")(?!\p{L})"))
    said = F.transform(spans(outside(F.col("text"), F.col("base")), pattern), lambda s: F.struct(
        F.element_at("hits", s["found"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.lower(s["found"]).alias("found")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")
    terms = F.when(F.col("hits").isNotNull(), said).otherwise(empty)
    return rows.join(hits, ["h1", "h2"], "left").withColumn("terms", terms).drop("hits")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, number of spans of each base kind, digest of the base spans, and all spans.

    Null and empty texts have none.  Repeated rows and null ids are reported one by one; no
    documents give no rows; other columns are ignored.
    """
    found = spans_of(docs.select("doc_id", "text"))
    number = [counted("base", k).alias(f"n_{k}") for k in KINDS]
    everything = F.concat("base", F.filter("terms", lambda s: s["kind"] == "hint"),
                          F.filter("terms", lambda s: s["kind"] == "reveal"))
    return found.select("doc_id", *number, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(everything).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans replaced by their kind in angle brackets, hints by ``<TERM>``, reveals by nothing.

    Overlapping spans are replaced once, as the first of them.  Null texts stay null; all rows and
    columns stay; rows with the same text get the same one.
    """
    held = carried(docs)
    found = spans_of(held)
    order = F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    put = lambda kind: F.when(kind == "reveal", "").when(kind == "hint", "<TERM>").otherwise(
        F.concat(F.lit("<"), F.upper(kind), F.lit(">")))
    clean = F.aggregate(order, first, lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"), F.concat(acc["parts"], F.array(
            F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), put(s["kind"]))).alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""),
                             F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size(order) > 0, clean).otherwise(F.col("text"))
    return found.withColumn("_clean", text).select(*[
        F.col("_clean").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
