"""Secrets: base patterns, and multipart credentials linked within scopes.

Besides strong patterns a text may hold weak candidates: access identifiers, opaque
secrets and endpoints, each harmless alone.  Parts are rows with their interval; an
interval join within scopes of a text finds, for each weak part, complementary parts
nearby, and only linked parts are reported.  All of it is DataFrame functions; a scope is
a bounded stretch of one text, so no key of the join holds more than fits in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import text_key
from themeloom.llm.spans import counted, listed, named, spans
from themeloom.session import cut

BASE = ("assign", "access", "hex")
WEAK = ("endpoint", "identifier", "opaque")
SCOPE = 300
# A part needs one of these kinds nearby; base spans count as the strong forms of their parts.
COMPLEMENT = {"identifier": ("opaque", "assign", "hex"), "opaque": ("identifier", "access", "endpoint"),
              "endpoint": ("opaque", "assign", "access", "hex")}


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind: leftmost, non-overlapping; too short matches are dropped."""
    text = F.coalesce(text, F.lit(""))
    letters = "".join
    either = lambda w: letters(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    assign = rf"(?:{names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = spans(text, assign, text.contains("=") | text.contains(":"), group=1)
    # A run this long or longer matches from its start, so the shorter ones need no look.
    return {"assign": F.filter(found, lambda s: F.length(s["found"]) >= 12),
            "access": spans(text, "AKIA[A-Z0-9]{14,}", text.contains("AKIA")),
            "hex": spans(text, "[0-9a-f]{16,}", text.rlike("[0-9]|[a-f]{16}"))}


def weak_spans(text: Column) -> dict[str, Column]:
    """Spans of the weak kinds, wherever they stand."""
    text = F.coalesce(text, F.lit(""))
    name = "[Uu]ser(?:name)?|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccess_?[Kk]ey(?:_?[Ii][Dd])?|[Aa]ccount"
    identifier = spans(text, rf"(?:{name})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{{4,}}|(?<![A-Za-z0-9])AKIA[A-Z0-9]{{8,13}}(?![A-Z0-9])",
                       text.contains("=") | text.contains(":") | text.contains("AKIA"))
    long = spans(text, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", text.rlike("[0-9]"))
    opaque = F.filter(long, lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[a-z]") & s["found"].rlike("[A-Z]"))
    endpoint = spans(text, r"(?:https?|postgres|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]+", text.contains("://"))
    return {"endpoint": endpoint, "identifier": identifier, "opaque": opaque}


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part within ``scope`` code points that doesn't overlap them.

    ``parts`` has ``h1, h2, kind, start, end, found``; parts meet in stretches of ``scope`` code
    points: a weak one has all that it and its scope touch, any other one all that it touches.
    """
    wanted = F.array(*[F.lit(f"{k}:{c}") for k, cs in COMPLEMENT.items() for c in cs])
    cell = lambda at: F.floor(at / scope)
    cells = lambda low, high: (cell(low).alias("low"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"))
    weak = parts.where(F.col("kind").isin(*WEAK)).select(
        "h1", "h2", "kind", "start", "end", "found", *cells(F.col("start") - scope, F.col("end") + scope))
    other = parts.select("h1", "h2", F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2"),
                         *cells(F.col("start"), F.col("end"))).withColumnRenamed("low", "low2")
    near = ((F.col("start2") < F.col("end") + scope) & (F.col("start") < F.col("end2") + scope)
            & ((F.col("end2") <= F.col("start")) | (F.col("end") <= F.col("start2")))
            & F.array_contains(wanted, F.concat_ws(":", "kind", "kind2")))
    # Two parts share many cells if they are long; the first common one is enough.
    once = F.col("cell") == F.greatest("low", "low2")
    return weak.join(other, ["h1", "h2", "cell"]).where(once & near).select("h1", "h2", "kind", "start", "end",
                                                                            "found").distinct()


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The rows of ``docs`` with ``base`` and ``extra``: arrays of kind, start, end and found text.

    Places are code points, ends exclusive.  ``extra`` are weak parts outside base spans that are
    linked with a complementary part; both are ordered by start and kind.  Null texts count as empty.
    """
    h1, h2 = text_key(F.col("text"))
    found, weak = base_spans(F.col("text")), weak_spans(F.col("text"))
    by_place = lambda a, b: (F.when(a["start"] != b["start"], F.sign(a["start"] - b["start"]).cast("int"))
                             .otherwise(F.array_position(order, a["kind"]).cast("int")
                                        - F.array_position(order, b["kind"]).cast("int")))
    order = F.array(*map(F.lit, (*BASE, *WEAK)))
    base = F.array_sort(F.concat(*[named(k, found[k]) for k in BASE]), by_place)
    rows = docs.withColumns({"h1": h1, "h2": h2, "base": base})
    some = F.concat(*[named(k, weak[k]) for k in WEAK])
    free = F.filter("some", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    parts = (rows.select("h1", "h2", "base", some.alias("some")).withColumn("weak", free).where(F.size("weak") > 0)
                 .select("h1", "h2", F.explode(F.concat("weak", "base")).alias("s")).select("h1", "h2", "s.*").distinct())
    extra = linked(cut(parts), scope).groupBy("h1", "h2").agg(
        F.array_sort(F.collect_list(F.struct("kind", "start", "end", "found")), by_place).alias("extra"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")
    return rows.join(extra, ["h1", "h2"], "left").withColumn("extra", F.coalesce("extra", empty))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, number of spans of each base kind, digest of the base spans, and all spans.

    Spans go by start, then kind.  Null and empty texts have none; repeated rows and null ids are
    reported one by one; no documents give no rows; other columns are ignored.
    """
    rows = find(docs.select("doc_id", "text"))
    number = [counted("base", k).alias(f"n_{k}") for k in BASE]
    order = F.array(*map(F.lit, (*BASE, *WEAK)))
    every = F.array_sort(F.concat("base", "extra"), lambda a, b: F.when(
        a["start"] != b["start"], F.sign(a["start"] - b["start"]).cast("int")).otherwise(
        F.array_position(order, a["kind"]).cast("int") - F.array_position(order, b["kind"]).cast("int")))
    return rows.select("doc_id", *number, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                       listed(every).alias("spans"))
