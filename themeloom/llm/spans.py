"""Spans of regular expressions as columns: where a pattern matches, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(text: Column, pattern: str | Column, guard: Column | None = None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array of ``start, end, found``; end exclusive.

    ``found`` is the given group.  The text between matches gives their places: its parts and the
    matches alternate.  ``guard`` is a cheap test that holds wherever the pattern can match.
    """
    text = F.coalesce(text, F.lit(""))
    text = F.when(guard, text).otherwise("") if guard is not None else text
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), F.transform(whole, F.length),
                       lambda gap, size: F.struct(gap.alias("gap"), F.coalesce(size, F.lit(0)).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        steps, start,
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"),
                                F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts")),
        lambda acc: acc["starts"])
    made = F.zip_with(F.slice(starts, 1, F.size(whole)), F.arrays_zip(whole.alias("whole"), found.alias("found")),
                      lambda at, m: F.struct(at.alias("start"), (at + F.length(m["whole"])).alias("end"),
                                             m["found"].alias("found")))
    # Most texts have no match: for them nothing but the guard and one search is done.
    some = guard & F.rlike(text, F.lit(pattern)) if guard is not None else F.rlike(text, F.lit(pattern))
    return F.when(some, made).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def named(kind: str, found: Column) -> Column:
    """Spans with their kind first."""
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"),
                                                 s["end"].alias("end"), s["found"].alias("found")))


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans in their order, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(found: str, kind: str) -> Column:
    """How many spans of a kind there are."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
