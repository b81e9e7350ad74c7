"""Mixing sources to target weights along a curriculum.

Every source has a target number of words and a curve: its relative weight over training
time, from 0 to 1.  The integral of the curve, scaled to the target, is the source's
cumulative demand.  Documents of a source stand in a fixed hashed order, epoch after epoch,
so each has a place in the source's stream of words; inverting the demand turns that place
into a time of training.  The mix is range-sorted by time.

Running totals come from sums per range partition, within a source and over all of the mix,
so a source with any share of the rows is spread over many tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.forest import running_sums
from themeloom.session import cut

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
# Knots (time, height) of a curve, straight between them: early, late, in the middle.
Curve = Sequence[tuple[float, float]]
CURVES: tuple[Curve, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))


def sized(docs: DataFrame) -> DataFrame:
    """``row, doc_id, source, size, place, tie`` of every row, stored: words, and the order within a source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Splitting bytes parts them at exactly the characters between words.
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            size = pa.array([len(t.split()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size], names=[*batch.schema.names[:-1], "size"])

    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    given = docs.select(docs["doc_id"], docs["source"], place.alias("place"), F.xxhash64(docs["text"]).alias("tie"),
                        docs["text"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.drop("text").schema)
    made = given.mapInArrow(run, f"{kinds}, size long")
    return cut(made.withColumn("row", F.monotonically_increasing_id()))


def capped_shares(sources: DataFrame, total: float) -> DataFrame:
    """Add ``target`` to ``source_id, weight, cap``: shares of ``total`` by weight, none above its cap.

    What is over a cap is shared again by weight.  In the order of cap over weight, the sources
    at their cap come first; those after them share what is left.
    """
    ordered = sources.withColumn("ratio", F.col("cap") / F.col("weight"))
    ordered = cut(running_sums(ordered, [], ["ratio", "source_id"], {"caps": "cap", "weights": "weight"}))
    weights = ordered.agg(F.sum("weight")).first()[0]
    level = ((F.lit(float(total)) - (F.col("caps") - F.col("cap")))
             / (F.lit(weights) - (F.col("weights") - F.col("weight"))))
    free = ordered.withColumn("level", level).where("ratio > level").agg(
        F.min(F.struct("ratio", "source_id", "level")).alias("first")).first()["first"]
    target = F.col("cap").cast("double")
    if free is not None:
        same = (F.col("ratio") == free["ratio"]) & (F.col("source_id") >= free["source_id"])
        after = (F.col("ratio") > free["ratio"]) | same
        target = F.when(after, F.lit(free["level"]) * F.col("weight")).otherwise(target)
    return ordered.withColumn("target", target).drop("ratio", "caps", "weights")


def targets(rows: DataFrame, weights: Sequence[int], share: float, most: int, n_curves: int) -> DataFrame:
    """``source, source_id, source_size, curve, target`` of every source of ``rows``, stored."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumns({"none": F.col("source").isNull().cast("int"), "one": F.lit(1)})
    ranked = cut(running_sums(sizes, [], ["none", "source"], {"source_id": "one"}).drop("one", "none"))
    nth = F.pmod(F.col("source_id") - 1, F.lit(len(weights))).cast("int")
    ranked = ranked.withColumns({
        "weight": F.array(*[F.lit(w).cast("long") for w in weights])[nth], "cap": most * F.col("source_size"),
        "curve": F.pmod(F.col("source_id") - 1, F.lit(n_curves)).cast("int")})
    total = ranked.agg(F.sum("source_size")).first()[0]
    return cut(capped_shares(ranked, share * (total or 0)).drop("weight", "cap"))


def time_of(done: Column, curve: Curve) -> Column:
    """Time at which the share ``done`` (0 to 1) of a curve's area is reached."""
    pieces, before = [], 0.0
    for (t, h), (t2, h2) in zip(curve, curve[1:]):
        pieces.append((t, h, (h2 - h) / (t2 - t), before, t2))
        before += (t2 - t) * (h + h2) / 2
    out = None
    for t, h, slope, start, end in pieces:
        rest = done * F.lit(before) - F.lit(start)
        below = F.lit(h) + F.sqrt(F.greatest(F.lit(h * h) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.least(F.lit(t) + F.when(below > 0, 2 * rest / below).otherwise(0.0), F.lit(end))
        out = time if out is None else F.when(rest >= 0, time).otherwise(out)
    return out


def placed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
           curves: Sequence[Curve] = CURVES) -> DataFrame:
    """``row, doc_id, source, size, source_size, target, place, tie, copies`` of every row of ``docs``, stored.

    ``copies`` has a struct for each time that the mix takes the document: ``epoch``, ``start`` (words
    before it in its source's stream), ``taken`` and ``time``.  Documents are taken whole, but for
    the last one of a source, which is cut where the target, to the nearest word, is reached.

    Sources are in the order of their code points, null last, and take ``weights`` and ``curves`` in
    turn.  They share ``share`` of all words by weight, none more than ``most`` times its own.  Null
    and empty texts have no words and are never taken.  Rows with equal or null ``doc_id`` are placed
    one by one; other columns are ignored; no rows give no rows.
    """
    rows = sized(docs)
    sources = targets(rows, weights, share, most, len(curves))
    known = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    streams = running_sums(known, ["source_id"], ["place", "doc_id", "size", "tie", "row"], {"upto": "size"})
    quota = F.floor(F.col("target") + 0.5)

    def copy(epoch: Column) -> Column:
        start = epoch * F.col("source_size") + F.col("upto") - F.col("size")
        done = F.try_divide(start, F.col("target"))
        time = F.lit(None).cast("double")
        for k, curve in enumerate(curves):
            time = F.when(F.col("curve") == k, time_of(done, curve)).otherwise(time)
        taken = F.greatest(F.least(quota - start, F.col("size")), F.lit(0))
        return F.struct(epoch.alias("epoch"), start.alias("start"), taken.alias("taken"), F.round(time, 9).alias("time"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), copy), lambda c: c["taken"] > 0)
    return cut(streams.select("row", "doc_id", "source", "size", "source_size", "target", "place", "tie",
                              copies.alias("copies")))


def mix(rows: DataFrame) -> DataFrame:
    """The training order of rows from :func:`placed`, one row each time a document is taken.

    ``time, begin, taken, epoch`` with ``row, doc_id, source``: ``begin`` is the number of words before
    it in the whole mix.  Rows are range-sorted by time; ties go by the documents' hashed order.
    """
    each = rows.select("row", "doc_id", "source", "size", "place", "tie", F.explode("copies").alias("c")).select("*", "c.*")
    order = ["time", "place", "doc_id", "size", "epoch", "tie", "row"]
    ranged = running_sums(each.drop("c"), [], order, {"upto": "taken"})
    return (ranged.withColumn("begin", F.col("upto") - F.col("taken"))
                  .select("time", "begin", "taken", "epoch", "row", "doc_id", "source"))


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken``, and ``time`` and ``begin`` of its first copy.

    The last two are null where the mix takes nothing.
    """
    rows = placed(docs)
    of_row = mix(rows).groupBy("row").agg(F.sum("taken").alias("taken"), F.min("time").alias("time"),
                                          F.min("begin").alias("begin"))
    return rows.drop("copies").join(of_row, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "time", "begin")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
