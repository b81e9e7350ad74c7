"""What several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text; null counts as empty.

    Equal texts share them, so work on a text is done once for all of its copies.
    """
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit("first"), text), F.xxhash64(F.lit("second"), text)


def words(text: Column) -> Column:
    """Non-empty words of a text, in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def carried(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` beside the whole row as ``doc``, so that no other column can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"], docs["text"])
