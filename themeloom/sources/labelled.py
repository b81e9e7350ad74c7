"""Labelled texts and token labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOKEN_LABELS = "tokens array<string>, labels array<string>"


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the columns ``text`` and ``label``; fails if either is absent."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if not {"text", "label"} <= set(raw.columns):
        raise ValueError("labelled text needs a text and a label column")
    return raw.select("text", "label")


def read_token_labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of two parallel lists, ``tokens`` and ``labels``."""
    return spark.read.schema(TOKEN_LABELS).json(path)


def write_token_labels(examples: DataFrame, path: str) -> None:
    """One JSON object per line."""
    examples.select("tokens", "labels").write.mode("overwrite").json(path)
