"""Document tables: reading with a column mapping, partitioned writing, vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.text import words

# The column names a review export carries.
REVIEW_COLUMNS = {"text": "Text", "score": "Score", "timestamp": "timestamp"}
TYPES = {"text": "string", "score": "float", "timestamp": "date"}


def read_documents(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None, *,
                   fmt: str = "csv", id_column: str | None = None) -> DataFrame:
    """Documents from CSV, Parquet or JSON under logical names.

    CSV is read with a schema, never inferred; values that do not parse are null.
    Without an id column the id is a hash of the row's own values.  Ids are not
    negative.
    """
    columns = dict(columns or REVIEW_COLUMNS)
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        raw = spark.read.format(fmt).load(path)
    missing = [c for c in columns.values() if c not in raw.columns]
    if missing:
        raise ValueError(f"columns not found in {path}: {missing}")
    out = [F.col(src).try_cast(TYPES[name]).alias(name) if name in TYPES else F.col(src).alias(name)
           for name, src in columns.items()]
    key = F.col(id_column) if id_column else F.xxhash64(
        *[F.col(c) for c in columns.values()]).bitwiseAND(F.lit(2**63 - 1))
    return raw.select(key.alias("doc_id"), *out)


def write_documents(docs: DataFrame, path: str, *, recreate: bool = False) -> None:
    """Documents as Parquet, one folder per month, so date filters prune files.

    Rows of a month are spread over several tasks by id: a month may be large.
    ``recreate`` replaces the table, otherwise rows are added.
    """
    (docs.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
         .withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
         .repartition("month", "_part").drop("_part")
         .write.partitionBy("month").mode("overwrite" if recreate else "append").parquet(path))


def fit_text_vectors(docs: DataFrame, *, features: int = 1024, size: int = 64) -> PipelineModel:
    """Model from words to unit vectors: hashed counts, inverse frequency, PCA."""
    model = Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf", minDocFreq=2),
        Normalizer(inputCol="_idf", outputCol="_unit"),
        PCA(inputCol="_unit", outputCol="_vector", k=size),
    ])
    return model.fit(docs.select(words(F.col("text")).alias("tokens")))


def text_vectors(docs: DataFrame, model: PipelineModel) -> DataFrame:
    """``doc_id, vector``; a model of your own may take this step's place."""
    out = model.transform(docs.select("doc_id", words(F.col("text")).alias("tokens")))
    return out.select("doc_id", vector_to_array("_vector").alias("vector"))
