"""Reports: lines, prompts, titles and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts users see.
NO_EXAMPLES = "No representative texts to summarize."
BOLD_BULLET = r"(?m)^[ \t]*•[^*\n]*\*\*([^*\n]+)\*\*"


def _joined(key: Column, line: Column, sep: str = "\n") -> Column:
    rows = F.sort_array(F.collect_list(F.struct(key.alias("key"), line.alias("line"))))
    return F.array_join(F.transform(rows, lambda r: r.line), sep)


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """One row per cluster with its summary line; ``label`` may be missing."""
    return clusters.withColumn("line", F.format_string(
        "- Cluster %d (n=%d): %s", "cluster_id", "size", F.coalesce("label", F.lit("(no text)"))))


def summaries(clusters: DataFrame) -> DataFrame:
    """``set_id, summary``: summary lines in cluster order."""
    lines = cluster_lines(clusters)
    return lines.groupBy("set_id").agg(_joined(F.col("cluster_id"), F.col("line")).alias("summary"))


def prompts(examples: DataFrame) -> DataFrame:
    """``set_id, prompt``: one numbered example per cluster, in cluster order.

    ``examples`` has ``set_id, cluster_id, text``.
    """
    i = F.row_number().over(Window.partitionBy("set_id").orderBy("cluster_id"))
    lines = examples.withColumn("i", i).withColumn(
        "line", F.format_string('Trend Example %d: "%s"', "i", "text"))
    return lines.groupBy("set_id").agg(_joined(F.col("i"), F.col("line")).alias("prompt"))


def prompt_or_none(prompt: Column) -> Column:
    return F.coalesce(prompt, F.lit(NO_EXAMPLES))


def titles(answer: Column) -> Column:
    """Bold titles of an answer's bullets, in order."""
    found = F.regexp_extract_all(answer, F.lit(BOLD_BULLET), F.lit(1))
    return F.transform(found, lambda t: F.trim(t))


def titled_clusters(clusters: DataFrame, answers: DataFrame) -> DataFrame:
    """Pair the i-th title with the i-th cluster; the label is the fallback.

    ``answers`` has ``set_id, answer``.  The result adds ``title`` and a ``line``
    in the form of a titled summary.
    """
    i = F.row_number().over(Window.partitionBy("set_id").orderBy("cluster_id"))
    numbered = clusters.withColumn("i", i)
    told = answers.select("set_id", F.posexplode(titles(F.col("answer"))).alias("_p", "said"))
    told = told.select("set_id", (F.col("_p") + 1).alias("i"), "said")
    title = F.coalesce("said", F.initcap(F.nullif("label", F.lit(""))), F.format_string("Trend %d", "i"))
    return (numbered.join(told, ["set_id", "i"], "left").withColumn("title", title)
            .withColumn("line", F.format_string("- **%s** (n=%d) — %s", "title", "size", "label"))
            .drop("said", "i"))


def cluster_structs(clusters: DataFrame, *, by_size: bool = False) -> DataFrame:
    """``set_id, clusters``: the clusters of a set as one array.

    ``clusters`` has ``set_id, cluster_id, size, label, exemplar_ids``; ascending
    by id, or with ``by_size`` largest first.
    """
    key = F.struct((-F.col("size")).alias("s"), F.col("cluster_id").alias("c")) if by_size else \
        F.struct(F.col("cluster_id").alias("s"), F.col("cluster_id").alias("c"))
    body = F.struct("cluster_id", "size", "label", "exemplar_ids")
    rows = F.sort_array(F.collect_list(F.struct(key.alias("key"), body.alias("body"))))
    return clusters.groupBy("set_id").agg(F.transform(rows, lambda r: r.body).alias("clusters"))
