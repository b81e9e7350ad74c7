"""Session helpers: where lineage is cut, and how."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster has to name one.  Only a local session without the setting gets a
    fresh temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="themeloom-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan behind ``df`` is dropped, a lost executor costs nothing that was
    written, and the stored size lets Spark choose its join strategy.
    """
    path = f"{shared_dir(df.sparkSession)}/themeloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a table of texts that a task evaluates at most, about.
TASK_ROWS = 250_000
# Rows of a few short values that a task sorts at most, about.
SLIM_ROWS = 1_000_000


def dealt(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Deal a stored table by key, ``rows`` of it to a task, about (``SLIM_ROWS``, for short rows, if not given).

    Windows and groups over the keys then need no other shuffle, and a task's memory does not grow
    with the table, whatever number of shuffle partitions is set.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (rows or SLIM_ROWS)))
    return df.repartition(wanted, *keys)


def spread(df: DataFrame, rows: int = 0) -> DataFrame:
    """Give every core a part of a table read from fewer files than there are cores.

    ``rows``, where known, gives every task ``TASK_ROWS`` of them at most: splits go by bytes, and one
    of short columns holds millions.  A table in enough splits is left as it is.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
