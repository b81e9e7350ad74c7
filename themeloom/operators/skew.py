"""Joins and rankings that stay even when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20
# A broadcast row takes about so many times its values: the driver holds keys, row headers and slots as well.
HELD = 4
SALTS = 16


def fits_broadcast(df: DataFrame, row_bytes: int) -> bool:
    """True if a broadcast of ``df`` takes at most ``BROADCAST_BYTES``, with values of ``row_bytes`` a row.

    Counts no further than the bound, so the check itself stays small.
    """
    bound = max(1, BROADCAST_BYTES // (HELD * row_bytes))
    return df.limit(bound + 1).count() <= bound


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the points, never by a broadcast.

    Spark judges a stored table by its files.  Compressed ids take a twentieth of what the driver
    would hold of them, so a table under its threshold can still be too large for the driver.
    """
    return left.join(right.hint("merge"), list(on), how)


def attach(big: DataFrame, small: DataFrame, on: Sequence[str], *, how: str = "inner",
           row_bytes: int = 64, spread: Column | None = None, even: bool = False) -> DataFrame:
    """Join a table with a per-key table whose keys may be very uneven.

    ``small`` has one or few rows per key.  It is broadcast when its size is
    within the bound; else each of its rows is repeated ``SALTS`` times and
    every row of ``big`` meets one copy, so that a hot key is shared by
    ``SALTS`` tasks.  ``spread`` is the value of ``big`` that picks the copy, by
    default its whole row.  ``even`` says that no key is hot in ``big``, such as
    a document id: then a plain join does.
    """
    on = list(on)
    if fits_broadcast(small, row_bytes):
        return big.join(F.broadcast(small), on, how)
    if even:
        return meet(big, small, on, how)
    spread = [spread] if spread is not None else [F.col(c) for c in big.columns]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Spark judges the copies by the rows they were made of, and would broadcast all of them.
    return meet(salted, copies, [*on, "_salt"], how).drop("_salt")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank", spread: str | None = None) -> DataFrame:
    """First ``k`` rows of every group in ``order``, with their rank.

    For k within Spark's group-limit threshold the limit is also applied before
    the shuffle.  Beyond it a first ranking over salted groups does the same.
    """
    if k > 1000 and spread is not None:
        salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS * 8)).cast("int")
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(part))
                .where(F.col("_r") <= k).drop("_r", "_salt"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
