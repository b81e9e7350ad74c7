"""Packing along a space-filling curve.

Each document's tokens are hashed into a small vector, projected to three coordinates and
placed on a Hilbert curve.  Documents are range-sorted by their place, their tokens laid
end to end in that order and cut every ``length`` tokens, so that a sequence holds
neighbours of the curve and only the last one needs padding.

Tokens are made once and stored in the shared folder.  Only (row, place,
tokens) are sorted; running totals come from sums per range partition, so no task sees
more than its range.  A group of copies has one place on the curve and is split by row.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.bpe import shared_encoder
from themeloom.session import cut

DIMENSIONS = 3
BITS = 10
END = 2


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) below 2**bits."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    # Undo the excess rotations and reflections from the highest bit down.
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[d - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def directions(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One fixed random unit direction per token id."""
    d = np.random.default_rng(7).standard_normal((size, dimensions))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def places(ids: list[np.ndarray], toward: np.ndarray) -> np.ndarray:
    """Hilbert places of documents from the mean direction of their hashed tokens."""
    if not ids:
        return np.zeros(0, np.int64)
    sums = np.array([np.bincount(i % len(toward), minlength=len(toward)) @ toward / np.sqrt(max(1, len(i)))
                     for i in ids])
    cell = np.clip((np.arctan(sums) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cell.astype(np.int64))


def tokens_with_place(docs: DataFrame, path: str) -> DataFrame:
    """``row, doc_id, ids`` (in the vocabulary's own width), ``n`` and ``place`` of every row, stored."""
    shared = shared_encoder(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, toward = shared(), directions(1024)
        end = np.array([END], encoder.kind).tobytes()
        for batch in batches:
            ids = [encoder.packed(t) + end for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": [len(i) // len(end) for i in ids], "ids": ids,
                                "place": places([np.frombuffer(i, encoder.kind) for i in ids], toward)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n long, ids binary, place long")
    return cut(made.withColumn("row", F.monotonically_increasing_id()))


def starts(rows: DataFrame) -> DataFrame:
    """``row`` with ``begin``: the number of tokens before it in the order of the curve."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(rows.select("row", "place", "n").repartitionByRange(parts, "place", "row")
                      .withColumn("part", F.spark_partition_id()))
    # One row per range partition: their running totals are a table as long as the number of partitions.
    totals = ordered.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("place", "row")) - F.col("n")
    return (ordered.withColumn("within", within).join(F.broadcast(before), "part")
                   .select("row", (F.col("before") + F.col("within")).alias("begin")))


def pack(docs: DataFrame, path: str, length: int = 4096) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its tokens and an end mark; each token lies in exactly one piece.  All
    sequences but the last are full.  Null and empty texts are the end mark alone; rows
    with equal or null ``doc_id`` are packed one by one; other columns are ignored; no
    documents give no pieces.  ``ids`` are unsigned 32-bit, little-endian.
    """
    stored = tokens_with_place(docs, path)
    placed = stored.select("row", "doc_id", "n", "ids").join(starts(stored), "row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, n, begin, packed in zip(batch["doc_id"], batch["n"], batch["begin"], batch["ids"], strict=True):
                ids, start = np.frombuffer(packed, f"<u{len(packed) // n}").astype("<u4").tobytes(), 0
                while start < n:
                    offset = (begin + start) % length
                    size = min(length - offset, n - start)
                    piece = ids[4 * start:4 * (start + size)]
                    out.append((doc, start, size, piece, zlib.crc32(piece), n, (begin + start) // length, offset))
                    start += size
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
                                               "sequence_id", "offset"])
            if batch["doc_id"].isna().any():
                frame["doc_id"] = frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None)
            yield frame

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.select("doc_id", "n", "begin", "ids").mapInPandas(
        run, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
