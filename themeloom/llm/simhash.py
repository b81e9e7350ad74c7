"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints with at most four differing bits share at least four of their
eight bytes at the same place.  The index holds, for each fingerprint, its bytes at a
family of three-byte position sets such that every four positions contain one of them:
a pair that shares four bytes meets under at least one key, and a key has 24 bits, so
that unrelated fingerprints rarely meet.  For pairs that meet, shared positional bytes
are tallied over their whole fingerprints; pairs with four or more are verified by counting
differing bits.

Equal fingerprints are one row from the start.  A key with very many members is cut into
blocks that meet two by two, each task holding two blocks.  A block returns a spanning
forest of its links, not all of them: a linked fingerprint leaves the search at once, so
a dense group costs little more than its size.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import carried
from themeloom.llm.graph import components
from themeloom.session import cut

BYTES = 8
BLOCK = 8192


def position_sets() -> list[tuple[int, int, int]]:
    """Three-byte position sets such that any four of the eight positions contain one.

    Positions go into three classes, in a ring; a set lies in one class, or has two
    positions in a class and one in the next.  Of four positions, some class and its
    next one always hold such three.
    """
    ring = [p % 3 for p in range(BYTES)]

    def chosen(three: tuple[int, ...]) -> bool:
        c = [ring[p] for p in three]
        return len(set(c)) == 1 or any(c.count(k) == 2 and (k + 1) % 3 in c for k in range(3))

    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


def signature(text: str | None, size: int, lower: bool) -> int:
    """SimHash of a whole text as a signed 64-bit number; zero if it has no words.

    It is made from the shingles' XXH64 with seed 42.
    """
    raw = (text or "").encode()
    if lower:
        raw = raw.lower()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [b" ".join(words)]
    ones, total = np.zeros(64, np.int64), 0
    digest, shingles = xxhash.xxh64_intdigest, iter(shingles)
    while hashes := [digest(s, 42) for s in islice(shingles, 65536)]:
        bits = np.array(hashes, "<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(0, np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def signatures(docs: DataFrame, size: int, lower: bool) -> DataFrame:
    """``doc_id, sig`` of every row: SimHash of word shingles of whole texts; null counts as empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"],
                                "sig": np.array([signature(t, size, lower) for t in batch["text"]], np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, sig long")


def forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``members``: rows of a node id and its signature."""
    node, left = members[:, 0], np.ascontiguousarray(members[:, 1]).view(np.uint64)
    links, waiting = [], []
    while len(node) or waiting:
        if not waiting:
            waiting.append((node[0], left[0]))
            node, left = node[1:], left[1:]
        name, here = waiting.pop()
        if not len(node):
            break
        near = np.flatnonzero(linked(left ^ here, bits))
        if len(near):
            links += [(int(name), int(x)) for x in node[near]]
            waiting += list(zip(node[near], left[near], strict=True))
            node, left = np.delete(node, near), np.delete(left, near)
    return links


def linked(differ: np.ndarray, bits: int) -> np.ndarray:
    """Which differences of two signatures leave the guaranteed number of bytes equal, and pass the check of bits.

    The tally of shared positional bytes is taken from the whole signatures of a pair that met in
    the index, as they travel with its postings.
    """
    near = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(1) >= BYTES - bits
    near[near] = np.bitwise_count(differ[near]) <= bits
    return near


def links(nodes: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that connect all nodes (``node, sig``) which differ in ``bits`` bits or fewer."""
    byte = [F.shiftrightunsigned("sig", 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    keys = []
    for k, places in enumerate(position_sets()):
        key = F.lit(k).cast("long")
        for p in places:
            key = key * 256 + byte[p]
        keys.append(key)
    postings = nodes.select(F.array("node", "sig").alias("member"), F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").count()
    shared = sizes.where(F.col("count") > 1).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.get("member", F.lit(0))), F.col("blocks")).cast("int")
    units = (postings.join(shared, "key").withColumn("own", own)
                     .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                     .select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "member"))
    met = (units.groupBy("key", "p", "q").agg(F.collect_list("member").alias("members"))
                .where(F.size("members") > 1).select(F.flatten("members").alias("members")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            twos = [m for m in batch["members"] if len(m) == 4]
            if twos:
                pairs = np.stack(twos).reshape(-1, 2, 2)
                near = linked((pairs[:, 0, 1] ^ pairs[:, 1, 1]).copy().view(np.uint64), bits)
                out += map(tuple, pairs[near][:, :, 0].tolist())
            for m in batch["members"]:
                if len(m) > 4:
                    out += forest(np.array(m, np.int64).reshape(-1, 2), bits)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return met.mapInPandas(run, "a long, b long").distinct()


def classes(docs: DataFrame, size: int = 4, bits: int = 4, lower: bool = True, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` of all rows whose fingerprints are linked, over any
    number of links; ``fingerprint`` is 16 lowercase hex digits.  Fingerprints link at ``bits`` <= 4
    differing bits, and no link is missed.

    Null and blank texts have fingerprint zero and are linked like any other; null ids are no
    smallest id (a class of none has a null one); repeated rows are returned as often; other
    columns are ignored; no rows give no rows.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index serves at most four differing bits")
    prints = cut(signatures(docs, size, lower))
    nodes = cut(prints.groupBy("sig").agg(F.min("doc_id").alias("first"))
                      .withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(nodes.select("node", "sig"), bits, block))
    known = nodes.join(roots, "node", "left").select("sig", "first", F.coalesce("root", "node").alias("root"))
    # Stored, so that both sides of the join are dealt anew and a large class is split.
    smallest = cut(known.groupBy("root").agg(F.min("first").alias("component_id")))
    label = cut(known.join(smallest, "root").select("sig", "component_id"))
    digits = F.lower(F.lpad(F.hex("sig"), 16, "0"))
    return prints.join(label, "sig").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame, size: int = 4, bits: int = 4) -> DataFrame:
    """Rows of ``docs`` without near copies: of each class of :func:`classes` the row with the smallest ``doc_id`` stays.

    Blank and null texts are one class.  Of rows with equal ids the one whose text sorts first
    stays.  Rows without an id stay, as nothing names them.  No rows give no rows, long texts
    count whole, and columns stay as they are.
    """
    held = carried(docs)
    able, text = F.col("doc_id").isNotNull(), F.coalesce("text", F.lit(""))
    first = classes(held.where(able), size, bits).where("doc_id = component_id").select("doc_id").distinct()
    # Only ids of several rows are looked at for their texts, so that whole rows are dealt out by id once.
    twice = cut(held.where(able).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    chosen = cut(held.where(able).join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.xxhash64(text), text).alias("_best")))
    named = held.where(able).select("doc", "doc_id", F.xxhash64(text).alias("_h")).join(first, "doc_id", "left_semi")
    kept = named.join(chosen, "doc_id", "left").where("_best is null or _h = _best").select("doc", "doc_id").dropDuplicates(["doc_id"])
    return kept.select("doc").union(held.where(~able).select("doc")).select("doc.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
