"""Alignment of two tokenizers over a corpus, and how often their tokens meet.

Both tokenizers cut the same bytes; places where a token of each ends cut a text into groups,
and tokens whose bytes overlap are linked.  The first pass over the documents counts linked
pairs per batch of texts.  The distinct pairs are dealt to shards of bounded size by their
hash, each with a minimal perfect hash.  A batch's counts become dense vectors indexed by
it, and vectors are summed in a tree.  Looking up compares the key stored at the index.
The second pass aligns the documents of each batch again and looks up the counts that
its own pairs were answered with, so no task holds more of the pairs than its batch has.

Texts are cut before a space that follows other characters, where neither tokenizer has a
token that goes across; the pieces' alignments are remembered, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm import perfecthash
from themeloom.llm.bpe import LONG_CHUNK, byte_letters
from themeloom.session import cut

MARK = "▁"
# Fixed value: pre-tokens of byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000
BATCH = 4 << 20
SHARD = 1 << 16
GROUP = 500_000
FAN = 32


def byte_level(spec: dict) -> bool:
    """True if the tokenizer file describes plain byte-level pairs over the usual pre-tokens."""
    pre = spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return plain and spec["normalizer"] is None


def encoder_of(source: str, spec: dict) -> Callable[[str], list[int]]:
    """The first tokenizer's ids of a text, special tokens read as plain text.

    Where ids grow with the merges' ranks, a faster library gives the same ids.
    """
    model, value = spec["model"], {c: b for b, c in enumerate(byte_letters())}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranked = all(vocab[a + b] == 256 + n for n, (a, b) in enumerate(merges)) and len(vocab) >= 256 + len(merges)
    single = {bytes([value[t]]): i for t, i in vocab.items() if len(t) == 1 and t in value}
    if byte_level(spec) and ranked and len(single) == 256 and not model.get("ignore_merges"):
        ranks = {**single, **{bytes(value[c] for c in a + b): vocab[a + b] for a, b in merges}}
        return tiktoken.Encoding("first", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    held = Tokenizer.from_str(source)
    held.encode_special_tokens = True
    held.no_truncation()
    held.no_padding()
    return lambda text: held.encode(text, add_special_tokens=False).ids


class Aligner:
    """Both tokenizers and their alignment of a text; made once per worker.

    ``first`` is the JSON text of a byte-level tokenizer, ``second`` a model of pieces that puts a
    space before each text.  Memory: both vocabularies, and at most ``CACHE`` remembered pieces.
    """

    def __init__(self, first: str, second: bytes):
        spec = json.loads(first)
        self.encode_first = encoder_of(first, spec)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        value = {c: b for b, c in enumerate(byte_letters())}
        names = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(value[c] for c in name) if all(c in value for c in name) else name.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.second.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.n_second = len(pieces)
        self.kind = "I" if len(self.a_bytes) * self.n_second <= 1 << 32 else "Q"
        # Pieces of a text stand for themselves if no token of either goes across a space's beginning.
        apart = byte_level(spec) and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.parts = re.compile(r"(?<=\S)(?= )").split if apart else lambda text: [text]
        self.known: dict[str, tuple] = {}

    def aligned(self, texts: list[str]) -> list[tuple[bytes, bytes, int, int, int]] | None:
        """Per text its groups, packed linked pairs, and numbers of tokens and groups; None if bytes are not kept.

        Every text starts with a space, and all but the last one end with another character, so they
        are encoded together.
        """
        whole = "".join(texts)
        data = whole.encode()
        # The second tokenizer puts the first space there itself - but for an empty text.
        a, b = self.encode_first(whole), self.second.encode(whole[1:]) if len(whole) > 1 else [self.second.piece_to_id(MARK)]
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        ends = accumulate(map(len, texts if whole.isascii() else [t.encode() for t in texts]))
        a_size, b_size, n, kind = self.a_size, self.b_size, self.n_second, self.kind
        out, groups, pairs = [], [], []
        i = j = from_a = from_b = first_a = first_b = 0
        x, y = a[0], b[0]
        a_end, b_end, stop = a_size[x], b_size[y], next(ends)
        while True:
            pairs.append(x * n + y)
            if a_end == b_end:
                if from_a == i and from_b == j:
                    groups.append(f"{x}|{y}")
                else:
                    groups.append(f"{','.join(map(str, a[from_a:i + 1]))}|{','.join(map(str, b[from_b:j + 1]))}")
                i, j = i + 1, j + 1
                from_a, from_b = i, j
                if a_end == stop:
                    out.append((";".join(groups).encode(), array(kind, pairs).tobytes(), i - first_a, j - first_b, len(groups)))
                    if len(out) == len(texts):
                        return out
                    groups, pairs, first_a, first_b, stop = [], [], i, j, next(ends)
                x, y = a[i], b[j]
                a_end += a_size[x]
                b_end += b_size[y]
            elif a_end < b_end:
                i += 1
                x = a[i]
                a_end += a_size[x]
            else:
                j += 1
                y = b[j]
                b_end += b_size[y]

    def pieces(self, text: str | None) -> list[tuple]:
        """Alignments of a text's pieces in order; none for empty texts and those whose bytes are not kept."""
        if not text:
            return []
        known, parts = self.known, self.parts(f" {text}")
        found = list(map(known.get, parts))
        new = [i for i, f in enumerate(found) if f is None]
        if new:
            asked = [*dict.fromkeys([parts[i] for i in new])]
            made = self.aligned(asked)
            if made is None:
                return []
            fresh = dict(zip(asked, made, strict=True))
            for i in new:
                found[i] = fresh[parts[i]]
            if len(known) < CACHE:
                known.update((p, v) for p, v in fresh.items() if len(p) <= LONG_CHUNK)
        return found

    def links(self, found: list[tuple]) -> np.ndarray:
        """Keys of all linked token occurrences: the first id times the second vocabulary, plus the second id."""
        return np.frombuffer(b"".join([f[1] for f in found]), self.kind)


def shared_aligner(spark: SparkSession, first: str, second: str) -> Callable[[], Aligner]:
    """A function that gives the worker's aligner of two tokenizer files, whose bytes (a few MB) are broadcast."""
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        held = spark.sparkContext.broadcast({"first": f.read(), "second": g.read()})

    def aligner() -> Aligner:
        value = held.value
        if "aligner" not in value:
            value["aligner"] = Aligner(value["first"], value["second"])
        return value["aligner"]

    return aligner


def batches_of(docs: DataFrame, shared: Callable[[], Aligner]) -> DataFrame:
    """``batch, doc_id, text`` of every row, and of every batch one row with its pairs' ``keys`` and ``counts``, stored.

    ``doc_id`` is a string here, null in rows of counts.
    """
    names = ["batch", "doc_id", "text", "keys", "counts"]
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, k = shared(), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch.column("text").cast(pa.binary())).fill_null(0).to_numpy(False))
            cuts = np.flatnonzero(np.diff(sizes // BATCH)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                rows, name = batch.slice(begin, end - begin), (part << 32) + k
                if not len(rows):
                    continue
                keys, n = np.unique(np.concatenate([aligner.links(aligner.pieces(t))
                                                    for t in rows.column("text").to_pylist()]), return_counts=True)
                none = pa.nulls(len(rows), longs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), name, np.int64)), *rows.columns, none, none], names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()),
                     pa.array([keys.astype(np.int64)], longs), pa.array([n], longs)], names)
                k += 1

    return cut(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(
        run, "batch long, doc_id string, text string, keys array<long>, counts array<long>"))


def unpacked(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(bytes(v), np.int64) for v in column]


def hashed(kinds: DataFrame) -> DataFrame:
    """``shard, levels, keys``: per shard of distinct keys a perfect hash, and the keys in its order, stored."""
    def make(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame["key"].to_numpy(np.int64)
        levels = perfecthash.build(keys.view(np.uint64))
        placed = np.empty_like(keys)
        placed[perfecthash.Index(levels).of(keys.view(np.uint64))] = keys
        return pd.DataFrame({"shard": frame["shard"].iloc[:1].to_numpy(), "levels": [levels], "keys": [placed.tobytes()]})

    return cut(kinds.groupBy("shard").applyInPandas(make, "shard int, levels binary, keys binary"))


def places(levels: bytes, stored: bytes, keys: np.ndarray) -> np.ndarray:
    """Verified indices of keys: the key stored at each index is the one asked for."""
    at = perfecthash.Index(bytes(levels)).of(keys.view(np.uint64))
    if (at < 0).any() or (np.frombuffer(bytes(stored), np.int64)[at] != keys).any():
        raise ValueError("a pair was not hashed")
    return at


def summed(parts: DataFrame, hashes: DataFrame, branches: int, fan: int = FAN) -> DataFrame:
    """``shard, levels, keys, counts``: dense counts of every shard, summed in a tree over branches of batches, stored.

    ``parts`` has ``shard, branch, key, n``.
    """
    def first(key: tuple, frame: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(table):
            return pd.DataFrame({"shard": [], "branch": [], "vector": []})
        at = places(table["levels"].iloc[0], table["keys"].iloc[0], frame["key"].to_numpy(np.int64))
        vector = np.zeros(len(table["keys"].iloc[0]) // 8, np.int64)
        np.add.at(vector, at, frame["n"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [key[0]], "branch": [key[1]], "vector": [vector.tobytes()]})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "branch": [key[1]], "vector": [sum(unpacked(frame["vector"])).tobytes()]})

    schema = "shard int, branch int, vector binary"
    vectors = (parts.groupBy("shard", "branch").cogroup(on_branches(hashes, branches).groupBy("shard", "branch"))
                    .applyInPandas(first, schema))
    while branches > 1:
        branches = math.ceil(branches / fan)
        vectors = cut(vectors).withColumn("branch", F.floor(F.col("branch") / fan).cast("int"))
        vectors = vectors.groupBy("shard", "branch").applyInPandas(add, schema)
    return cut(hashes.join(vectors.select("shard", F.col("vector").alias("counts")), "shard"))


def on_branches(table: DataFrame, branches: int) -> DataFrame:
    return table.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))


def answers(parts: DataFrame, table: DataFrame, branches: int) -> DataFrame:
    """``batch, key, count``: the corpus-wide count of every pair of every batch."""
    def look(key: tuple, frame: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(held):
            return pd.DataFrame({"batch": [], "key": [], "count": []})
        at = places(held["levels"].iloc[0], held["keys"].iloc[0], frame["key"].to_numpy(np.int64))
        count = np.frombuffer(bytes(held["counts"].iloc[0]), np.int64)[at]
        return pd.DataFrame({"batch": frame["batch"], "key": frame["key"], "count": count})

    return (parts.select("shard", "branch", "batch", "key").groupBy("shard", "branch")
                 .cogroup(on_branches(table, branches).groupBy("shard", "branch"))
                 .applyInPandas(look, "batch long, key long, count long"))


def highest(table: DataFrame, n_second: int) -> dict[int, int]:
    """Highest count of any pair of each second id; at most as many as that vocabulary has."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(unpacked(batch["keys"]), unpacked(batch["counts"]), strict=True):
                best = pd.Series(counts).groupby(keys % n_second).max()
                yield pd.DataFrame({"second": best.index, "count": best.to_numpy()})

    found = table.select("keys", "counts").mapInPandas(run, "second long, count long")
    return {r["second"]: r["most"] for r in found.groupBy("second").agg(F.max("count").alias("most")).collect()}


def pair_counts(docs: DataFrame, first: str, second: str, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """``first_id, second_id, count`` of every pair of linked tokens in ``docs``."""
    shared, spark = shared_aligner(docs.sparkSession, first, second), docs.sparkSession
    _, _, table, _, n_second = counted(batches_of(docs, shared), second, shard, group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(unpacked(batch["keys"]), unpacked(batch["counts"]), strict=True):
                yield pd.DataFrame({"first_id": keys // n_second, "second_id": keys % n_second, "count": counts})

    if table is None:
        return spark.createDataFrame([], "first_id long, second_id long, count long")
    return table.select("keys", "counts").mapInPandas(run, "first_id long, second_id long, count long")


def counted(stored: DataFrame, second: str, shard: int, group: int):
    """Rows of texts, parts, the table of counts, the number of branches and the size of the second vocabulary."""
    n_second = sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
    texts = stored.where("keys is null").select("batch", "doc_id", "text")
    each = stored.where("keys is not null").select("batch", F.explode(F.arrays_zip("keys", "counts")).alias("e"))
    each = each.select("batch", F.col("e.keys").alias("key"), F.col("e.counts").alias("n"))
    kinds = cut(each.select("key").distinct())
    n_kinds, rows = kinds.count(), stored.agg(F.sum(F.size("keys"))).first()[0] or 0
    if not n_kinds:
        return texts, None, None, 0, n_second
    shards = math.ceil(n_kinds / shard)
    branches = max(1, math.ceil(rows / (shards * group)))
    dealt = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    parts = each.select("batch", "key", "n", dealt, F.pmod(F.xxhash64("batch"), F.lit(branches)).cast("int").alias("branch"))
    hashes = hashed(kinds.select("key", dealt))
    return texts, parts, summed(parts.drop("batch"), hashes, branches), branches, n_second


def align(docs: DataFrame, first: str, second: str, digest: bool = False, shard: int = SHARD,
          group: int = GROUP) -> DataFrame:
    """Alignment of every row of ``docs`` by the tokenizer files ``first`` and ``second``.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups``: ``a1,a2|b1;a3|b2,b3``, ids of
    each group.  With ``digest`` instead of ``groups`` its SHA-256 in hex, ``groups_sha256``.  A pair's count is
    how many links of all ``docs`` hold it; ``n_best`` counts links whose count is the highest of their
    second id.

    Null and empty texts, and those whose bytes one of the tokenizers does not keep, have no tokens:
    zeros and an empty ``groups`` or digest.  Rows with equal or null ``doc_id`` are aligned one by one;
    texts of any length are aligned whole; other columns are ignored; no rows give no rows.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    shared = shared_aligner(spark, first, second)
    texts, parts, table, branches, n_second = counted(batches_of(docs, shared), second, shard, group)
    last = "groups_sha256" if digest else "groups"
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    if table is None:
        return texts.select(F.col("doc_id").cast(kind).alias("doc_id"), *[F.lit(0).cast("long").alias(c) for c in numbers],
                            F.lit("").alias(last))
    best = np.zeros(n_second, np.int64)
    for i, most in highest(table, n_second).items():
        best[i] = most
    held = spark.sparkContext.broadcast(best)

    def again(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        aligner, best = shared(), held.value
        known = known.sort_values("key")
        keys, count = known["key"].to_numpy(np.int64), known["count"].to_numpy(np.int64)
        most = count == best[keys % n_second]
        out = []
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            found = aligner.pieces(text)
            if not found:
                out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
                continue
            links = aligner.links(found).astype(np.int64)
            at = np.searchsorted(keys, links)
            groups = b";".join([f[0] for f in found])
            out.append((doc_id, sum(f[2] for f in found), sum(f[3] for f in found), sum(f[4] for f in found), len(links),
                        int(most[at].sum()), int(count[at].sum()),
                        hashlib.sha256(groups).hexdigest() if digest else groups.decode()))
        return pd.DataFrame(out, columns=["doc_id", *numbers, last])

    longs = ", ".join(f"{c} long" for c in numbers)
    made = texts.groupBy("batch").cogroup(answers(parts, table, branches).groupBy("batch")).applyInPandas(
        again, f"doc_id string, {longs}, {last} string")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
