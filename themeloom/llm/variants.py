"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols, so that a word becomes a reduced word.  One edit of the
word is at most one edit of its reduced word.  For every distinct reduced word its full
one-edit neighbourhood is generated and joined to the vocabulary of reduced words; words
behind reduced words that meet are verified on their original strings.

The number of symbols follows the size of the vocabulary (a parameter sets it otherwise): with
more words, more symbols keep the share of a reduced word about the same.  It changes only
how many candidates are verified.  Letters are dealt to symbols by their frequency, so that
symbols are about equally frequent.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.skew import meet
from themeloom.session import cut, spread

LEAST_LENGTH, LEAST_COUNT = 5, 3
MISPRINT = 97
HELD = 300_000
CELLS = 2_000_000
BASE = 0x9E3779B97F4A7C15


def runs_of(doc_id, text: str) -> list[bytes]:
    """Runs of letters of a text in Latin-1, A-Z in lower case; those that the checksum picks lose a letter."""
    # All letters of a run are in Latin-1: other characters become "?", which is none.
    runs = re.findall(rb"[a-z\xc0-\xff]+", text.encode("latin-1", "replace").lower())
    start = crc32(f"{doc_id}:".encode())
    if text.isascii():
        sums = [crc32(r, start) for r in runs]
    else:
        sums = [crc32(r if r.isascii() else r.decode("latin-1").encode(), start) for r in runs]
    for i in np.flatnonzero(np.array(sums, np.uint32) % MISPRINT == 0).tolist():
        k = sums[i] % len(runs[i])
        runs[i] = runs[i][:k] + runs[i][k + 1:]
    return runs


def counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of the distinct words of all texts that are long and frequent enough, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in seen]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if text:
                    seen.update(r for r in runs_of(doc_id, text) if len(r) >= LEAST_LENGTH)
                    if len(seen) > HELD:
                        yield flush()
        yield flush()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return cut(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


def symbols_of(vocabulary: DataFrame, n_symbols: int) -> dict[str, int]:
    """A symbol from 1 to ``n_symbols`` for every letter, about equally frequent.

    There are at most 90 letters.
    """
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()
    load, out = [0] * n_symbols, {}
    for n, c in sorted(((-r["count"], r["c"]) for r in letters)):
        least = load.index(min(load))
        out[c] = least + 1
        load[least] -= n
    return out


def powers(length: int) -> np.ndarray:
    """The first ``length`` powers of the base, modulo 2**64."""
    out = np.full(length, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def neighbourhood(reduced: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every reduced word within one edit of the rows of a matrix of symbols, themselves included.

    A word's hash is the sum of its symbols times powers of an odd base, modulo 2**64, so that
    every edit is a sum over what stands before and behind it.
    """
    n, length = reduced.shape
    s, power = reduced.astype(np.uint64), powers(length + 1)
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(s * power[:length], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    back = np.uint64(pow(BASE, -1, 1 << 64))
    made = [whole, before[:, :-1] + (whole - before[:, 1:]) * back]
    for x in range(1, n_symbols + 1):
        made.append(whole + (np.uint64(x) - s) * power[:length])
        made.append(before + np.uint64(x) * power + (whole - before) * np.uint64(BASE))
    near = np.sort(np.concatenate(made, axis=1), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(new)[0], near[new]


def reduced_words(vocabulary: DataFrame, symbols: dict[str, int]) -> DataFrame:
    """Add ``reduced`` (one byte a symbol) and its hash ``code`` to ``word, n``, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(256, np.uint8)
        for c, x in symbols.items():
            table[ord(c)] = x
        for batch in batches:
            made = [table[np.frombuffer(w.encode("latin-1"), np.uint8)] for w in batch.column("word").to_pylist()]
            power = powers(max(map(len, made), default=1))
            code = [int((r * power[:len(r)]).sum(dtype=np.uint64)) for r in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in made], pa.binary()),
                                              pa.array(np.array(code, np.uint64).view(np.int64))],
                                             ["word", "n", "reduced", "code"])

    return cut(vocabulary.mapInArrow(run, "word string, n long, reduced binary, code long"))


def meeting(words: DataFrame, n_symbols: int) -> DataFrame:
    """``code, near``: codes of reduced words of the vocabulary that are within one edit, equal ones included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized: dict[int, list[bytes]] = {}
            for r in batch.column("reduced").to_pylist():
                sized.setdefault(len(r), []).append(r)
            for length, group in sized.items():
                step = max(1, CELLS // (2 * (n_symbols + 1) * length))
                for i in range(0, len(group), step):
                    part = np.frombuffer(b"".join(group[i:i + step]), np.uint8).reshape(-1, length)
                    own = (part * powers(length)).sum(1, dtype=np.uint64)
                    row, near = neighbourhood(part, n_symbols)
                    yield pa.RecordBatch.from_arrays([pa.array(own[row].view(np.int64)), pa.array(near.view(np.int64))],
                                                     ["code", "near"])

    kinds = cut(words.select("reduced", "code").distinct())
    made = spread(kinds.select("reduced")).mapInArrow(run, "code long, near long")
    # Different reduced words may share a code: codes that meet twice count once.
    return meet(made, kinds.select(F.col("code").alias("near")).distinct(), ["near"]).select("near", "code").distinct()


def near_words(vocabulary: DataFrame, n_symbols: int | None = None) -> DataFrame:
    """``word, n, near, near_n``: pairs of words of ``vocabulary`` (word, n) exactly one edit apart, in both orders."""
    if n_symbols is None:
        n_symbols = max(4, int(vocabulary.count() ** (1 / 7)))
    words = reduced_words(vocabulary, symbols_of(vocabulary, n_symbols))
    met = cut(meeting(words, n_symbols))
    slim = words.select("word", "n", "code")
    left = meet(met, slim, ["code"]).drop("code")
    right = slim.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("code"))
    # The check of the original strings is part of the join, so candidates are not written.
    edits = F.levenshtein(left["word"], right["near"], 1)
    return (left.join(right.hint("merge"), (left["near"] == right["code"]) & (edits == 1))
                .select(left["word"], left["n"], right["near"], right["near_n"]))


def followed(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: the last word along the forms ``word, form``.

    Every form is at least twice as frequent as its word, so there are no circles, and the rounds of
    doubled steps grow with the logarithm of the logarithm of the largest count.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(meet(now, ahead, ["root"], "left").select("word", F.coalesce("further", "root").alias("root"),
                                                          F.col("further").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def groups(docs: DataFrame, n_symbols: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts of ``docs``.

    Words are runs of letters of Latin-1 with A-Z in lower case; the checksum of id and run picks
    some that lose one letter; kept are words of five letters or more that occur three times or
    more.  ``form`` is the near word of largest ``n`` (ties: smallest by code points) if that is at
    least twice the word's; ``root`` the end of the chain of forms, the word itself if it has none.

    Null and empty texts have no words; a null ``doc_id`` reads as ``None`` in the checksum; repeated
    rows count as often; runs of any length are whole words; other columns are ignored; no rows give
    no rows.
    """
    vocabulary = counts(docs)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    near = near_words(vocabulary, n_symbols).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = cut(near.select("word", "n_near", F.when(-F.col("best.m") >= 2 * F.col("n"), F.struct(
        F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f")).select("word", "n_near", "f.*"))
    roots = followed(found.where("form is not null"))
    return (meet(meet(vocabulary, found, ["word"], "left"), roots, ["word"], "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
