"""Byte-pair encoding by backtracking, and decoding through an offset table.

The vocabulary is one with word ends: a pre-token's bytes become symbols, the last of
them in its word-final form.  Greedy longest token matches come from an Aho-Corasick
automaton; two neighbouring tokens are right exactly if no merge of higher priority
crosses their border, which a table of merges decides (and remembers).  A wrong pair
sends the search back to the next shorter token.    The result equals replaying all
merges, in time linear in the text.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from unicodedata import normalize

# Fixed values of the tokenizer file's format: white space, pre-token pattern, word end.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# White space for Python, but not for the tokenizer.
NOT_SPACE = "\x1c\x1d\x1e\x1f"

CACHE = 900_000
LONG_CHUNK = 200
FINAL = 0x400


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """Remembers values of a function, the first ``limit`` of them; nothing about long texts."""

    def __init__(self, function: Callable, limit: int):
        self.function, self.limit = function, limit

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < self.limit and len(key) <= LONG_CHUNK:
            self[key] = value
        return value


class Encoder:
    """Encoder and decoder of one vocabulary; made once per task from its JSON text.

    Memory: the automaton, plus three memos of at most ``CACHE`` entries.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab = model["vocab"]
        letters = {c: b for b, c in enumerate(byte_letters())}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        # Tokens as strings of symbols: one character per byte, shifted in its word-final form.
        self.symbols: dict[int, str] = {}
        names = [""] * size
        # Remembered tokens are packed in two bytes each, if all ids fit.
        self.kind = "H" if size <= 1 << 16 else "I"
        for name, i in vocab.items():
            final = name.endswith(WORD_END) and name != WORD_END
            stem = name[: -len(WORD_END)] if final else name
            names[i] = name
            if stem and all(c in letters for c in stem):
                b = [letters[c] for c in stem]
                self.symbols[i] = "".join(map(chr, b[:-1])) + chr(b[-1] + FINAL * final)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            names[i] = content
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        self.rank = {vocab[a + b]: n for n, (a, b) in enumerate(merges)}
        self.halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        self.automaton = ahocorasick.Automaton()
        for i, s in self.symbols.items():
            if i in self.halves or len(s) == 1:
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        # Next shorter token that begins a token, found as all tokens' beginnings are looked up.
        known = {s: i for i, s in self.symbols.items() if i in self.halves or len(s) == 1}
        self.sizes = {i: len(s) for s, i in known.items()}
        self.shorter = {i: next(known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known)
                        for s, i in known.items() if len(s) > 1}
        self.pairs = Memo(self.fits, CACHE // 3)
        self.words = Memo(self.word, CACHE // 4)
        self.chunks = Memo(self.chunk, CACHE)
        self.split = regex.compile(f"[{SPACE}]+").split
        self.pretokens = regex.compile(PRETOKEN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.marks = tuple(self.special)
        # Offset table: every token's bytes and a space, in one buffer.
        pieces = [f"{n} ".encode() for n in names]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)

    def fits(self, pair: tuple[int, int]) -> bool:
        """True if merging never joins symbols across the border of these two tokens."""
        left, right = pair
        # Undo the merges on both sides of the border, latest first.  A merge across the border
        # would win as soon as its rank is below that of the later of the two it competes with.
        rank, merge, halves = self.rank, self.merge, self.halves
        bound = len(rank)
        while True:
            joined = merge.get((left, right))
            if joined is not None and rank[joined] < bound:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                bound, left = a, halves[left][1]
            else:
                # Equal priority goes to the leftmost pair: the border wins against its right side.
                bound, right = b + 1, halves[right][0]

    def word(self, text: str) -> bytes:
        """Tokens of one pre-token, packed."""
        b = text.encode()
        s = b[:-1].decode("latin-1") + chr(b[-1] + FINAL)
        matches, pairs = self.automaton.iter_long, self.pairs
        ids: list[int] = []
        # The longest matches one after the other, as far as they go together.
        pos = 0
        for _, (token, size) in matches(s):
            if ids and not pairs[ids[-1], token]:
                break
            ids.append(token)
            pos += size
        else:
            return array(self.kind, ids).tobytes()
        shorter, sizes, dead, n = self.shorter, self.sizes, set(), len(s)
        while True:
            token = shorter.get(token)
            if token is None:
                # No token fits here: the one before has to end elsewhere.
                dead.add(pos)
                token = ids.pop()
                pos -= sizes[token]
                continue
            while pos + sizes[token] not in dead and (not ids or pairs[ids[-1], token]):
                ids.append(token)
                pos += sizes[token]
                if pos == n:
                    return array(self.kind, ids).tobytes()
                token = next(matches(s, pos))[1][0]

    def chunk(self, text: str) -> bytes:
        """Tokens of a text without white space, packed."""
        words = self.words
        if text.isascii():
            # A plain word in lower case is remembered here only, for itself and for other forms of it.
            plain = text.lower()
            if plain.isalpha():
                return self.word(plain) if plain == text else self.chunks[plain]
            if plain[:-1].isalpha() and plain[-1] in ".,;:!?":
                return self.chunks[plain[:-1]] + words[plain[-1]]
        else:
            plain = normalize("NFC", text).replace("Σ", "σ").lower()
            if plain.isalpha():
                return words[plain]
            if plain[:-1].isalpha() and plain[-1] in ".,;:!?":
                return words[plain[:-1]] + words[plain[-1]]
        out = []
        for part in self.specials.split(text) if any(m in text for m in self.marks) else (text,):
            if part in self.special:
                out.append(array(self.kind, [self.special[part]]).tobytes())
            elif part:
                plain = normalize("NFC", part).replace("Σ", "σ").lower()
                out += [words[w] for w in self.pretokens(plain)]
        return b"".join(out)

    def packed(self, text: str | None) -> bytes:
        """Token ids of a whole text in the vocabulary's own width."""
        text = text or ""
        # Python's own split parts texts at the same characters, and at four more.
        parts = self.split(text) if any(c in text for c in NOT_SPACE) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text as unsigned 32-bit numbers."""
        return np.frombuffer(self.packed(text), self.kind).astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the tokens, joined by spaces as this vocabulary's decoder does."""
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(size)
        take = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.buffer[take].tobytes()[:-1]


def shared_encoder(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """A function that gives the worker's encoder of this tokenizer file.

    The file's text (a few MB) is broadcast.  A Python worker keeps the value of a broadcast,
    so the encoder made from it, with all it remembers, serves every task of that worker.
    """
    with open(path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast({"source": f.read()})

    def encoder() -> Encoder:
        value = held.value
        if "encoder" not in value:
            value["encoder"] = Encoder(value["source"])
        return value["encoder"]

    return encoder


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` text of every document.

    Null and empty texts have no ids and decode to the empty text.  Rows with equal or null
    ``doc_id`` are kept one by one; other columns are ignored.
    """
    shared = shared_encoder(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared()
        for batch in batches:
            ids = [encoder.encode(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [i.tobytes() for i in ids],
                                "decoded": [encoder.decode(i).decode() for i in ids]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids, and digests of ids and of decoded text, for every document.

    The same as digests over :func:`encode_documents`, made where the ids are, so that
    they don't leave the task.
    """
    shared = shared_encoder(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared()
        for batch in batches:
            rows = []
            for t in batch["text"]:
                ids = encoder.encode(t)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                             hashlib.sha256(encoder.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
