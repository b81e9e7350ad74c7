"""Encoding, decoding and packing against the tokenizers library and by round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from themeloom.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    ENCODER = bpe.Encoder(f.read())


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = ENCODER.encode(text)
    assert got.tolist() == want
    assert ENCODER.decode(got).decode() == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdethrinos' .,1²éß日😀<|>oftxΣİ\n\u3000́!_\x1c\x85"), max_size=60))
def test_any_text_like_the_library(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinorst", min_size=1, max_size=40))
def test_long_words_like_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 500, "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>", "don't we've",
                                  "ΑΣ ΣΑ", "İ", "\x00", "!" * 400, "naïve — “q”"])
def test_awkward_texts(text):
    same(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    with open(PATH, encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    text = prose(9, 300)
    assert encoder.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_white_space_is_that_of_the_tokenizer():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ours = {c for c in every if ENCODER.split(f"a{c}b") == ["a", "b"]}
    assert {c for c in every if f"a{c}b".split() == ["a", "b"]} == ours | set(bpe.NOT_SPACE)
    same("one\x1ctwo\x1d three\x85four")


def test_digests(spark):
    rows = documents()
    got = sorted(map(tuple, bpe.encode_digests(frame(spark), PATH).collect()), key=str)
    want = []
    for r in rows:
        ids = LIBRARY.encode(r[1] or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = bpe.encode_documents(frame(spark), PATH).collect()
    assert sorted((r.doc_id, hashlib.sha256(bytes(r.ids)).hexdigest()) for r in full if r.doc_id is not None) == sorted(
        (d, h) for d, _, h, _ in want if d is not None)
    assert bpe.encode_digests(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("length", [64, 4096])
def test_packing_round_trip(spark, length):
    rows = documents()
    pieces = packing.pack(frame(spark), PATH, length).collect()
    sequences, texts = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        texts[p.doc_id, p.start].append((p.length, bytes(p.ids), p.doc_tokens))
    for s, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    want = [(r[0], [*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    assert sum(p.length for p in pieces) == sum(len(i) for _, i in want)
    for d, ids in want:
        if sum(x == d for x, _ in want) == 1:
            got, at = [], 0
            while at < len(ids):
                (n, part, total), = texts[d, at]
                got += np.frombuffer(part, "<u4").tolist()
                assert total == len(ids)
                at += n
            assert got == ids
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_hilbert_steps_to_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert len(set(packing.hilbert(grid, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_like_documents_are_near_on_the_curve(spark):
    r = random.Random(3)
    halves = [" ".join(r.choice(["river", "water", "boat", "fish"]) for _ in range(60)) for _ in range(20)]
    halves += [" ".join(r.choice(["stock", "market", "price", "bank"]) for _ in range(60)) for _ in range(20)]
    place = packing.places([ENCODER.encode(t) for t in halves], packing.directions(1024))
    order = np.argsort(place, kind="stable") < 20
    assert (np.diff(order.astype(int)) != 0).sum() <= 6
