"""Alignment against a plain version over whole texts, perfect hashing, and awkward texts."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from check import SF
from helpers import EXTRA, frame, of_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from themeloom.llm import align, bpe, perfecthash

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FIRST)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=SECOND)
with open(FIRST, encoding="utf-8") as f:
    SOURCE = f.read()
with open(SECOND, "rb") as f:
    ALIGNER = align.Aligner(SOURCE, f.read())
LETTERS = {c: b for b, c in enumerate(bpe.byte_letters())}
NAMES = {i: t for t, i in json.loads(SOURCE)["model"]["vocab"].items()}


def ends(parts):
    return np.cumsum([len(p) for p in parts]).tolist()


def plain(text):
    """Ids of both tokenizers on the whole text, groups and links; None without tokens."""
    if not text:
        return None
    a = A.encode(f" {text}", add_special_tokens=False).ids
    b = B.encode(text)
    pa = [bytes(LETTERS[c] for c in NAMES[i]) for i in a]
    pb = [bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(pa) != f" {text}".encode() or b"".join(pb) != f" {text}".encode():
        return None
    ea, eb = ends(pa), ends(pb)
    groups, links, x, y = [], [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        ga, gb = [], []
        while x < len(a) and ea[x] <= cut:
            ga.append(x)
            x += 1
        while y < len(b) and eb[y] <= cut:
            gb.append(y)
            y += 1
        groups.append(f"{','.join(str(a[i]) for i in ga)}|{','.join(str(b[i]) for i in gb)}")
        links += [(a[i], b[j]) for i in ga for j in gb
                  if max(ea[i] - len(pa[i]), eb[j] - len(pb[j])) < min(ea[i], eb[j])]
    return a, b, ";".join(groups), links


def plain_rows(rows):
    made = [(d, plain(t)) for d, t in rows]
    count = Counter(p for _, m in made if m for p in m[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, m in made:
        if m is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = m
        out.append((d, len(a), len(b), groups.count(";") + 1, len(links), sum(count[p] == best[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str), count


AWKWARD = ["▁ mark inside", "<s> plain </s> <unk> <|endoftext|>", "two  spaces   and\n \n lines \t", " leading and trailing ",
           "naïve é日😀   \u0085 \x1c x", "x" * 5000, "don't we've  'll", "\n", " ", "a\x00b", "1234567890 12"]


def columns(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard,group,batch", [(1 << 16, 500_000, 16 << 20), (200, 300, 4000)])
def test_equals_the_plain_version(spark, monkeypatch, shard, group, batch):
    # Small shards, groups and batches: many perfect hashes, several branches and levels of the tree.
    monkeypatch.setattr(align, "BATCH", batch)
    monkeypatch.setattr(align, "FAN", 2)
    docs = of_texts(spark, AWKWARD, 100).unionByName(frame(spark))
    want, count = plain_rows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert columns(align.align(docs, FIRST, SECOND, digest=True, shard=shard, group=group)) == want
    pairs = align.pair_counts(docs, FIRST, SECOND, shard, group).collect()
    assert {(r.first_id, r.second_id): r["count"] for r in pairs} == count


def test_whole_table_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = plain_rows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert columns(align.align(docs, FIRST, SECOND, digest=True)) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdethrinos' .,1²éß日😀<|>\n\t　 \u0085\x1c▁_!"), max_size=60))
def test_pieces_are_those_of_whole_texts(text):
    want, found = plain(text), ALIGNER.pieces(text)
    if want is None:
        assert not found
    else:
        assert b";".join(f[0] for f in found).decode() == want[2]
        n = ALIGNER.n_second
        assert ALIGNER.links(found).tolist() == [a * n + b for a, b in want[3]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdethrinos' .,1²éß日😀<|>\n\t　 \u0085\x1c\u180e\u0301_!"), max_size=80))
def test_both_ways_to_the_first_ids_agree(text):
    assert ALIGNER.encode_first(text) == A.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_use_their_own_library():
    spec = json.loads(SOURCE)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    text = " the lengthening shadows"
    other = Tokenizer.from_str(json.dumps(spec)).encode(text, add_special_tokens=False).ids
    assert align.encoder_of(json.dumps(spec), spec)(text) == other != A.encode(text, add_special_tokens=False).ids


def test_groups_are_given_as_text(spark):
    (row,) = align.align(of_texts(spark, ["Hello wonderful world"]), FIRST, SECOND).collect()
    assert row.groups == plain("Hello wonderful world")[2]


def test_no_documents_and_no_tokens(spark):
    assert align.align(frame(spark, []), FIRST, SECOND, digest=True).count() == 0
    none = align.align(frame(spark, [(None, None, "en", None, *EXTRA), (3, "", "en", None, *EXTRA)]), FIRST, SECOND, digest=True)
    assert columns(none) == [(3, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
    assert align.pair_counts(frame(spark, []), FIRST, SECOND).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash_is_minimal_and_unknown_keys_are_told(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 31, n).astype(np.uint64)) if n != 2 else np.array([0, (1 << 64) - 1], np.uint64)
    levels = perfecthash.build(keys)
    index = perfecthash.Index(levels).of(keys)
    assert sorted(index.tolist()) == list(range(len(keys)))
    assert n < 1000 or 8 * len(levels) < 5 * len(keys)
    placed = np.zeros(len(keys), np.int64)
    placed[index] = keys.view(np.int64)
    if n:
        with pytest.raises(ValueError):
            align.places(levels, placed.tobytes(), np.array([-5], np.int64))


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        perfecthash.build(np.array([5, 5, 7], np.uint64))

