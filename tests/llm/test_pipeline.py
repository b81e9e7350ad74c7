"""The pipeline on a few documents: each stage's decisions take effect, and tokens match the library's."""

import public_tokenizers
from helpers import EXTRA, frame, prose
from tokenizers import Tokenizer

import corpus_pipeline

LINE = "All rights of this invented newsletter are reserved by nobody at all"


def rows():
    texts = [prose(i, 150) + ("\n" + LINE if i % 5 == 0 else "") for i in range(30)]
    texts[7] += "\nwrite to someone.new@mail.example soon"
    texts.append(" ".join(f"{w}###" for w in texts[3].split()))
    texts.append(texts[2].replace(" ", "  ", 1).rsplit(" ", 1)[0] + " changed")
    texts += ["short", None]
    return [(i, t, "en", "s", *EXTRA) for i, t in enumerate(texts)]


def test_stages(spark):
    docs, after = frame(spark, rows()), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, ""))
        after.append(docs)
    texts = [{r.doc_id: r.text for r in d.collect()} for d in after[:4]]
    assert all(d.columns == frame(spark, []).columns for d in after[:4])
    assert sorted(texts[0]) == [*range(30), 31], "symbols, short and null texts are rejected"
    given = {r[0]: r[1] for r in rows()}
    for i, t in texts[1].items():
        want = given[i].replace("\n" + LINE, "") if i % 5 == 0 and i else given[i]
        # The near copy is one line that follows its original's template.
        assert t == ("" if i == 31 else want), "the line stays in its first document only"
    assert sorted(texts[2]) == [*range(30), 31] and all(texts[2][i] == texts[1][i] for i in texts[2])
    assert texts[3] == {i: t.replace("someone.new@mail.example", "<EMAIL>") for i, t in texts[2].items()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts[3].items()}
    got = {}
    for p in after[4].collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        assert p.doc_tokens == want[p.doc_id]
    assert got == want


def test_no_documents(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
