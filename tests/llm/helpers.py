"""Small documents with every awkward case, and plain versions of the operators to compare with."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Columns whose names clash with those the operators use inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       *[T.StructField(c, T.LongType()) for c in ("h1", "sig", "node", "doc", "key", "start", "n", "row",
                                                                  "kept", "base", "_h", "_k1", "gone")]])
EXTRA = (1,) * 13


def prose(seed, words=120, vocabulary=4000):
    r = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(r.choice("aeiourstlnmd") for _ in range(r.randint(2, 8))) if r.random() < 0.8 else r.choice(["the", "of", "and"])
        out.append(w + ("." if i % 11 == 10 else ""))
    return " ".join(out)


def documents():
    base = prose(1)
    near = base.replace(" ", "  ", 1).rsplit(" ", 1)[0] + " changed"
    texts = [None, "", " \n\t ", base, base, near, base.upper(), "one two", "one  two", prose(2), prose(3) + "\n" + prose(4),
             "x" * 50_000, prose(5, 12_000), "Zoë — “naïve” \U0001F600 end", "a\x00b c"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", *EXTRA) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, None, None, *EXTRA), (None, "nobody's text here", "en", None, *EXTRA)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def of_texts(spark, texts, start=0):
    return frame(spark, [(start + i, t, "en", "s", *EXTRA) for i, t in enumerate(texts)])
