"""Text columns: cleaning, tokens, tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, and one word, as patterns both Java and RE2 read
# alike (``\s`` and ``\w`` differ between engines).
BLANK = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"

MIN_TEXT = 5


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def first_text(fields: Sequence[Column]) -> Column:
    """First field that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], F.lit(""))


def usable_text(c: Column) -> Column:
    """Trimmed text, or null if it is missing or shorter than five characters."""
    t = strip(c)
    return F.when(F.length(t) >= MIN_TEXT, t)


def words(c: Column) -> Column:
    """Lower-case words of one or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def blank_tokens(c: Column) -> Column:
    """Tokens between white space; empty text has none."""
    t = strip(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{BLANK}+"))


def tag_group(tag: Column) -> Column:
    """Tag without its ``B-``/``I-`` prefix; generic ``LABEL_n`` tags are empty."""
    bare = F.regexp_replace(tag, "^[BI]-", "")
    return F.when(bare.startswith("LABEL_"), F.lit("")).otherwise(bare)


def digits_int(c: Column) -> Column:
    """Integer made of the digits in a word; null if there are none or too many."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("int")
