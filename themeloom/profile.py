"""Field profiles: where a document table keeps its text, date, score and vector."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoreField:
    name: str = "score"
    type: str = "keyword"      # "numeric" compares bounds, "keyword" lists values
    min: int = 0
    max: int = 5
    cast: str = "int"          # "string" if scores are stored as text


@dataclass(frozen=True)
class Profile:
    id: str = "doc_id"
    vector: str = "vector"
    text: tuple[str, ...] = ("text",)
    timestamp: str = "timestamp"
    score: ScoreField = field(default_factory=ScoreField)
    category: str | None = None
    brand: str | None = None
    product: str | None = None
    query_term_map: dict[str, tuple[str, ...]] = field(default_factory=dict)
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def terms_for(self, key: str) -> list[str]:
        """Sorted union of a key's terms and synonyms."""
        return sorted({*self.query_term_map[key], *self.synonyms.get(key, ())})


# The two field profiles users have today.
FOOD_REVIEWS = Profile(
    id="doc_id",
    vector="review_embedding",
    text=("text",),
    timestamp="timestamp",
    score=ScoreField("score", "keyword", 0, 5, "int"),
    query_term_map={
        "electronics": ("electronics",),
        "food": ("food", "foods", "grocery"),
    },
    synonyms={
        "electronics": ("electronic", "gadget", "device"),
        "food": ("grocery", "snack", "snacks"),
    },
)
ELECTRONICS_REVIEWS = Profile(
    id="doc_id",
    vector="review_embedding",
    text=("text", "title"),
    timestamp="timestamp",
    score=ScoreField("rating", "numeric", 0, 5),
    category="category",
)


def logical(docs: DataFrame, profile: Profile) -> DataFrame:
    """Documents under logical names; only the profile's columns are read."""
    cols = [F.col(profile.id).alias("doc_id"),
            F.col(profile.timestamp).alias("timestamp"),
            F.col(profile.score.name).alias("score"),
            F.col(profile.vector).alias("vector"),
            *[F.col(t).alias(f"text_{i}") for i, t in enumerate(profile.text)]]
    for name in ("category", "brand", "product"):
        physical = getattr(profile, name)
        if physical:
            cols.append(F.col(physical).alias(name))
    return docs.select(*cols)


def text_columns(df: DataFrame) -> list[Column]:
    """Logical text fields of a table made by :func:`logical`, in profile order."""
    n = sum(c.startswith("text_") for c in df.columns)
    return [F.col(f"text_{i}") for i in range(n)]
