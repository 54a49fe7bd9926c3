"""Scores from cue words: how many distinct cues of a label a text holds, out of a fixed number."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import ClassificationSpec, Schema, SchemaError
from .base import register

STEP = 8
"""A text with this many cues of a label, or more, has score 63/64 for it."""


def cues_of(label: str, description: str = "", examples: tuple[str, ...] = ()) -> list[str]:
    """Words of a label's name, description and examples, in small letters."""
    found = [w for part in (label.replace("_", " "), description, *examples) for w in part.lower().split()]
    return list(dict.fromkeys(found))


def word_set(text: Column) -> Column:
    """The distinct words of a text, in small letters."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"))


def cue_score(words: Column, cues: list[str]) -> Column:
    """(1 + 62 * min(distinct cues among the words, STEP) / STEP) / 64 in single precision."""
    held = F.size(F.array_intersect(words, F.array(*[F.lit(c) for c in cues])))
    return ((1 + 62 * F.least(held, F.lit(STEP)) / STEP) / 64).cast("float")


@register("lexical")
@dataclass
class LexicalScorer:
    cues: dict[str, list[str]] = field(default_factory=dict)
    id_col: str = "doc_id"
    text_col: str = "text"

    @classmethod
    def of(cls, spec: ClassificationSpec, **options) -> LexicalScorer:
        descriptions = dict(spec.label_descriptions)
        return cls({x: cues_of(x, descriptions.get(x, ""), tuple(g for g, label in spec.examples if label == x)) for x in spec.labels}, **options)

    def validate(self, schema: Schema) -> None:
        missing = [x for c in schema.classifications for x in c.labels if x not in self.cues]
        if missing:
            raise SchemaError(f"no cue words for {', '.join(missing)}")

    def spans(self, docs: DataFrame, labels: list[str]) -> DataFrame:
        raise SchemaError("the lexical scorer scores labels, not spans")

    def labels(self, docs: DataFrame, task: str, labels: list[str]) -> DataFrame:
        score = lambda words: F.array(*[F.struct(F.lit(x).alias("label"), F.lit(i).alias("ix"), cue_score(words, self.cues[x]).alias("score")) for i, x in enumerate(labels)])
        each = let(word_set(F.col(self.text_col)), score)
        rows = docs.select(F.col(self.id_col).alias("doc_id"), F.lit(task).alias("task"), F.explode_outer(each).alias("x"))
        return rows.select("doc_id", "task", "x.label", "x.ix", "x.score")
